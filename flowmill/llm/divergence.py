"""How the sources of a language differ in their words: exact divergences of smoothed term shares.

Terms are runs of ASCII letters (A-Z in lower case) and of bytes from 0x80 on.  They are found on the bytes of a batch's UTF-8 buffer: a
lookup table of 256 entries lowers letters and marks what separates, and differences of the marks give the boundaries.
Equal slices of a buffer are grouped and verified byte by byte, so that a collision merges nothing; each distinct one is known
by its XXH64, and where counts of tasks meet, by its bytes.

Two passes over the texts.  The first counts the documents of each (language, term) by a 64-bit key, which gives a superset of
the terms that are kept; the second counts the occurrences of these only, by source, and the documents again by the terms
themselves.  So the long tail of rare words is shuffled as numbers, and never by source.

Counts are then cut into blocks of terms, each with all its sources: a CSR matrix of sources by terms.  A term that a source lacks
has that source's least share, so the sum over the block of abs(p - q) is that of two constants, corrected where either matrix row has
entries: two gathers and a ``reduceat`` for each source.  Blocks' sums add up to the divergences.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.llm.common import cut
from flowmill.llm.text import mix
from flowmill.storage import bounded

#: Added to each count; shares are of so many; a term needs so many documents of its language; terms listed a group.
EXTRA, WHOLE, MIN_DOCS, TOP = 5, 1_000_000_000, 30, 50

#: Bytes of text that are tokenized at once, and pairs of document and term that a task holds.
WINDOW, HELD = 1 << 20, 2_000_000

#: Kept keys that are broadcast (8 bytes each); with more, counts of all terms are shuffled and joined with them.
MAX_KEYS = 4_000_000

#: Entries of a block's matrix, about; at least as many as a block has pairs of sources.
BLOCK_CELLS = 10_000

#: Each byte in lower case, or 0 if it separates.
LOWER = np.arange(256, dtype="u1")
LOWER[:65], LOWER[65:91], LOWER[91:97], LOWER[123:128] = 0, np.arange(97, 123), 0, 0


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column's values, end to end, and where each begins (and the last ends)."""
    kind = "<i8" if pa.types.is_large_binary(column.type) else "<i4"
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype("i8") if len(column) else np.zeros(1, "i8")
    whole = np.frombuffer(data, "u1") if data else np.zeros(0, "u1")
    return whole[at[0] : at[-1]], at - at[0]


def windows(text: np.ndarray, starts: np.ndarray, size: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Terms of concatenated texts that begin at ``starts`` (and the last ends): parts of lowered bytes, in which no term is cut, with
    the terms' starts and ends in it and their documents.
    """
    at = 0
    while at < len(text):
        end = min(at + size, len(text))
        while end < len(text) and LOWER[text[end - 1]]:  # on to the next byte that separates
            step = np.flatnonzero(LOWER[text[end : end + size]] == 0)
            end = end + int(step[0]) + 1 if len(step) else min(end + size, len(text))
        low = LOWER[text[at:end]]
        first = np.zeros(len(low) + 1, bool)  # a text begins here
        first[starts[(starts >= at) & (starts <= end)] - at] = True
        inside = low != 0
        before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
        a = np.flatnonzero(inside & (~before | first[:-1]))
        b = np.flatnonzero(inside & (~after | first[1:])) + 1
        yield low.tobytes(), a, b, np.searchsorted(starts, a + at, "right") - 1
        at = end


def packed(low: bytes, a: np.ndarray, length: np.ndarray, at: int) -> np.ndarray:
    """The eight bytes from ``at`` on of each slice, as a number; bytes beyond its end count as 0."""
    data = np.concatenate([np.frombuffer(low, "u1"), np.zeros(at + 8, "u1")])
    whole = np.lib.stride_tricks.sliding_window_view(data, 8)[a + at].view("<u8")[:, 0]
    some = np.clip(length - at, 0, 8).astype("u8") * np.uint64(8)
    return np.where(some < 64, whole & ((np.uint64(1) << (some % np.uint64(64))) - np.uint64(1)), whole)


def same_rest(low: bytes, a: np.ndarray, to: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether slices of equal lengths over 16 that begin at ``a`` and at ``to`` have the same bytes from the 16th on."""
    if not len(a):
        return np.zeros(0, bool)
    data, size = np.frombuffer(low, "u1"), length - 16
    begin = np.cumsum(size) - size
    step = np.arange(int(size.sum())) - np.repeat(begin - 16, size)
    return np.logical_and.reduceat(data[np.repeat(a, size) + step] == data[np.repeat(to, size) + step], begin)


def distinct(low: bytes, a: np.ndarray, b: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct slices from a to b: the place of one of each, the number of each slice's own one, and their XXH64.

    Slices are grouped by a mix of their first 16 bytes and lengths, and verified: those that differ from the first one of their group
    in any byte go on to groups of their own.  So each distinct slice is hashed once.
    """
    length = b - a
    head, tail = packed(low, a, length, 0), packed(low, a, length, 8)
    key = mix(head ^ mix(tail + length.astype("u8"))) >> np.uint64(64 - bits)
    firsts, number, left = [], np.zeros(len(a), "i8"), np.arange(len(a))
    while len(left):
        _, first, inverse = np.unique(key[left], return_index=True, return_inverse=True)
        to = left[first][inverse]
        same = (head[left] == head[to]) & (tail[left] == tail[to]) & (length[left] == length[to])
        long = np.flatnonzero(same & (length[left] > 16))
        same[long] = same_rest(low, a[left[long]], a[to[long]], length[left[long]])
        number[left[same]] = inverse[same] + sum(map(len, firsts))
        firsts.append(left[first])
        left = left[~same]  # other terms of the same key
    places = np.concatenate(firsts) if firsts else left
    digest = xxhash.xxh64_intdigest
    return places, number, np.fromiter((digest(low[x:y]) for x, y in zip(a[places].tolist(), b[places].tolist(), strict=True)), "u8", len(places))


def keys_of(found: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """The key of each (term, language), by the hashes of both."""
    return mix(found ^ langs).view("i8")


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    some, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return some, np.bincount(inverse, np.concatenate(counts), len(some)).astype("i8")


def _numbered(*columns: pa.Array) -> tuple[np.ndarray, list[tuple]]:
    """A number for each row's values, and the values of each number."""
    values = list(zip(*(c.to_pylist() for c in columns), strict=True))
    seen: dict[tuple, int] = {}
    return np.array([seen.setdefault(v, len(seen)) for v in values], "i8"), list(seen)


def _lang_hashes(column: pa.Array) -> np.ndarray:
    own, names = _numbered(column)
    return np.array([xxhash.xxh64_intdigest(name.encode(), 1) for (name,) in names], "u8")[own]


def texts_of(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    lang, source, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col, text_col))
    return docs.select(lang.alias("lang"), source.alias("source"), text.cast("binary").alias("text"))


def frequent_keys(texts: DataFrame, min_docs: int, *, window: int = WINDOW, bits: int = 64) -> DataFrame:
    """``key``: of every term in at least ``min_docs`` documents of a language, and perhaps of some others."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
        for batch in batches:
            langs, rows = _lang_hashes(batch.column(0)), batch.num_rows
            for low, a, b, docs in windows(*buffers(batch.column(2)), window):
                _, number, found = distinct(low, a, b, bits)
                pair = np.unique(number * rows + docs)  # once a document
                some, n = np.unique(keys_of(found[pair // rows], langs[pair % rows]), return_counts=True)
                keys.append(some), counts.append(n)
                if sum(map(len, keys)) > HELD:
                    keys, counts = ([x] for x in merged(keys, counts))
                    if len(keys[0]) > HELD // 2:
                        yield _columns({"key": keys[0], "n": counts[0]})
                        keys, counts = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
        yield _columns(dict(zip(("key", "n"), merged(keys, counts), strict=True)))

    return texts.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("key")


def _columns(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def term_counts(texts: DataFrame, min_docs: int, *, window: int = WINDOW, bits: int = 64, max_keys: int = MAX_KEYS) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of every term that may be in ``min_docs`` documents of its language."""
    kept = cut(frequent_keys(texts, min_docs, window=window, bits=bits))
    few = kept.count() <= max_keys
    known = texts.sparkSession.sparkContext.broadcast(np.sort(kept.toArrow().column(0).to_numpy())) if few else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, (own, names), rows = _lang_hashes(batch.column(0)), _numbered(batch.column(0), batch.column(1)), batch.num_rows
            vocabulary: dict[bytes, int] = {}
            held, size = [], 0  # (document, term), n
            for low, a, b, docs in windows(*buffers(batch.column(2)), window):
                places, number, found = distinct(low, a, b, bits)
                pair, n = np.unique(number * rows + docs, return_counts=True)
                term, docs = pair // rows, pair % rows
                if few:
                    key = keys_of(found[term], langs[docs])
                    at = np.searchsorted(known.value, key)
                    at[at == len(known.value)] = 0
                    some = known.value[at] == key if len(known.value) else np.zeros(len(key), bool)
                    term, docs, n = term[some], docs[some], n[some]
                if not len(term):
                    continue
                some, term = np.unique(term, return_inverse=True)
                places = places[some]
                word = np.array([vocabulary.setdefault(low[x:y], len(vocabulary)) for x, y in zip(a[places].tolist(), b[places].tolist(), strict=True)], "i8")
                held.append(((docs << 32) | word[term], n))
                size += len(term)
                if size > HELD and docs.min() == docs.max():  # one long text goes on: its terms come once each
                    held = [merged(*zip(*held, strict=True))]
                    size = len(held[0][0])
            if held:
                yield counted(*merged(*zip(*held, strict=True)), own, names, list(vocabulary))

    def counted(pair: np.ndarray, n: np.ndarray, own: np.ndarray, names: list[tuple], words: list[bytes]) -> pa.RecordBatch:
        cell, inverse = np.unique((own[pair >> 32] << 32) | (pair & 0xFFFFFFFF), return_inverse=True)
        group, term = cell >> 32, cell & 0xFFFFFFFF
        lang, source = (pa.array([x[k] for x in names], pa.string()).take(pa.array(group)) for k in (0, 1))
        keys = np.zeros(len(cell), "i8")
        if not few:
            hashed = np.array([xxhash.xxh64_intdigest(w) for w in words], "u8")
            keys = keys_of(hashed[term], np.array([xxhash.xxh64_intdigest(x[0].encode(), 1) for x in names], "u8")[group])
        sums = np.bincount(inverse, n, len(cell)).astype("i8"), np.bincount(inverse, minlength=len(cell))
        word = pa.array(words, pa.binary()).cast(pa.string()).take(pa.array(term))
        return pa.RecordBatch.from_arrays([lang, source, word, pa.array(keys), *map(pa.array, sums)], ["lang", "source", "term", "key", "n", "docs"])

    rows = texts.mapInArrow(count, "lang string, source string, term string, key long, n long, docs long")
    if not few:
        rows = rows.join(kept, "key", "left_semi")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(WHOLE * (count + EXTRA) / of), exactly: by long division in steps of 1,000, so ``of`` may reach 9e15."""
    if len(of) and int(np.max(of)) > 9 * 10**15:
        raise ValueError("more occurrences than exact shares are computed for")
    left, out = np.asarray(count) + EXTRA, np.zeros(len(of), "i8")
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // of, left % of
    return out + 1


def sums_of_differences(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, least: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each row i of a CSR matrix (entries sorted by row), the sums over all ``width`` columns of abs(row i - row j) for each
    j > i. Entries that are not there are ``least`` of their row.
    """
    begin = np.searchsorted(rows, np.arange(len(least) + 1))
    for i in range(len(least) - 1):
        dense = np.full(width, least[i])
        own = slice(begin[i], begin[i + 1])
        dense[columns[own]] = values[own]
        j = np.arange(i + 1, len(least))
        # Against rows that hold nothing but their least value:
        ordered = np.sort(values[own])
        total = np.concatenate([[0], np.cumsum(ordered)])
        below = np.searchsorted(ordered, least[j])
        sums = (width - len(ordered)) * np.abs(least[i] - least[j]) + total[-1] - 2 * total[below] + (2 * below - len(ordered)) * least[j]
        # and where they hold more:
        rest = slice(begin[i + 1], len(rows))
        if rest.start < rest.stop:
            mine = dense[columns[rest]]
            more = np.abs(mine - values[rest]) - np.abs(mine - least[rows[rest]])
            filled = j[begin[j + 1] > begin[j]]
            sums[filled - i - 1] += np.add.reduceat(more, begin[filled] - rest.start)
        yield sums


def arrow_groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each run of equal values in the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            new[1:] |= pc.not_equal(batch.column(k).slice(1), batch.column(k).slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        if held and any(held[-1].column(k)[0] != batch.column(k)[0] for k in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _block(block: pa.Table, top: int) -> Iterator[pa.RecordBatch]:
    """Rows ``lang, source, part, item, value`` of one block: its groups come first (kind 0), then its cells."""
    lang, head = block["lang"][0].as_py(), int(pc.sum(pc.equal(block["kind"], 0)).as_py())
    sources, kept, of_lang = block["source"].slice(0, head).to_pylist(), block["n_kept"][0].as_py(), block["lang_n"][0].as_py()
    n, total = (block[x].slice(head).to_numpy() for x in ("n", "total"))
    whole = block["group_n"].slice(0, head).to_numpy() + EXTRA * kept
    place = {s: k for k, s in enumerate(sources)}
    rows = np.array([place[s] for s in block["source"].slice(head).to_pylist()], "i8")
    named = [t.encode() for t in block["term"].slice(head).to_pylist()]
    terms = sorted(set(named))
    number = {t: k for k, t in enumerate(terms)}
    columns = np.array([number[t] for t in named], "i8")
    order = np.lexsort((columns, rows))
    rows, columns, n, total = rows[order], columns[order], n[order], total[order]
    least = shares(np.zeros(head, "i8"), whole) if kept else np.zeros(head, "i8")
    values = shares(n, whole[rows])

    over = values - shares(total, np.full(len(total), of_lang + EXTRA * kept))
    high = np.flatnonzero(over > 0)
    high = high[np.lexsort((columns[high], -over[high], rows[high]))]
    rank = np.arange(len(high)) - np.searchsorted(rows[high], rows[high])
    high = high[rank < top]
    yield _rows(lang, "term", [sources[k] for k in rows[high]], [terms[k].decode() for k in columns[high]], over[high])
    for i, sums in enumerate(sums_of_differences(rows, columns, values, least, len(terms))):
        yield _rows(lang, "pair", [sources[i]] * len(sums), sources[i + 1 :], sums)


def _rows(lang: str, part: str, sources: list[str], items: list[str], values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(sources, pa.string()), pa.array([part] * len(values), pa.string()), pa.array(items, pa.string()), pa.array(values, pa.int64())], ["lang", "source", "part", "item", "value"])


def source_divergence(
    docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP, block_cells: int = BLOCK_CELLS, window: int = WINDOW, bits: int = 64, max_keys: int = MAX_KEYS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every (lang, source) that occurs.

    Part ``pair``: each other source of the language, with the sum over the language's kept terms (those in at least ``min_docs`` of
    its rows) of abs(p - q); part ``term``: the ``top`` terms that are most over the language's own share, by how much.  Shares are
    p = 1 + floor(1e9 * (count + 5) / (N + 5 V)), in whole numbers.  Null text, lang and source are empty; repeated rows
    are documents of their own; an empty table has no rows; a language without kept terms has divergences of 0.
    """
    texts = texts_of(docs, text_col, lang_col, source_col)
    found = cut(term_counts(texts, min_docs, window=window, bits=bits, max_keys=max_keys))
    kept = cut(found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= min_docs).select("lang", "term", "total"))
    cells = cut(found.select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
    of_group = cells.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count("*").alias("cells"))
    every = cut(texts.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").select("lang", "source", F.coalesce("group_n", F.lit(0)).alias("group_n"), F.coalesce("cells", F.lit(0)).alias("cells")))
    of_lang = every.groupBy("lang").agg(F.sum("group_n").alias("lang_n"), F.sum("cells").alias("cells"), F.count("*").cast("double").alias("sources"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("cells") / F.greatest(F.lit(float(block_cells)), F.col("sources") * F.col("sources")))).cast("int")
    langs = of_lang.join(kept.groupBy("lang").agg(F.count("*").alias("n_kept")), "lang", "left").select("lang", "lang_n", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), blocks.alias("blocks"))
    langs = bounded(cut(langs))

    def shaped(rows: DataFrame, kind: int, block: Column, **given: Column) -> DataFrame:
        zero = F.lit(0).cast("long")
        names = {"term": F.lit(""), "n": zero, "total": zero, "group_n": zero, "n_kept": zero, "lang_n": zero} | given
        return rows.join(langs, "lang").select("lang", block.alias("block"), F.lit(kind).alias("kind"), "source", *[c.alias(x) for x, c in names.items()])

    first = shaped(every.drop("cells"), 0, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), **{x: F.col(x) for x in ("group_n", "n_kept", "lang_n")})
    rest = shaped(cells, 1, F.pmod(F.xxhash64("term"), "blocks").cast("int"), **{x: F.col(x) for x in ("term", "n", "total")})
    key = ["lang", "block"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in arrow_groups(batches, 2):
            yield from _block(block, top)

    scored = first.unionAll(rest).repartition(*key).sortWithinPartitions(*key, "kind", "source").mapInArrow(score, "lang string, source string, part string, item string, value long")
    scored = cut(scored)
    pairs = scored.where(F.col("part") == "pair").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.unionAll(pairs.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    terms = scored.where(F.col("part") == "term").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.unionAll(terms)
