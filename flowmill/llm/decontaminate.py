"""Benchmark decontamination: passages of documents within a small edit distance of a benchmark item, by words.

Words are runs of letters and digits in lower case.  Every word of a document starts a window of each item size.  Windows
and items are embedded by the CGK random walk, which turns edit distance into Hamming distance: step j writes the current
symbol and moves on or stays, as a random bit of (j, symbol) says.  Bit-sampling LSH compares a few sampled places of the
embeddings; with enough repetitions, each with its own walk, a passage within the bound meets its item with the wanted
recall.  Each meeting is verified by the exact edit distance, which leaves no false ones.

The walks of long passages drift apart, so items of over PIECE words are cut into pieces of nearly equal size.  If a passage is
within the bound, some piece is within its own (else the pieces' edits would add up to more), and its meeting leads to the
whole item's verification.

Two exact bounds go first and spare most windows the walks: a window of n words within k edits of an item has at least
n - k words that are in the benchmark, and few words that repeat the word before them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from flowmill.llm.text import mix, numbers, words

#: Edits allowed, as a share of the item's words; items of fewer words, which can't be told from common phrases, allow none.
EDITS, MIN_WORDS = 0.2, 6

#: Most words that are embedded at once; longer items are cut.
PIECE = 32

#: Places sampled in each repetition, and repetitions: recall of passages with as many edits as allowed is over 0.95
#: (0.997 measured on 400 such passages).
SAMPLES, REPETITIONS, SEED = 2, 16, 20_021

#: Benchmark rows, and characters of these, that are sent to all tasks at once; more are taken in blocks, about so large each.
MAX_ITEMS, MAX_CHARS = 50_000, 64 << 20

#: Words of texts that are searched at once, and of passages that are verified at once.
BLOCK_WORDS, CELLS = 1 << 20, 1 << 18


def allowed(size: int, edits: float, min_words: int = MIN_WORDS) -> int:
    return int(edits * size + 1e-9) if size >= min_words else 0


class Bench:
    """The items' words as numbers (0: not in the benchmark), their sizes, and what each repetition samples of them."""

    def __init__(self, items: list[tuple[object, str]], edits: float, min_words: int) -> None:
        self.edits, self.min_words, self.number = edits, min_words, {}
        split = [(i, words(t)) for i, t in items]
        split = [(i, w) for i, w in split if w]
        self.ids = [i for i, _ in split]
        self.items = [np.array([self.number.setdefault(x, len(self.number) + 1) for x in w], "i4") for _, w in split]
        self.sizes = np.array([len(w) for w in self.items], "i8")
        self.bound = np.array([allowed(n, edits, min_words) for n in self.sizes], "i8")
        cuts = [np.linspace(0, n, ceil(n / PIECE) + 1).astype("i8") for n in self.sizes]
        #: Of each piece: its item, and where it starts and how long it is.
        self.whole = np.repeat(np.arange(len(cuts)), [len(c) - 1 for c in cuts])
        self.offset = np.concatenate([np.zeros(0, "i8"), *[c[:-1] for c in cuts]])
        lengths = np.concatenate([np.zeros(0, "i8"), *[np.diff(c) for c in cuts]])
        self.lengths = lengths
        self.pad = int(2 * lengths.max(initial=0) + 1)  # no walk from a piece goes further
        self.repeats: dict[int, int] = {}
        for item, at, n in zip(self.whole.tolist(), self.offset.tolist(), lengths.tolist(), strict=True):
            w = self.items[item][at : at + n]
            self.repeats[n] = max(self.repeats.get(n, 0), int((w[1:] == w[:-1]).sum()))
        #: Pieces of nearly one size share their walks: (smallest size, pieces).
        self.classes: list[tuple[int, np.ndarray]] = []
        for n in sorted(self.repeats):
            if not self.classes or n > 1.25 * self.classes[-1][0]:
                self.classes.append((n, np.zeros(0, "i8")))
            self.classes[-1] = (self.classes[-1][0], np.concatenate([self.classes[-1][1], np.flatnonzero(lengths == n)]))
        flat = np.concatenate([np.concatenate([w, np.zeros(self.pad, "i4")]) for w in self.items]) if split else np.zeros(0, "i4")
        starts = np.concatenate([[0], np.cumsum(self.sizes + self.pad)])[:-1].astype("i8")[self.whole] + self.offset
        self.keys = {}
        for size, members in self.classes:
            for r in range(REPETITIONS):
                keys = self.sample(flat, starts[members], size, r)
                order = np.argsort(keys, kind="stable")
                self.keys[size, r] = (keys[order], members[order])

    def sample(self, flat: np.ndarray, starts: np.ndarray, size: int, r: int) -> np.ndarray:
        """Of the walks from ``starts``, the symbols written at this repetition's places, as one number."""
        draw = np.random.Generator(np.random.PCG64([SEED, size, r]))
        places = set(draw.choice(2 * size, min(SAMPLES, 2 * size), replace=False).tolist())  # on average, 2n steps cross n words
        at, key = starts.copy(), np.zeros(len(starts), "u8")
        bits = None
        for j in range(max(places) + 1):
            if j % 64 == 0:
                salt = np.uint64(((r << 20) + j // 64 + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
                bits = mix(np.arange(len(self.number) + 1, dtype="u8") * np.uint64(0xD1342543DE82EF95) + salt)
            symbol = flat[at]
            if j in places:
                key = mix(key * np.uint64(31) + symbol.astype("u8") + np.uint64(1))
            at += (bits[symbol] >> np.uint64(j % 64) & np.uint64(1)).astype("i8")
        return key

    def candidates(self, flat: np.ndarray, inside: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window starts, pieces) that met in some repetition, each pair once a size class. Windows start at words, which
        ``inside`` marks, not in the gaps between texts."""
        known = np.concatenate([[0], np.cumsum(flat > 0, dtype="i4")])
        again = np.concatenate([[0, 0], np.cumsum((flat[1:] == flat[:-1]) & (flat[1:] > 0), dtype="i4")])
        last = len(flat) - self.pad
        for size, members in self.classes:
            passed = np.zeros(last, bool)
            for n in np.unique(self.lengths[members]):
                k = allowed(n, self.edits, self.min_words)
                passed |= (known[n : n + last] - known[:last] >= n - k) & (again[n : n + last] - again[1 : 1 + last] <= 3 * k + self.repeats[int(n)])
            starts = np.flatnonzero(passed & inside[:last])
            if not len(starts):
                continue
            met = []
            for r in range(REPETITIONS):
                keys, pieces = self.keys[size, r]
                own = self.sample(flat, starts, size, r)
                low, high = np.searchsorted(keys, own), np.searchsorted(keys, own, side="right")
                count = high - low
                which = np.repeat(np.arange(len(starts)), count)
                pick = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
                met.append(np.unique(which * len(self.whole) + pieces[pick]))
            pairs = np.unique(np.concatenate(met))
            yield starts[pairs // len(self.whole)], pairs % len(self.whole)

    def distances(self, flat: np.ndarray, starts: np.ndarray, item: int, low: np.ndarray, high: np.ndarray, more: int = 0) -> np.ndarray:
        """The least edit distance of the item to any passage from k words before each window to ``k + more`` words after it, inside
        the window's text (from ``low`` to ``high``); where that is over k, a number over k. Passages within k edits have at least n - k words of the item's n, so only windows
        with so many are compared word for word.
        """
        words, k = self.items[item], int(self.bound[item])
        columns = np.arange(len(words) + 2 * k + more)
        at = starts[:, None] - k + columns
        near = np.where((at >= low[:, None]) & (at < high[:, None]), flat[np.clip(at, 0, len(flat) - 1)], 0)
        known = np.zeros(len(self.number) + 1, bool)
        known[words] = True
        out = np.full(len(starts), len(words) + 1, "i4")
        some = np.flatnonzero(known[near].sum(axis=1) >= len(words) - k)
        if not len(some):
            return out
        near, slope = near[some], np.arange(len(columns) + 1, dtype="i4")
        row = np.zeros((len(some), len(columns) + 1), "i4")  # a passage may start anywhere
        for i, word in enumerate(words, 1):
            new = np.empty_like(row)
            new[:, 0] = i
            np.minimum(row[:, :-1] + (near != word), row[:, 1:] + 1, out=new[:, 1:])
            row = np.minimum.accumulate(new - slope, axis=1) + slope
        out[some] = row.min(axis=1)
        return out

    def find(self, texts: list[np.ndarray]) -> dict[tuple[int, int], int]:
        """(text, item) -> least edits found, of all within the bound."""
        gap = np.zeros(self.pad, "i4")
        flat = np.concatenate([x for t in texts for x in (t, gap)] + [gap])
        owner = np.repeat(np.arange(len(texts)), [len(t) + self.pad for t in texts])
        inside = np.concatenate([x for t in texts for x in (np.ones(len(t), bool), np.zeros(self.pad, bool))] + [np.zeros(self.pad, bool)])
        sizes = np.array([len(t) for t in texts], "i8")
        begin = np.cumsum(sizes + self.pad) - sizes - self.pad
        found: dict[tuple[int, int], int] = {}
        for starts, pieces in self.candidates(flat, inside):
            items, begins = self.whole[pieces], starts - self.offset[pieces]  # where the whole item would begin
            order = np.argsort(items, kind="stable")
            starts, items, begins = starts[order], items[order], begins[order]
            for item in np.unique(items):
                own = slice(np.searchsorted(items, item), np.searchsorted(items, item, side="right"))
                step = max(int(self.bound[item]), 1)  # neighbours are verified at once
                blocks, first = _blocks_of(begins[own] // step, owner[starts[own]])
                texts_of = owner[starts[own][first]]
                many = max(1, CELLS // int(self.sizes[item] + 3 * step))
                for a in range(0, len(blocks), many):
                    t = texts_of[a : a + many]
                    distance = self.distances(flat, blocks[a : a + many] * step, item, begin[t], begin[t] + sizes[t], step - 1)
                    hit = distance <= self.bound[item]
                    for t, d in zip(t[hit], distance[hit], strict=True):
                        key = (int(t), int(item))
                        found[key] = min(int(d), found.get(key, 1 << 30))
        return found


def _blocks_of(blocks: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct blocks of each text, and the place of one window of each."""
    order = np.lexsort((owner, blocks))
    new = np.ones(len(order), bool)
    new[1:] = (blocks[order[1:]] != blocks[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
    return blocks[order[new]], order[new]


_BENCHES: dict[str, Bench] = {}


def _bench(key: str, items: list[tuple[object, str]], edits: float, min_words: int) -> Bench:
    """This process's form of a broadcast benchmark; a worker keeps the last one from task to task."""
    if key not in _BENCHES:
        _BENCHES.clear()
        _BENCHES[key] = Bench(items, edits, min_words)
    return _BENCHES[key]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, max_items: int) -> Iterator[list[tuple[object, str]]]:
    usable = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    rows, chars = usable.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    many = max(ceil(rows / max_items), ceil(chars / MAX_CHARS))
    for k in range(many):
        part = usable if many == 1 else usable.where(F.pmod(F.xxhash64("item", "text"), F.lit(many)) == k)
        yield [(r.item, r.text) for r in part.orderBy("item", "text").collect()]


def find_passages(docs: DataFrame, benchmark: DataFrame, *, edits: float = EDITS, min_words: int = MIN_WORDS, max_items: int = MAX_ITEMS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``id, item, item_words, edits``: a row for each document and item of which it holds a passage within
    ``edits * item_words`` edits (words inserted, left out or replaced).

    Clean documents have no row.  Items of fewer than ``min_words`` words are found where they come word for word.  Null texts
    and ids, items without words, and other columns take no part; repeated documents with one id give one row an item, with
    the least edits; a very long text is searched whole.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    id_type, item_type = rows.schema["id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {id_type}, item {item_type}, item_words int, edits int"
    types = [to_arrow_type(rows.schema["id"].dataType), to_arrow_type(benchmark.schema[item_col].dataType), pa.int32(), pa.int32()]
    out = None
    for items in _blocks(benchmark, item_col, item_text_col, max_items):
        shared, key = docs.sparkSession.sparkContext.broadcast(items), uuid4().hex

        def search(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            bench = _bench(key, shared.value, edits, min_words)
            ids, texts, size = [], [], 0

            def flush() -> pa.RecordBatch:
                found = bench.find(texts) if bench.items else {}
                columns = [[ids[t] for t, _ in found], [bench.ids[i] for _, i in found], [len(bench.items[i]) for _, i in found], [*found.values()]]
                return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], ["id", "item", "item_words", "edits"])

            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids.append(doc_id), texts.append(numbers(text.as_py(), bench.number.get))
                    size += len(texts[-1]) + bench.pad
                    if size >= BLOCK_WORDS:
                        yield flush()
                        ids, texts, size = [], [], 0
            if ids:
                yield flush()

        part = rows.mapInArrow(search, schema)
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    best = out.groupBy("id", "item").agg(F.min(F.struct("edits", "item_words")).alias("best"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("best.item_words").alias("item_words"), F.col("best.edits").alias("edits"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, edits: float = EDITS, min_words: int = MIN_WORDS, max_items: int = MAX_ITEMS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has no passage of an item, as :func:`find_passages` finds them; same columns.

    Rows with a null text stay. Rows go through one at a time, so there is no join and no shuffle.
    """
    names, at = docs.columns, [c.lower() for c in docs.columns].index(text_col.lower())
    for items in _blocks(benchmark, item_col, item_text_col, max_items):
        shared, key = docs.sparkSession.sparkContext.broadcast(items), uuid4().hex

        def clean(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            bench = _bench(key, shared.value, edits, min_words)
            for batch in batches:
                keep, rows, texts, size = np.ones(batch.num_rows, bool), [], [], 0
                for row, text in enumerate(batch.column(at)):
                    if text.is_valid and bench.items:
                        rows.append(row), texts.append(numbers(text.as_py(), bench.number.get))
                        size += len(texts[-1]) + bench.pad
                    if rows and (size >= BLOCK_WORDS or row == batch.num_rows - 1):
                        keep[[rows[t] for t, _ in bench.find(texts)]] = False
                        rows, texts, size = [], [], 0
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(keep)).columns, names)

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
