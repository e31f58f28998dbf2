"""Exact Jaccard join of shingle sets that skips by the relations of sets: in its index lists, and in its answers.

The index has a list for each shingle: the sets that have it in their prefix (the rarest shingles; two sets that are similar
enough share one there).  A list is cut into blocks of one size and one position.  Whether two sets of given sizes can still be
similar enough when they first meet at given positions is the same for all of a block, so blocks are held against blocks and
whole ones are skipped; so are blocks whose sets are all in one component already.

Answers come from those of highly similar sets first (:mod:`flowmill.llm.stars`): a set is compared with the leader of its lists, and
members of a star by their differences from the leader.  What the lists still give, after that, are pairs of different
components and different stars; sketches rule most of them out, and the rest is compared text with text.  Every pair is either
decided or already connected, so components are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import cut, slices
from flowmill.llm.components import components
from flowmill.llm.shingle_sets import BUCKETS, MAX_TOKEN_ROWS, SKETCH, SKETCH_BITS, bucket_counts, compared, dealt, large_apart, large_sketch, least_shared, of_several_groups, possible, prefixes, sketch
from flowmill.llm.simhash import PAIRS, first_row, shingle_set, whole_groups, with_kept
from flowmill.llm.stars import differences, followed, leaders, star_links

SHINGLE, SIMILARITY = 4, 0.85

#: A set is compared with a leader where sketches say that they differ in at most so much of both. This changes the work only.
LIKELY = 0.42

#: Most rounds in which components are joined by pairs of nearest entries, before all pairs are looked at, and what share of the
#: first round's links another round must bring for the next one. These change the work only.
ROUNDS, WORTH = 4, 0.1


def described(docs: DataFrame, *, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_hash, size`` and the sketches of every row's set; and rows ``bucket, n`` alone (see :func:`~flowmill.llm.similar.profiles`)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    longs = ["text_hash", "size", *SKETCH, "bucket", "n"]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, id_type = np.zeros(BUCKETS, "i8"), None
        for batch in slices(batches):
            id_type, out, bins = batch.column(0).type, np.zeros((batch.num_rows, 1 + len(SKETCH)), "i8"), []
            for k, text in enumerate(batch.column(2)):
                own = shingle_set(text.as_py(), shingle)
                np.add.at(counts, (own % np.uint64(BUCKETS)).astype("i8"), 1)
                out[k] = len(own), *sketch(own)
                bins.append(large_sketch(own))
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out.T.copy()), none, none, pa.array(bins, pa.binary())], ["id", *longs, "bins"])
        if id_type is not None:
            often = np.flatnonzero(counts > 8 + 2 * counts.mean())
            none = pa.nulls(len(often), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(often), id_type), *[none] * (2 + len(SKETCH)), pa.array(often), pa.array(counts[often]), pa.nulls(len(often), pa.binary())], ["id", *longs, "bins"])

    return rows.mapInArrow(compute, f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{x} long" for x in longs) + ", bins binary")


def block_meetings(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs that meet in a list and may be similar, of different groups and stars, block by block.

    ``rows``: size (see :func:`~flowmill.llm.shingle_sets.prefixes`), node, group, star and the sketch, sorted by size in each list.
    """
    packed, group, star, bins = rows[:, 0], rows[:, 2], rows[:, 3], np.ascontiguousarray(rows[:, 4:]).view("u8")
    in_list = np.repeat(np.arange(len(starts)), ends - starts)
    new = np.ones(len(rows), bool)
    new[1:] = (packed[1:] != packed[:-1]) | (in_list[1:] != in_list[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(rows)))
    size, left, of = packed[first] >> 32, packed[first] & 0xFFFFFFFF, in_list[first]
    low, high, low_star, high_star = (f.reduceat(x, first) for x in (group, star) for f in (np.minimum, np.maximum))
    at, step = np.arange(len(first)), 0
    while len(at):
        at = at[at + step < len(first)]
        at = at[of[at] == of[at + step]]
        least = least_shared(size[at] + size[at + step], similarity)
        near = least <= size[at]  # sizes rise: what is too large stays so
        at, least = at[near], least[near]
        to = at + step
        known = (np.minimum(low[at], low[to]) == np.maximum(high[at], high[to])) | (np.minimum(low_star[at], low_star[to]) == np.maximum(high_star[at], high_star[to]))
        some = at[(np.minimum(left[at], left[to]) >= least) & ~known]
        ends_at = np.cumsum(count[some] * count[some + step])
        for begin in range(0, int(ends_at[-1]) if len(some) else 0, PAIRS):
            pair = np.arange(begin, min(begin + PAIRS, int(ends_at[-1])))
            k = np.searchsorted(ends_at, pair, "right")
            a, b = some[k], some[k] + step
            offset = pair - (ends_at[k] - count[a] * count[b])
            x, y = first[a] + offset // count[b], first[b] + offset % count[b]
            apart = (x < y) & (group[x] != group[y]) & (star[x] != star[y])
            x, y = x[apart], y[apart]
            both = (packed[x] >> 32) + (packed[y] >> 32)
            may = np.bitwise_count(bins[x] ^ bins[y]).sum(axis=1, dtype="i8") <= both - 2 * least_shared(both, similarity)
            if may.any():
                yield x[may], y[may]
        step += 1


def meetings(rows: DataFrame, similarity: float, found: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``found`` makes of each part of lists of ``rows``: these as numbers (key, size, node, group, star), and places x, y of pairs that
    meet and may be similar by all sketches, with the bins in which they differ, a share of what similar ones may.
    """
    key = ["token", "part", "with_part"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, starts, ends, bins in _with_bins(batches, 3):
            drawn = np.ascontiguousarray(own[:, 7:]).view("u8")

            def pairs(own=own, starts=starts, ends=ends, bins=bins, drawn=drawn) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                for x, y in block_meetings(own[:, 3:], starts, ends, similarity):
                    both = (own[x, 3] >> 32) + (own[y, 3] >> 32)
                    most = both - 2 * least_shared(both, similarity)
                    off = np.maximum(np.bitwise_count(drawn[x] ^ drawn[y]).sum(axis=1, dtype="i8"), large_apart(bins, x, y))
                    may = off <= most
                    if may.any():
                        yield x[may], y[may], off[may] / (most[may] + 1)

            yield from found(own, pairs())

    columns = [*key, "size", "node", "group", "star", *SKETCH, "bins"]
    return rows.select(columns).repartition(*key).sortWithinPartitions(*key, "size", "node").mapInArrow(search, schema)


def _with_bins(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """:func:`~flowmill.llm.simhash.whole_groups` of rows of longs whose last column is binary, and this column of each part."""
    held: list[tuple[int, pa.Array]] = []

    def numbered() -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            held.append((at, batch.columns[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.arange(at, at + batch.num_rows))], batch.schema.names)
            at += batch.num_rows

    for own, starts, ends in whole_groups(numbered(), keys):
        first = int(own[0, -1])
        while len(held) > 1 and held[1][0] <= first:
            held.pop(0)
        yield np.ascontiguousarray(own[:, :-1]), starts, ends, pa.concat_arrays([x for _, x in held]).slice(first - held[0][0], len(own))


def described_entries(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """The entries of ``shared`` with group, star and sketches of their nodes; without ``bins`` in ``groups``, large sets have no longer sketch."""
    return shared.join(groups if "bins" in groups.columns else groups.withColumn("bins", F.lit(None).cast("binary")), "node")


def block_pairs(shared: DataFrame, groups: DataFrame, *, similarity: float) -> DataFrame:
    """``a, b``: pairs that meet in a list of ``shared`` (:func:`~flowmill.llm.shingle_sets.dealt`) and may be similar; ``groups`` has
    node, group, star and sketches of every node.
    """

    def found(own: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        node = own[:, 4]
        for x, y, _ in pairs:
            ends = np.unique(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in ends], ["a", "b"])

    return meetings(described_entries(shared, groups), similarity, found, "a long, b long").where("a != b").distinct()


def nearest_entries(shared: DataFrame, groups: DataFrame, *, similarity: float) -> DataFrame:
    """The entries of ``shared`` that are in one of :func:`block_pairs`' pairs, with ``partner``: the node of their list that is nearest by sketches
    among those. So what is written is no more than the entries.
    """
    names = ["token", "part", "with_part", "size", "node", "partner"]

    def found(own: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        partner, least = np.full(len(own), -1), np.full(len(own), np.inf)
        for x, y, off in pairs:
            for at, to in ((x, y), (y, x)):
                nearer = np.flatnonzero(off < least[at])
                nearer = nearer[np.argsort(-off[nearer], kind="stable")]  # of several, the last counts
                partner[at[nearer]], least[at[nearer]] = to[nearer], off[nearer]
        some = np.flatnonzero(partner >= 0)
        yield pa.RecordBatch.from_arrays([*map(pa.array, own[some, :5].T.copy()), pa.array(own[partner[some], 4])], names)

    return meetings(described_entries(shared, groups), similarity, found, ", ".join(f"{x} long" for x in names))


def star_answers(shared: DataFrame, nodes: DataFrame, texts: DataFrame, *, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``a, b`` of links found in stars; ``a, b`` of all pairs compared with a leader; ``node, star``: sets of one star are decided.

    ``nodes``: node, id and sketch.  A leader whose sketch says that too little is shared isn't compared.
    """
    pairs = leaders(shared, similarity=similarity)
    sizes = shared.groupBy("node").agg(F.max(F.shiftright("size", 32)).alias("size"))
    drawn = cut(nodes.select("node", *SKETCH).join(sizes, "node"))
    for side in ("node", "leader"):
        pairs = pairs.join(drawn.select(F.col("node").alias(side), F.col("size").alias(f"{side}_size"), *[F.col(x).alias(f"{side}_{x}") for x in SKETCH]), side)
    bits = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"node_{x}").bitwiseXOR(F.col(f"leader_{x}"))) for x in SKETCH])
    filled = F.least(F.lit(2.0) * bits / SKETCH_BITS, F.lit(0.98))  # of so many odd bins; nearer to 1, this says nothing of long sets
    about = F.lit(-SKETCH_BITS / 2) * F.log(F.lit(1.0) - filled)
    pairs = pairs.where(about <= LIKELY * (F.col("node_size") + F.col("leader_size")) + 8).select("leader", "node")
    told = cut(differences(pairs, nodes.select("node", "id"), texts, shingle=shingle, similarity=similarity))
    ends = followed(told, similarity=similarity)
    ordered = [F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")]
    known = cut(told.select(*ordered, "linked").unionAll(ends.select(*ordered, "linked")).distinct())
    links = cut(known.where("linked = 1").select("a", "b").unionAll(star_links(ends, similarity=similarity)).distinct())
    return links, known.select("a", "b"), ends.select("node", F.col("leader").alias("star"))


def settled(shared: DataFrame, nodes: DataFrame, stars: DataFrame, links: DataFrame, tested: DataFrame, texts: DataFrame, *, shingle: int, similarity: float, max_token_rows: int) -> DataFrame:
    """``node, root``: components of ``links`` and of all further ones that the lists hold. ``nodes``: node, id and sketches; ``tested``: a, b.

    What is similar to very many sets is joined first, in some rounds: every entry of a list has its nearest one of another component, and of
    two components the pair that is so most often is compared.  Entries that may be similar to none are left out from then on.  Then every
    pair that is still apart is compared.
    """
    of_nodes = nodes.select("node", "id")

    def compare(pairs: DataFrame) -> DataFrame:
        return compared(possible(pairs, of_nodes, texts, shingle=shingle, similarity=similarity), of_nodes, texts, shingle=shingle, similarity=similarity)

    def between(pairs: DataFrame, found: DataFrame) -> DataFrame:
        """``pairs`` of different components, with these as x and y."""
        ends = [found.select(F.col("node").alias(n), F.col("root").alias(f"root_{n}")) for n in "ab"]
        named = pairs.join(ends[0], "a", "left").join(ends[1], "b", "left").select(*pairs.columns, F.coalesce("root_a", "a").alias("p"), F.coalesce("root_b", "b").alias("q"))
        return named.where("p != q").select(*pairs.columns, F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"))

    def one_each(pairs: DataFrame, votes: Column) -> DataFrame:
        return cut(pairs.groupBy("x", "y").agg(F.max(F.struct(votes.alias("votes"), "a", "b")).alias("best")).select("best.a", "best.b"))

    found, brought, first_brought = cut(components(links)), 1, 1
    entries = dealt(cut(of_several_groups(shared, found)), max_token_rows)
    for turn in range(ROUNDS + 1):
        groups = nodes.join(found, "node", "left").join(stars, "node", "left")
        groups = cut(groups.select("node", F.coalesce("root", "node").alias("group"), F.coalesce("star", "node").alias("star"), *SKETCH, "bins"))
        if turn == ROUNDS or brought < WORTH * first_brought:
            break
        met = cut(nearest_entries(entries, groups, similarity=similarity))
        entries = met.drop("partner")  # what meets nothing now never will: components only grow
        near = met.groupBy(F.least("node", "partner").alias("a"), F.greatest("node", "partner").alias("b")).agg(F.count("*").alias("votes"))
        some = one_each(between(near.join(tested, ["a", "b"], "left_anti"), found), F.col("votes"))
        if some.isEmpty():
            break
        new = compare(some)
        brought = new.count()
        first_brought = first_brought if turn else max(1, brought)
        links, tested = links.unionAll(new), tested.unionAll(some)
        found = cut(components(links))
    more = cut(block_pairs(entries, groups, similarity=similarity).join(tested, ["a", "b"], "left_anti"))
    first = one_each(between(more, found), F.lit(1))
    links = links.unionAll(compare(first))
    found = cut(components(links))
    rest = cut(between(more, found).select("a", "b").join(first, ["a", "b"], "left_anti"))
    return cut(components(links.unionAll(compare(rest))))


def jaccard_join(docs: DataFrame, *, shingle: int = SHINGLE, similarity: float = SIMILARITY, max_token_rows: int = MAX_TOKEN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_hash, size, keep_id`` of every row: the number of its distinct shingles, and the smallest id reachable by links.

    Texts link where their sets have a Jaccard coefficient of at least ``similarity``.  A text of fewer words than a shingle is one
    shingle; null texts and those without words have none, and are linked with nothing (keep_id is their own).  Ids that are null come
    last (keep_id is null if all are).  Equal texts are one set; sets and shingles are told apart by 64-bit hashes.
    """
    if not 0 < similarity <= 1:
        raise ValueError("the similarity must be over 0 and at most 1")
    found_rows = cut(described(docs, shingle=shingle, id_col=id_col, text_col=text_col))
    rows = found_rows.where("text_hash is not null").drop("bucket", "n")
    nodes = cut(rows.where("size > 0").groupBy(F.col("text_hash").alias("node")).agg(first_row(), *[F.min(x).alias(x) for x in (*SKETCH, "bins")]))
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("utf8"))
    worded = texts.where(F.col("utf8").cast("string").rlike(r"[^\x20\x09-\x0D]"))
    shared = cut(prefixes(worded, bucket_counts(found_rows), shingle=shingle, similarity=similarity))
    known = nodes.select("node", F.col("first.id").alias("id"), *SKETCH, "bins")
    links, tested, stars = star_answers(shared, known, texts, shingle=shingle, similarity=similarity)
    found = settled(shared, known, stars, links, tested, texts, shingle=shingle, similarity=similarity, max_token_rows=max_token_rows)
    own = rows.select("id", "text_hash", "size", F.col("text_hash").alias("node"))
    joined = with_kept(own.where("size > 0"), nodes.select("node", "first"), found, carried="size").drop("keep_hash")
    return joined.unionAll(own.where("size = 0").select("id", "text_hash", "size", F.col("id")))
