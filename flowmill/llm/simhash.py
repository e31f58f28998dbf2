"""Near duplicates by SimHash fingerprints, linked through sharded BK-trees.

A text's shingles are hashed by XXH64 (seed 42); a bit of its 64-bit fingerprint is 1 if it is 1 in over half of the hashes.
Texts are linked if their fingerprints differ in at most ``radius`` bits; a document's component is what links reach.

Distinct fingerprints are few bytes each, and only these are compared.  The bits are cut into blocks; of two fingerprints
within the radius, some ``blocks - radius`` blocks are equal, so shards of the fingerprints that agree in so many blocks
hold every linked pair.  Each task builds a BK-tree of a shard (children keyed by Hamming distance to the parent) and runs all
its members through it, following only edges within the radius.  Of a shard's links, a spanning forest is kept.  The trees
hold the fingerprints of all documents, which must not go through the driver, so each is built where its queries are and
none is broadcast.

:mod:`flowmill.llm.similar` goes on from there to exact similarity of shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import cut, fresh
from flowmill.llm.components import components

SHINGLE, RADIUS, SEED = 4, 4, 42

#: A shard of more fingerprints is split by blocks of its other bits, as often as that makes shards smaller, LEVELS times at most.
MAX_SHARD, LEVELS = 20_000, 3

#: Keys of rows that may be broadcast (16 bytes each); more are joined by a shuffle.
MAX_BROADCAST_KEYS = 1_000_000

#: A leaf of a tree: so many members are compared at once.
LEAF = 32

QUERIES, PAIRS, HASHES = 2048, 1 << 20, 1 << 18


def shingle_hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """The hashes of a UTF-8 text's shingles in order, repeats included, in parts: ASCII letters in lower case, words at ASCII
    white space; all words as one shingle, if they are fewer.
    """
    words = text.lower().split()
    joined = b" ".join(words)
    ends = [*accumulate(len(w) + 1 for w in words)]
    width = min(shingle, len(words))
    starts, stops = [0, *ends[: len(words) - width]][: len(words)], ends[width - 1 :] if words else []
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(stops), HASHES):
        spans = zip(starts[at : at + HASHES], stops[at : at + HASHES], strict=True)
        yield np.array([digest(joined[a : b - 1], SEED) for a, b in spans], "<u8")


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The hashes of a text's distinct shingles, sorted."""
    return np.unique(np.concatenate([np.zeros(0, "u8"), *shingle_hashes(text, shingle)]))


def majority(hashes: Iterable[np.ndarray]) -> int:
    """The bits that are 1 in over half of all hashes, as a signed number; 0 without hashes."""
    ones, total = np.zeros(64, "i8"), 0
    for whole in hashes:
        for at in range(0, len(whole), HASHES):
            part = whole[at : at + HASHES]
            ones += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
            total += len(part)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text, as a signed number; 0 without words."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_hash, fp`` (fp as a signed long) of every row; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], ["id", "text_hash", "fp"])

    return rows.mapInArrow(compute, f"id {id_type}, text_hash long, fp long")


class BKTree:
    """A BK-tree of distinct fingerprints; subtrees of at most ``leaf`` members are kept as arrays."""

    __slots__ = ("children", "key", "leaf")

    def __init__(self, members: np.ndarray, fps: np.ndarray, leaf: int = LEAF) -> None:
        self.leaf, self.children, self.key = None, [], -1
        if len(members) <= leaf:
            self.leaf = members
            return
        self.key, rest = int(members[0]), members[1:]
        distance = np.bitwise_count(fps[rest] ^ fps[self.key])
        order = np.argsort(distance, kind="stable")
        values, starts = np.unique(distance[order], return_index=True)
        for value, part in zip(values.tolist(), np.split(rest[order], starts[1:]), strict=True):
            self.children.append((value, BKTree(part, fps, leaf)))

    def near(self, queries: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, members) within the radius, node by node."""
        stack = [(self, queries)]
        while stack:
            node, asked = stack.pop()
            if node.leaf is not None:
                q, m = np.nonzero(np.bitwise_count(fps[asked][:, None] ^ fps[node.leaf][None, :]) <= radius)
                if len(q):
                    yield asked[q], node.leaf[m]
                continue
            distance = np.bitwise_count(fps[asked] ^ fps[node.key]).astype("i2")
            if (hit := distance <= radius).any():
                yield asked[hit], np.full(int(hit.sum()), node.key)
            for value, child in node.children:
                if len(some := asked[np.abs(distance - value) <= radius]):
                    stack.append((child, some))


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the labels of linked pairs, in place, to the least of each component."""
    while True:
        la, lb = labels[a], labels[b]
        if not (apart := la != lb).any():
            return
        np.minimum.at(labels, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while not np.array_equal(labels, jumped := labels[labels]):
            labels[:] = jumped


def forest(fps: np.ndarray, radius: int, asking: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, its component's first) that connect what is within the radius among these fingerprints; of the
    pairs with one at the places ``asking``, if these are given.
    """
    labels, tree = np.arange(len(fps)), BKTree(np.arange(len(fps)), fps)
    asking = labels.copy() if asking is None else asking
    for at in range(0, len(asking), QUERIES):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for pair in tree.near(asking[at : at + QUERIES], fps, radius):
            held.append(pair)
            if (size := size + len(pair[0])) >= PAIRS:
                _join(labels, *map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if held:
            _join(labels, *map(np.concatenate, zip(*held, strict=True)))
    linked = np.flatnonzero(labels != np.arange(len(fps)))
    return fps[linked], fps[labels[linked]]


def _blocks(bits: list[int], many: int) -> list[int]:
    """The bits cut into ``many`` masks of nearly equal size."""
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), many)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(count: int, radius: int) -> list[int]:
    """Masks of the bits that shards agree in: 13 bits for up to 16 million fingerprints (of radius 4), more for more."""
    more = 0 if count <= 1 << 24 else 1 if count <= 1 << 32 else 2
    blocks = _blocks(list(range(64)), radius + 1 + more)
    return [sum(x) for x in combinations(blocks, 1 + more)]


def sharded(fps: DataFrame, masks: list[int], inner: Callable[[int], list[int]], max_shard: int) -> DataFrame:
    """The rows of ``fps`` once for each mask, with ``mask, bits, block, asks``: the mask's place and the bits of fp under it.

    Where more than ``max_shard`` agree in these, they must also agree in those of one of the ``inner`` masks of the other bits,
    if that leaves less to compare; and so on, up to LEVELS times.  What is too large even then (fingerprints of a dense ball
    agree in nearly all bits, however they are split) is cut into parts, and each pair of parts is a block, in which the rows of the
    first one ask (1, else 0): no task holds more than two parts.
    """
    names, masks, at = fps.columns, list(masks), 0

    def key(k: int) -> Column:
        return F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(masks[k]))).alias("bits"))

    keyed = fps.select("*", F.explode(F.array(*map(key, range(len(masks))))).alias("key")).select(*names, "key.mask", "key.bits")
    for _ in range(LEVELS):
        hot = cut(keyed.where(F.col("mask") >= at).groupBy("mask", "bits").count().where(F.col("count") > max_shard))
        full = sorted(r["mask"] for r in hot.select("mask").distinct().collect())  # at most one row a mask
        at, split = len(masks), F.lit(None).cast("array<struct<mask:int,bits:bigint>>")
        for k in full:
            first = len(masks)
            masks += [masks[k] | x for x in inner(masks[k])]
            if len(masks) > first:
                split = F.when(F.col("mask") == k, F.array(*map(key, range(first, len(masks))))).otherwise(split)
        if len(masks) == at:
            break
        parts = keyed.join(hot, ["mask", "bits"]).select("mask", "bits", "count", F.explode(split).alias("key")).groupBy("mask", "bits", "count", "key").agg(F.count("*").cast("double").alias("n"))
        parts = parts.groupBy("mask", "bits", "count").agg(F.sum(F.col("n") * F.col("n")).alias("work"))
        cheaper = cut(parts.where(F.col("work") < F.col("count").cast("double") * F.col("count")).select("mask", "bits", F.lit(True).alias("hot")))
        joined = keyed.join(cheaper, ["mask", "bits"], "left")
        keyed = joined.select(*names, F.explode(F.when(F.col("hot"), split).otherwise(F.array(F.struct("mask", "bits")))).alias("key")).select(*names, "key.mask", "key.bits")
    large = cut(keyed.groupBy("mask", "bits").count().where(F.col("count") > max_shard).select("mask", "bits", F.ceil(F.col("count") / max_shard).cast("int").alias("blocks")))
    if large.isEmpty():
        return keyed.select("*", F.lit(0).alias("block"), F.lit(1).alias("asks"))
    dealt = keyed.join(large, ["mask", "bits"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), "blocks").cast("int")
    met = dealt.select(*keyed.columns, "blocks", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    low, high = F.least("own", "with"), F.greatest("own", "with")
    return met.select(*keyed.columns, (low * F.col("blocks") + high).alias("block"), (F.col("own") == low).cast("int").alias("asks"))


def others(mask: int) -> list[int]:
    return [b for b in range(64) if not mask >> b & 1]


def links(fps: DataFrame, *, radius: int = RADIUS, max_shard: int = MAX_SHARD) -> DataFrame:
    """``a, b``: links that connect all fingerprints (column fp, distinct longs) within the radius of each other."""
    if not 0 <= radius < 60:
        raise ValueError("the radius must be from 0 to 59")
    keyed = sharded(fps.select("fp"), _masks(fps.count(), radius), lambda m: _blocks(others(m), radius + 1) if len(others(m)) > radius else [], max_shard)
    return search_shards(keyed, ["fp"], lambda own, asking: forest(own[:, 0], radius, asking))


def search_shards(keyed: DataFrame, names: list[str], find: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``a, b``: the pairs that ``find`` gives of each shard's rows: the columns ``names``, longs, which it gets as unsigned
    numbers, and the places of the rows that ask.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, ends in whole_groups(batches, 3):
            a, b = [], []
            for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
                x, y = find(np.asfortranarray(rows[s:e, 4:].view("u8")), np.flatnonzero(rows[s:e, 3]))
                if len(x):
                    a.append(x.view("i8")), b.append(y.view("i8"))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    key = ["mask", "bits", "block"]
    shards = keyed.select(*key, "asks", *names).repartition(*key).sortWithinPartitions(*key, *names)
    return shards.mapInArrow(search, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of longs, sorted by the first ``keys`` columns, in parts that hold whole groups of these; the groups' starts and ends."""
    held: list[np.ndarray] = []
    for batch in with_end(batches):
        if batch is not None:
            if not batch.num_rows:
                continue
            new = np.stack([np.asarray(c).astype("i8") for c in batch.columns], axis=1)
            if held and (new[-1, :keys] == held[0][0, :keys]).all():  # one group all through
                held.append(new)
                continue
            held.append(new)
        if not held:
            return
        rows = np.concatenate(held)
        cuts = np.flatnonzero((rows[1:, :keys] != rows[:-1, :keys]).any(axis=1)) + 1
        starts, ends = np.concatenate([[0], cuts]).astype("i8"), np.concatenate([cuts, [len(rows)]]).astype("i8")
        if batch is not None:  # the last group may go on
            held, starts, ends = [rows[starts[-1] :]], starts[:-1], ends[:-1]
        if len(starts):
            yield rows[: ends[-1]], starts, ends


def with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def with_kept(rows: DataFrame, nodes: DataFrame, found: DataFrame, *, carried: str = "fp") -> DataFrame:
    """``rows`` (node, id, text_hash and one column more) with keep_id and keep_hash, of ``nodes`` (key columns node, first) and the components found among them."""
    members = nodes.join(found.select("node", "root"), "node")
    roots = members.groupBy("root").agg(F.min("first").alias("first"))
    merged = members.select("node", "root").join(roots, "root").select(F.col("node").alias("linked"), F.col("first").alias("of_all"))
    kept = nodes.join(merged, F.col("node") == F.col("linked"), "left").select(F.col("node").alias("k"), F.coalesce("of_all", "first").alias("first"))
    # Both sides are plain tables here, so that Spark can split the join where one fingerprint has very many rows.
    kept = cut(kept)
    return rows.join(kept, F.col("node") == F.col("k")).select("id", "text_hash", carried, F.col("first.id").alias("keep_id"), F.col("first.text_hash").alias("keep_hash"))


def first_row() -> Column:
    return F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("first")


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS, max_shard: int = MAX_SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_hash, fp, keep_id, keep_hash`` of every row: keep_id is the smallest id in the row's component.

    Ids that are null come last in that order (keep_id is null if all are); keep_hash is the least text hash of that id's
    rows in the component.  Rows without words share the fingerprint 0 and are linked like any other.
    """
    rows = cut(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col))
    per_fp = cut(rows.groupBy(F.col("fp").alias("node")).agg(first_row()))
    found = cut(components(links(per_fp.select(F.col("node").alias("fp")), radius=radius, max_shard=max_shard)))
    return with_kept(rows.withColumn("node", F.col("fp")), per_fp, found)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, groups: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component in ``groups`` (of :func:`near_duplicates` or
    :func:`flowmill.llm.similar.similar_documents`): of the smallest id (null last), then of the least text hash; same columns.

    The keys of dropped rows go to the rows where they are few enough to be broadcast; else both are shuffled.
    """
    text_hash = fresh(docs, "text_hash")
    own = docs.withColumn(text_hash, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    stays = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("text_hash") == F.col("keep_hash"))
    keys = groups.groupBy(F.col("id").alias("drop_id"), F.col("text_hash").alias("drop_hash")).agg(F.first(stays).alias("stays"), F.count("*").alias("rows"))
    keys = cut(keys.where("not stays or rows > 1"))  # rows of one id and text are in one component: all of these stay or none
    same = F.col(id_col).eqNullSafe(F.col("drop_id")) & (F.col(text_hash) == F.col("drop_hash"))

    def bounded(part: DataFrame) -> DataFrame:
        return F.broadcast(part) if part.count() <= MAX_BROADCAST_KEYS else part

    stay = own.join(bounded(keys.where("not stays")), same, "left_anti")
    repeated = keys.where("stays")
    if not repeated.isEmpty():  # any one of the rows of one id and text
        repeated = bounded(repeated)
        stay = stay.join(repeated, same, "left_anti").unionAll(stay.join(repeated, same, "left_semi").dropDuplicates([id_col, text_hash]))
    return stay.select(*[F.col(f"`{c}`") for c in docs.columns])
