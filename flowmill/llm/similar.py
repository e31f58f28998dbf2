"""Near duplicates by the Jaccard coefficient of shingle sets, behind SimHash fingerprints.

Texts have two independent fingerprints of their distinct shingles.  BK-trees of shards that agree in sampled bits (see
:mod:`flowmill.llm.simhash`) give pairs that differ in few bits, of each shard the nearest that connect it, and the exact
coefficient of each such pair decides.  That joins most copies at about one comparison a text.

No radius finds all pairs of a coefficient, so the rest is found exactly.  Of two sets with a coefficient of t, each has a shingle
of the other among its first n - ceil(t n) + 1 in any order that both share (prefix filter), and at the first shared one enough
shingles of both must be left (positional filter).  The order is by frequency, rare ones first, so boilerplate comes last.  What
meets in such lists is first answered by stars (:mod:`flowmill.llm.stars`): each text against the leader of its lists, and
texts of one leader by their differences from it, so that many texts of one template, near ``t`` or not, cost one comparison
of whole texts each.  Pairs of different components and stars are left to blocks of the lists (:mod:`flowmill.llm.set_join`) and to
sketches, the parities of how many shingles fall in each bin: these differ in at most as many bins as the sets do in shingles,
so this bound loses nothing either.  What passes is verified by the exact coefficient.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import cut, slices
from flowmill.llm.components import components
from flowmill.llm.set_join import settled, star_answers
from flowmill.llm.shingle_sets import BUCKETS, MAX_TOKEN_ROWS, SKETCH, bucket_counts, compared, large_sketch, nonempty_set, of_several_groups, prefixes, sketch
from flowmill.llm.simhash import MAX_SHARD, PAIRS, QUERIES, BKTree, first_row, majority, others, search_shards, sharded, with_kept
from flowmill.llm.text import mix

#: The shingle, the coefficient; the radius of the fingerprints that are compared first, and with what probability a pair that
#: differs in all of it meets in some shard.  The last two change the time, not what is found.
SHINGLE, SIMILARITY, RADIUS, RECALL = 5, 0.8, 7, 0.9

#: Members of a leaf: at a wide radius few edges can be left out, and larger leaves are compared at once.
LEAF = 128


def profiles(docs: DataFrame, *, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_hash, fp, fp2`` and the sketches of every row; and rows ``bucket, n`` alone: how often the shingles of each bucket
    come, about (buckets that are rare in a task count 0 there).  Texts without words are alike: they have one shingle, 0.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    longs = ["text_hash", "fp", "fp2", *SKETCH, "bucket", "n"]
    schema = f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{x} long" for x in longs) + ", bins binary"

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, id_type = np.zeros(BUCKETS, "i8"), None
        for batch in slices(batches):
            id_type, out, bins = batch.column(0).type, np.zeros((batch.num_rows, 2 + len(SKETCH)), "i8"), []
            for k, text in enumerate(batch.column(2)):
                own = nonempty_set(text.as_py(), shingle)
                np.add.at(counts, (own % np.uint64(BUCKETS)).astype("i8"), 1)
                out[k] = majority([own]), majority([mix(own)]), *sketch(own)
                bins.append(large_sketch(own))
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out.T.copy()), none, none, pa.array(bins, pa.binary())], ["id", *longs, "bins"])
        if id_type is not None:
            often = np.flatnonzero(counts > 8 + 2 * counts.mean())
            none = pa.nulls(len(often), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(often), id_type), *[none] * (3 + len(SKETCH)), pa.array(often), pa.array(counts[often]), pa.nulls(len(often), pa.binary())], ["id", *longs, "bins"])

    return rows.mapInArrow(compute, schema)


def sampled_masks(bits: int, among: list[int], *, near: int = RADIUS, recall: float = RECALL, seed: int = 20_010) -> list[int]:
    """Masks of ``bits`` randomly sampled bits of ``among``, as many as the recall of what differs in ``near`` of these asks for;
    none where there are too few bits.
    """
    if len(among) < near + bits:
        return []
    met = comb(len(among) - near, bits) / comb(len(among), bits)
    rng = np.random.default_rng(seed)
    return [sum(1 << int(b) for b in rng.choice(among, bits, replace=False)) for _ in range(ceil(log(1 - recall) / log(1 - met)))]


def close_pairs(fps: np.ndarray, radius: int, other: np.ndarray, name: np.ndarray, asking: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (places in ``fps``) within the radius, one of them asking, that connect all such: a spanning forest, nearest pairs first.

    ``fps`` and ``other`` together tell what is nearer, and then the names, so that every shard with the same pairs takes the same ones.
    """
    places = np.arange(len(fps))
    labels, tree, out = places.copy(), BKTree(places, fps, LEAF), []

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> None:
        a, b = map(np.concatenate, zip(*held, strict=True))
        low, high = np.minimum(name[a], name[b]), np.maximum(name[a], name[b])
        order = np.lexsort((high, low, np.bitwise_count(fps[a] ^ fps[b]) + np.bitwise_count(other[a] ^ other[b])))
        pick = _spanning(labels, a[order], b[order])
        out.append((a[order][pick], b[order][pick]))

    held, size = [], 0
    for at in range(0, len(asking), QUERIES):
        for a, b in tree.near(asking[at : at + QUERIES], fps, radius):
            if (apart := labels[a] != labels[b]).any():
                held.append((a[apart], b[apart]))
                if (size := size + int(apart.sum())) >= PAIRS:
                    flush(held)
                    held, size = [], 0
    if held:
        flush(held)
    a, b = map(np.concatenate, zip(*out, strict=True)) if out else (places[:0], places[:0])
    return a, b


def _spanning(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of pairs that connect what all of them connect, earlier pairs first; ``labels`` are merged in place."""
    chosen, left, step = [np.zeros(0, "i8")], np.arange(len(a)), max(1024, 2 * len(labels))
    while len(left):
        part = left[:step]
        la, lb = labels[a[part]], labels[b[part]]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        _, first = np.unique(low * len(labels) + high, return_index=True)
        parent: dict[int, int] = {}
        for at in np.sort(first).tolist():
            x, y = _root(parent, int(low[at])), _root(parent, int(high[at]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                chosen.append(part[at : at + 1])
        if parent:
            table = np.arange(len(labels))
            table[list(parent)] = [_root(parent, x) for x in list(parent)]
            labels[:] = table[labels]
        left = left[step:]
        left = left[labels[a[left]] != labels[b[left]]]  # in a dense shard the first parts connect nearly all
    return np.concatenate(chosen)


def _root(parent: dict[int, int], x: int) -> int:
    while (up := parent.get(x, x)) != x:
        parent[x] = x = parent.get(up, up)
    return x


def close_links(nodes: DataFrame, *, radius: int = RADIUS, max_shard: int = MAX_SHARD) -> DataFrame:
    """``a, b``: names of pairs within the radius (see :func:`close_pairs`) of ``nodes``: fp, other, name, all longs.

    Shards agree in 8 sampled bits, in more where these would leave over about 1,000 in a shard of evenly spread fingerprints.
    """
    bits = min(32, max(8, round(log(max(nodes.count(), 2), 2)) - 10))
    masks = sampled_masks(bits, list(range(64)), near=radius)
    keyed = sharded(nodes, masks, lambda m: sampled_masks(6, others(m), near=radius), max_shard)

    def find(own: np.ndarray, asking: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fps, other, name = own.T
        a, b = close_pairs(fps, radius, other, name, asking)
        return name[a], name[b]

    return search_shards(keyed, ["fp", "other", "name"], find)


def similar_documents(docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS, similarity: float = SIMILARITY, max_token_rows: int = MAX_TOKEN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_hash, fp, keep_id, keep_hash`` of every row, as :func:`flowmill.llm.simhash.near_duplicates`, with texts linked by
    a Jaccard coefficient of at least ``similarity`` over their shingles.

    Exact: a link is never false, and none is missed.  Texts are told apart by their 64-bit hashes, so equal texts are compared
    once.  Null texts count as empty; texts without words are alike; ids that are null come last.
    """
    if not 0 < similarity <= 1:
        raise ValueError("the similarity must be over 0 and at most 1")
    found_rows = cut(profiles(docs, shingle=shingle, id_col=id_col, text_col=text_col))
    rows = found_rows.where("text_hash is not null").drop("bucket", "n")
    nodes = cut(rows.groupBy(F.col("text_hash").alias("node")).agg(first_row(), *[F.min(x).alias(x) for x in ("fp", "fp2", *SKETCH, "bins")]))
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("utf8"))
    of_nodes = nodes.select("node", F.col("first.id").alias("id"))

    def close() -> DataFrame:
        out = None
        for fp, other in (("fp", "fp2"), ("fp2", "fp")):
            # Texts of one fingerprint are compared with one of them, which meets the others' in the shards.
            per_fp = cut(nodes.groupBy(F.col(fp).alias("of")).agg(F.min(F.struct("node", F.col(other).alias("other"))).alias("x")))
            equal = nodes.select("node", F.col(fp).alias("of")).join(per_fp, "of").where(F.col("node") != F.col("x.node"))
            met = close_links(per_fp.select(F.col("of").alias("fp"), "x.other", F.col("x.node").alias("name")), radius=radius)
            found = met.unionAll(equal.select(F.least("node", "x.node").alias("a"), F.greatest("node", "x.node").alias("b")))
            out = found if out is None else out.unionAll(found)
        return cut(out.distinct())

    tested = close()
    sure = compared(tested, of_nodes, texts, shingle=shingle, similarity=similarity)
    found = cut(components(sure))
    shared = cut(of_several_groups(prefixes(texts, bucket_counts(found_rows), shingle=shingle, similarity=similarity), found))
    known = nodes.select("node", F.col("first.id").alias("id"), *SKETCH, "bins")
    links, told, stars = star_answers(shared, known, texts, shingle=shingle, similarity=similarity)
    found = settled(shared, known, stars, sure.unionAll(links), tested.unionAll(told), texts, shingle=shingle, similarity=similarity, max_token_rows=max_token_rows)
    return with_kept(rows.select("id", "text_hash", "fp", F.col("text_hash").alias("node")), nodes.select("node", "first"), found)
