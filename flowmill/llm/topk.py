"""Exact top-k search by inner product with two cover trees.

Rows and queries are dealt to their nearest of a bounded sample of pivots, and where many have one pivot, to shards and blocks of
bounded size.  A first pass joins queries with the rows of their own pivot, which gives each a k-th score; a second pass joins
those pairs of pivots only whose bound reaches the worst of these.  Each task joins one block with one shard, and the best of all
are merged.  A task indexes its queries and its candidates in a cover tree each: every node has a centre among its points and the
covering radius of all points below it.  With query centre p, candidate centre c and radii r, s, no inner product below a pair of
nodes exceeds ``p.c + r|c| + s|p| + rs``; a pair whose bound is under the worst k-th score of the query group is pruned.  Pivots
are pruned by the same bound.  Equal bounds are not pruned, so ties are exact; bounds are floats with some slack, scores integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowmill.llm.common import cut

#: Rows of a shard and of a query block; a task holds one of each.  Most pivots.
SHARD_ROWS, BLOCK_ROWS, PIVOTS = 4096, 4096, 256

#: Points of a leaf; how far centres are apart; points compared before bounds are looked at again.
LEAF, SHRINK, STEP = 48, 0.6, 512

#: Of bounds, as a share of the lengths multiplied: distances come from differences of squares.
SLACK = 1e-7

NONE = np.iinfo("i8").min

#: The highest score; inner products beyond it count as it (and below -TOP, as that), so among these ids decide.
TOP = np.iinfo("i8").max - 1


class CoverTree:
    """Nodes in arrays; node k covers ``order[start[k]:stop[k]]``, its children are ``first[k]`` to ``last[k]``.

    A node's points are dealt to centres that are over SHRINK times its radius apart, each point to its nearest; nodes of
    few points, or of radius 0, have no children.
    """

    def __init__(self, points: np.ndarray) -> None:
        self.points, self.norms = points, np.sqrt((points * points).sum(axis=1))
        self.order = np.arange(len(points))
        self.centre, self.radius, self.start, self.stop, self.first, self.last = [], [], [], [], [], []
        middle = points.mean(axis=0)
        root = int(((points - middle) ** 2).sum(axis=1).argmin())
        self._add(root, 0, len(points))
        k = 0
        while k < len(self.centre):  # children are added behind
            self._split(k)
            k += 1
        for name in ("centre", "radius", "start", "stop", "first", "last"):
            setattr(self, name, np.array(getattr(self, name)))

    def _distance(self, centre: int, which: np.ndarray) -> np.ndarray:
        squares = self.norms[which] ** 2 + self.norms[centre] ** 2 - 2 * (self.points[which] @ self.points[centre])
        return np.sqrt(np.maximum(squares, 0))

    def _add(self, centre: int, start: int, stop: int) -> None:
        self.centre.append(centre), self.start.append(start), self.stop.append(stop)
        self.radius.append(float(self._distance(centre, self.order[start:stop]).max()))
        self.first.append(0), self.last.append(0)

    def _split(self, k: int) -> None:
        start, stop, radius = self.start[k], self.stop[k], self.radius[k]
        if stop - start <= LEAF or radius == 0:
            return
        own = self.order[start:stop]
        nearest, owner, centre, centres = np.full(len(own), np.inf), np.zeros(len(own), "i8"), self.centre[k], []
        while True:
            distance = self._distance(centre, own)
            closer = distance < nearest
            nearest[closer], owner[closer] = distance[closer], len(centres)
            centres.append(centre)
            far = int(nearest.argmax())
            # In data without structure the centres come near the points in number; then there is nothing to prune by.
            if nearest[far] <= SHRINK * radius or len(centres) >= max(8, len(own) // 16):
                break
            centre = int(own[far])
        sizes = np.bincount(owner, minlength=len(centres))
        if sizes.max() == len(own):  # nearer to each other than distances can tell
            return
        by = np.argsort(owner, kind="stable")
        self.order[start:stop] = own[by]
        self.first[k] = len(self.centre)
        at = start
        for centre, size in zip(centres, sizes.tolist(), strict=True):
            if size:
                self._add(centre, at, at + size)
                at += size
        self.last[k] = len(self.centre)


class _Best:
    """The k best (score, least id) of each query so far; NONE where there are fewer."""

    def __init__(self, queries: int, k: int) -> None:
        self.scores = np.full((queries, k), NONE)
        self.ids = np.full((queries, k), np.iinfo("i8").max)

    def offer(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.scores.shape[1]
        if scores.shape[1] > 4 * k:  # only what reaches the k-th of these can be among the best
            least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
            some = (scores >= np.maximum(least, self.scores[which, -1])[:, None]).any(axis=0)
            scores, ids = scores[:, some], ids[some]
        all_scores = np.concatenate([self.scores[which], scores], axis=1)
        all_ids = np.concatenate([self.ids[which], np.broadcast_to(ids, scores.shape)], axis=1)
        order = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]
        self.scores[which] = np.take_along_axis(all_scores, order, axis=1)
        self.ids[which] = np.take_along_axis(all_ids, order, axis=1)


def _largest(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def search(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of each query's k best points, whose id isn't the query's; NONE where there are fewer.

    Vectors are whole numbers.  ``least``: of each query, a score under which nothing is of use.  Scores beyond 64 bits count as the
    highest or lowest number (TOP, -TOP).
    """
    most = _largest(queries) * _largest(points) * max(1, queries.shape[1])
    whole, whole_points, exact, fits = queries, points, most < 1 << 53, most < 1 << 63
    queries, points = queries.astype("f8"), points.astype("f8")
    best, least = _Best(len(queries), k), np.full(len(queries), NONE) if least is None else least
    asked, given = CoverTree(queries), CoverTree(points)

    def bounds(q: int, nodes: np.ndarray) -> np.ndarray:
        p, centres = asked.centre[q], given.centre[nodes]
        r, s = asked.radius[q], given.radius[nodes]
        lengths = (asked.norms[p] + r) * (given.norms[centres] + s)
        return given.points[centres] @ asked.points[p] + r * given.norms[centres] + s * asked.norms[p] + r * s + SLACK * lengths + 1e-3

    def scored(which: np.ndarray, own: np.ndarray) -> np.ndarray:
        near = queries[which] @ points[own].T
        if exact:
            return near.astype("i8")
        product = whole[which] @ whole_points[own].T  # right but for multiples of 2^64
        if fits:
            return product
        wrong = 1e-12 * asked.norms[which][:, None] * given.norms[own][None, :] + 1.0
        product[near > TOP + wrong], product[near < -TOP - wrong] = TOP, -TOP
        for i, j in zip(*np.nonzero(np.abs(np.abs(near) - TOP) <= wrong), strict=True):  # too near to the limit to tell by floats
            sure = sum(int(x) * int(y) for x, y in zip(whole[which[i]], whole_points[own[j]], strict=True))
            product[i, j] = max(-TOP, min(TOP, sure))
        return product

    def worst(which: np.ndarray) -> int:
        return np.maximum(best.scores[which, -1], least[which]).min()

    stack = [(0, np.array([0]))]
    while stack:
        q, nodes = stack.pop()
        which = asked.order[asked.start[q] : asked.stop[q]]
        bound = bounds(q, nodes)
        keep = bound >= worst(which)
        nodes, bound = nodes[keep], bound[keep]
        if not len(nodes):
            continue
        inner = given.last[nodes] > 0
        if asked.last[q] and (not inner.any() or asked.radius[q] >= given.radius[nodes[inner]].max()):
            stack.extend((c, nodes) for c in range(asked.first[q], asked.last[q]))
        elif inner.any():
            below = np.concatenate([np.arange(a, b) for a, b in zip(given.first[nodes[inner]], given.last[nodes[inner]], strict=True)])
            stack.append((q, np.concatenate([nodes[~inner], below])))
        else:
            nodes = nodes[order := np.argsort(-bound, kind="stable")]  # the most promising first, to prune the rest
            bound, sizes = bound[order], given.stop[nodes] - given.start[nodes]
            step = np.cumsum(sizes) // STEP
            for part in np.split(np.arange(len(nodes)), np.flatnonzero(np.diff(step)) + 1):
                part = part[bound[part] >= worst(which)]
                if not len(part):
                    break
                own = np.concatenate([given.order[given.start[n] : given.stop[n]] for n in nodes[part]])
                scores = scored(which, own)
                scores[query_ids[which][:, None] == ids[own][None, :]] = NONE
                best.offer(which, scores, ids[own])
    return best.scores, best.ids


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), "i8").reshape(len(flat), -1)


def _near_pivots(df: DataFrame, pivots: dict[int, tuple[int, np.ndarray]]) -> DataFrame:
    """``df`` (id, v, size) with ``near, away``: the number of the nearest pivot of its size and the distance; -1 and 0 without one."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, near, away = np.asarray(batch.column(2)), np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for n, (first, centres) in shared.value.items():
                own = np.flatnonzero(size == n)
                if not len(own):
                    continue
                x = _matrix(batch.column(1).take(pa.array(own))).astype("f8")
                squares = np.maximum((x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * x @ centres.T, 0)
                near[own], away[own] = first + squares.argmin(axis=1), np.sqrt(squares.min(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(away)], ["id", "v", "size", "near", "away"])

    return df.mapInArrow(nearest, "id long, v array<bigint>, size int, near long, away double")


def top_k(rows: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vector_col: str = "vector", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, max_pivots: int = PIVOTS) -> DataFrame:
    """``query_id, rank, id, score``: of each query the k rows of other ids with the highest inner product, ties to the
    smaller id; all, if there are fewer.

    Both tables have an id (long) and a vector (array of whole numbers).  Inner products that 64 bits can't hold count as the highest
    (lowest) such number, and ids decide among them.
    Rows with a null id or vector, or a null inside, take no part.  Rows of one id are rows of their own, each with its score; the
    k best of a repeated query id are of all its rows together.  Vectors of another length than the query's are never its
    results.  A vector is held whole in memory, with up to ``shard_rows`` others.  Other columns are not read.
    """
    usable = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<bigint>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull())).withColumn("size", F.size("v"))
    rows, queries = usable(rows), usable(queries)
    many = min(max_pivots, ceil(rows.count() / shard_rows))
    pivots: dict[int, tuple[int, np.ndarray]] = {}
    chosen = rows.orderBy(F.xxhash64("id", "v"), "id").limit(many).collect()  # at most max_pivots rows
    for n in sorted({r.size for r in chosen}):
        pivots[n] = (sum(len(c) for _, c in pivots.values()), np.array([r.v for r in chosen if r.size == n], "f8"))
    centres = {first + j: c for first, x in pivots.values() for j, c in enumerate(x)}
    rows, queries = cut(_near_pivots(rows, pivots)), cut(_near_pivots(queries, pivots))
    given, asked = ({r.near: r for r in df.groupBy("near").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect()} for df in (rows, queries))  # a row a pivot
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        query_ids, ids = np.asarray(left.column("id")), np.asarray(right.column("id"))
        scores, found = search(_matrix(left.column("v")), query_ids, _matrix(right.column("v")), ids, k, np.asarray(left.column("least")))
        real = scores != NONE
        return pa.table([np.repeat(query_ids, real.sum(axis=1)), found[real], scores[real]], schema=schema)

    def joined(asking: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
        """The k best rows of each query in these pairs of pivots (queries', rows'). A row goes to every block that it can serve."""
        many = [(a, b, ceil(asked[a].n / block_rows), ceil(given[b].n / shard_rows)) for a, b in pairs]
        pairs_of, of_pairs = (F.broadcast(rows.sparkSession.createDataFrame(many, "a long, b long, blocks int, shards int")) for _ in range(2))
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = lambda n: F.pmod(F.xxhash64("id", "v"), n).cast("int")
        left = asking.join(pairs_of, F.col("near") == F.col("a")).select("id", "v", "size", "least", "a", "b", own("blocks").alias("block"), spread("shards").alias("shard"))
        right = rows.join(of_pairs, F.col("near") == F.col("b")).select("id", "v", "size", "a", "b", own("shards").alias("shard"), spread("blocks").alias("block"))
        keys = ["a", "b", "block", "shard", "size"]
        best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, id long, score long")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = cut(joined(queries.withColumn("least", F.lit(NONE)), [(a, a) for a in asked if a in given]))
    kth = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    asking = cut(queries.join(kth, "id", "left").withColumn("least", F.coalesce("least", F.lit(NONE))))
    worst = {r.near: r.least for r in asking.groupBy("near").agg(F.min("least").alias("least")).collect()}
    pairs = []
    for a in asked:
        for b in given:
            if a != b and (min(a, b) < 0 or _reach(centres[a], asked[a].away, centres[b], given[b].away) >= worst[a]):
                pairs.append((a, b))
    both = first.select("query_id", "id", "score").unionAll(joined(asking, pairs).select("query_id", "id", "score"))
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _reach(p: np.ndarray, r: float, c: np.ndarray, s: float) -> float:
    """No inner product of points within r of p and within s of c is larger; no result at all for other sizes."""
    if len(p) != len(c):
        return -np.inf
    p_norm, c_norm = np.linalg.norm(p), np.linalg.norm(c)
    return p @ c + r * c_norm + s * p_norm + r * s + SLACK * (p_norm + r) * (c_norm + s) + 1e-3


def quantized(rows: DataFrame, *, vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``rows`` with column ``vector``: floor(scale * x) of each component, as double; null if a component is null or not finite."""
    x = F.transform(vector_col, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.withColumn("vector", F.when(~bad, F.transform(x, lambda v: F.floor(v * scale))))
