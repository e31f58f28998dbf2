"""Gradient boosting of several classes at once: softmax loss, one tree a class and round, grown from histograms.

Features are cut into bins once, by approximate percentiles, and rows are packed into blocks of binned values.  One job a level
grows the trees of all classes: each task adds up first and second derivatives by class, node, feature and bin, a shuffle
by (class, node, feature) sums them and finds each feature's best split, and one row a node comes back.  Nodes of so few rows that
a task may hold them (CELLS) are sent whole to a task each, which grows all that is below; a table of so few rows is learnt from by one
task in all rounds, and fits of several options run side by side.  Derivatives are added as whole numbers, so that sums, and with
them the trees, don't depend on how rows are dealt to tasks, nor on which of the ways they are grown.  What a task holds is
bounded by CELLS and the model (classes, nodes of a level, features, bins), never by the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.storage import cut

#: Rows of a block; rounds until their trees' scores are added to the blocks; derivatives are counted in so many parts of 1.
BLOCK_ROWS, FOLD, PARTS = 8192, 8, 1 << 24

#: Features whose percentiles are computed at once.
FEATURES = 60

#: Cells (rows times features, 64 at least) of a node that is grown whole in one task: 262,144 rows of 64 features, 16 MB. Cells that
#: such a task works on at once, or some part of them.
CELLS, STEP = 1 << 24, 1 << 18

#: Rows a bin under which a node's rows are put in order to split it (under 256 rows), and from which its sums are held for its children.
FEW, HELD = 1, 3


class Tree(NamedTuple):
    """Nodes in arrays, the root first: rows whose ``feature`` is at most ``edge`` go to ``left``; leaves have feature -1."""

    feature: np.ndarray
    bin: np.ndarray
    edge: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def leaves(self, x: np.ndarray, by: np.ndarray) -> np.ndarray:
        """The node that each row of ``x`` ends in; ``by`` is ``bin`` for binned rows and ``edge`` for values."""
        at = np.zeros(len(x), "i8")
        rows = np.arange(len(x)) if self.feature[0] >= 0 else at[:0]
        while len(rows):
            node = at[rows]
            goes = x[rows, self.feature[node]] <= by[node]
            at[rows] = node = np.where(goes, self.left[node], self.right[node])
            rows = rows[self.feature[node] >= 0]
        return at


class Binned(NamedTuple):
    """Rows to learn from, cut into bins: blocks of binned values, the bins' ends by feature, numbers of features, classes and rows."""

    blocks: DataFrame
    edges: list[np.ndarray]
    width: int
    classes: int
    n: int


class Rule(NamedTuple):
    """How trees grow (:class:`SoftmaxBooster`)."""

    bins: int
    rate: float
    least: float
    penalty: float

    def value(self, g: np.ndarray | int, h: np.ndarray | int) -> np.ndarray | float:
        return -self.rate * (g / PARTS) / (h / PARTS + self.penalty)

    def strength(self, g: np.ndarray | int, h: np.ndarray | int) -> np.ndarray | float:
        return (g / PARTS) * (g / PARTS) / (h / PARTS + self.penalty)

    def unit_value(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """:meth:`value` of derivatives that aren't in parts."""
        return -self.rate * g / (h + self.penalty)

    def gains(self, lg: np.ndarray, lh: np.ndarray, g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
        """Of splits by the derivatives left of them and in all, not in parts; 0 where a child has under ``least``."""
        rh = h - lh
        with np.errstate(divide="ignore", invalid="ignore"):
            out = lg * lg / (lh + self.penalty)
            rg = g - lg
            rg *= rg
            rg /= rh + self.penalty
            out += rg
            out -= g * g / (h + self.penalty)
        out[(lh < least) | (rh < least)] = 0
        return out

    def splits(self, h: np.ndarray | int) -> np.ndarray | bool:
        """Whether this second derivative is enough for two children."""
        return h >= 2 * self.least * PARTS


def _tree(nodes: list[list]) -> Tree:
    columns = [*zip(*nodes, strict=True)]
    return Tree(*[np.array(c, t) for c, t in zip(columns, ("i8", "i8", "f8", "i8", "i8", "f8", "f8"), strict=True)])


def softmax(margins: np.ndarray) -> np.ndarray:
    raised = np.exp(margins - margins.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


class SoftmaxModel:
    """The trees by round and class. ``transform`` takes a table with a vector ``features``, as models of pyspark.ml do."""

    def __init__(self, trees: list[list[Tree]], classes: int, n_features: int) -> None:
        self.trees, self.classes, self.n_features = trees, classes, n_features

    def first(self, rounds: int) -> SoftmaxModel:
        """The model as it was after so many rounds."""
        return SoftmaxModel(self.trees[:rounds], self.classes, self.n_features)

    def margins(self, x: np.ndarray, out: np.ndarray | None = None, begin: int = 0, end: int | None = None) -> np.ndarray:
        """The margins of rows; from ``out``, what they were after ``begin`` rounds, to those after ``end``."""
        out = np.zeros((len(x), self.classes)) if out is None else out
        for trees in self.trees[begin:end]:
            for k, tree in enumerate(trees):
                out[:, k] += tree.value[tree.leaves(x, tree.edge)]
        return out

    def gains(self, label: int | None = None) -> np.ndarray:
        """The gain of all splits by feature, of one class's trees or of all."""
        out = np.zeros(self.n_features)
        for trees in self.trees:
            for tree in trees if label is None else trees[label : label + 1]:
                np.add.at(out, tree.feature[tree.feature >= 0], tree.gain[tree.feature >= 0])
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` without ``features``, and ``probability`` (an array, by class) and ``prediction`` (the first of the likeliest classes)."""
        kept = [c for c in df.columns if c != "features"]
        rows = df.select(*[F.col(f"`{c}`") for c in kept], vector_to_array("features").alias("__x"))
        shared = df.sparkSession.sparkContext.broadcast(self)

        def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                chance = softmax(shared.value.margins(_matrix(batch.column(len(kept)), shared.value.n_features)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(list(chance), pa.list_(pa.float64())), pa.array(chance.argmax(axis=1).astype("f8"))], [*kept, "probability", "prediction"])

        kinds = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields[:-1]]
        return rows.mapInArrow(predict, ", ".join(f"`{n}` {t}" for n, t in [*kinds, ("probability", "array<double>"), ("prediction", "double")]))

    def beginnings(self, df: DataFrame, rounds: list[int]) -> DataFrame:
        """``df`` without ``features``, once for each of these numbers of rounds: ``rounds`` and the ``prediction`` after so many. Each row
        goes through the trees once.
        """
        kept = [c for c in df.columns if c != "features"]
        rows = df.select(*[F.col(f"`{c}`") for c in kept], vector_to_array("features").alias("__x"))
        shared = df.sparkSession.sparkContext.broadcast(self)

        def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                x = _matrix(batch.column(len(kept)), own.n_features)
                margins, done = np.zeros((len(x), own.classes)), 0
                for size in sorted(set(rounds)):
                    margins, done = own.margins(x, margins, done, size), size
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.full(len(x), size), pa.int32()), pa.array(softmax(margins).argmax(axis=1).astype("f8"))], [*kept, "rounds", "prediction"])

        kinds = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields[:-1]]
        return rows.mapInArrow(predict, ", ".join(f"`{n}` {t}" for n, t in [*kinds, ("rounds", "int"), ("prediction", "double")]))

    def table(self, spark: SparkSession) -> DataFrame:
        """A row a node."""
        rows = [(r, k, n, *(v.item() for v in node)) for r, trees in enumerate(self.trees) for k, tree in enumerate(trees) for n, node in enumerate(zip(*tree, strict=True))]
        return spark.createDataFrame(rows, "round int, class int, node int, feature long, bin long, edge double, left long, right long, value double, gain double")

    @classmethod
    def of_table(cls, table: DataFrame, classes: int, n_features: int) -> SoftmaxModel:
        trees: dict[tuple[int, int], list[list]] = {}
        for r in table.orderBy("round", "class", "node").collect():  # the model
            trees.setdefault((r["round"], r["class"]), []).append([*r][3:])
        rounds = 1 + max((r for r, _ in trees), default=-1)
        return cls([[_tree(trees[r, k]) for k in range(classes)] for r in range(rounds)], classes, n_features)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), "f8").reshape(len(column), width)


class SoftmaxBooster:
    """An estimator of :class:`SoftmaxModel` for rows with a vector ``features`` and a whole number ``code`` from 0.

    ``rate`` shrinks every tree; ``subsample`` is the share of rows that a round is grown on, drawn by block and seed; ``penalty`` is
    added to second derivatives; a child needs ``least`` of these.
    """

    def __init__(self, *, rounds: int = 100, depth: int = 6, rate: float = 0.3, subsample: float = 1.0, least: float = 1.0, penalty: float = 1.0, bins: int = 64, seed: int = 42) -> None:
        if not (rounds >= 1 and depth >= 1 and 0 < rate <= 1 and 0 < subsample <= 1 and least > 0 and 2 <= bins <= 256):
            raise ValueError("rounds and depth are at least 1, rate and subsample in (0, 1], least over 0, bins from 2 to 256")
        self.rounds, self.depth, self.rate, self.subsample, self.least, self.penalty, self.bins, self.seed = rounds, depth, rate, subsample, least, penalty, bins, seed
        self.rule = Rule(bins, rate, least, penalty)

    def binned(self, rows: DataFrame) -> Binned:
        """``rows`` as fits with this number of bins take them."""
        rows = rows.select(vector_to_array("features").alias("x"), F.col("code").cast("int").alias("code"))
        first = rows.agg(F.max(F.size("x")).alias("width"), F.max("code").alias("last"), F.count("*").alias("n")).first()
        if first["last"] is None:
            raise ValueError("no rows to learn from")
        edges = self._edges(rows, first["width"])
        return Binned(cut(self._blocks(rows, edges)), edges, first["width"], max(2, first["last"] + 1), first["n"])

    def fit(self, rows: DataFrame | Binned) -> SoftmaxModel:
        """The model of rows, or of what :meth:`binned` made of them."""
        blocks, edges, width, classes, n = rows if isinstance(rows, Binned) else self.binned(rows)
        if self.fits_task(rows := Binned(blocks, edges, width, classes, n)):
            return SoftmaxModel(self._whole(rows), classes, width)
        trees: list[list[Tree]] = []
        folded = 0
        for r in range(self.rounds):
            if r - folded >= FOLD:
                blocks, folded = cut(self._folded(blocks, trees[folded:r], classes, width)), r
            trees.append(self._round(blocks, trees[folded:], r, classes, width, n, edges))
        return SoftmaxModel(trees, classes, width)

    def fits_task(self, rows: Binned) -> bool:
        """Whether one task may hold these rows."""
        return rows.n * max(64, rows.width, 8 * rows.classes) <= CELLS

    def _whole(self, rows: Binned) -> list[list[Tree]]:
        """All rounds, grown by one task from at most CELLS cells."""
        rounds, depth, rule, draw, classes, width = self.rounds, self.depth, self.rule, (self.seed, self.subsample), rows.classes, rows.width

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = [(batch.column(0)[i].as_py(), *_open(batch, i, [], classes, width)) for batch in batches for i in range(batch.num_rows)]
            for r, trees in enumerate(_rounds(own, rounds, depth, classes, rule, *draw)):
                yield _rows([(r, k) for k in range(classes)], trees)

        trees = [[None] * classes for _ in range(rounds)]
        for r, k, tree in _collected(rows.blocks.coalesce(1).mapInArrow(grow, f"round long, class long, {_TREE}"), rows.edges):
            trees[r][k] = tree
        return trees

    def held_blocks(self, held: DataFrame, rows: Binned) -> DataFrame:
        """Rows that aren't learnt from, cut into the bins of those that are."""
        return cut(self._blocks(held.select(vector_to_array("features").alias("x"), F.col("code").cast("int").alias("code")), rows.edges))

    def held_predictions(self, rows: Binned, held: DataFrame, sizes: list[int]) -> DataFrame:
        """``rounds, code, prediction`` of :meth:`held_blocks` after each of these numbers of rounds, by the task that grows the
        trees (:meth:`fits_task`) and keeps none: no model goes to the driver.
        """
        depth, rule, draw, classes, width = self.depth, self.rule, (self.seed, self.subsample), rows.classes, rows.width

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: tuple[list, list] = ([], [])
            for batch in batches:
                for i in range(batch.num_rows):
                    own[batch.column(5)[i].as_py()].append((batch.column(0)[i].as_py(), *_open(batch, i, [], classes, width)))
            if not own[1]:
                return
            x, code, margins = (np.concatenate(part) for part in [*zip(*own[1], strict=True)][1:])
            for r, trees in enumerate(_rounds(own[0], max(sizes), depth, classes, rule, *draw), 1):
                for k, tree in enumerate(trees):
                    margins[:, k] += tree.value[tree.leaves(x, tree.bin)]
                if r in sizes:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), r), pa.int32()), pa.array(code, pa.int32()), pa.array(softmax(margins).argmax(axis=1), pa.int32())], ["rounds", "code", "prediction"])

        both = rows.blocks.withColumn("held", F.lit(0)).unionAll(held.withColumn("held", F.lit(1)))
        return both.coalesce(1).mapInArrow(grow, "rounds int, code int, prediction int")

    def _edges(self, rows: DataFrame, width: int) -> list[np.ndarray]:
        """Of each feature the values that bins end at."""
        points, out = [j / self.bins for j in range(1, self.bins)], []
        for start in range(0, width, FEATURES):
            some = range(start, min(start + FEATURES, width))
            found = rows.agg(*[F.percentile_approx(F.col("x")[j], points, 10_000).alias(f"q{j}") for j in some]).first()
            out += [np.unique(np.array(found[f"q{j}"], "f8")) for j in some]
        return out

    def _blocks(self, rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
        """``block, n, bins, code, margins``: some rows each, as bytes (margins of 0 are left out)."""
        shared = rows.sparkSession.sparkContext.broadcast(edges)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = TaskContext.get().partitionId() << 32
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(at, BLOCK_ROWS)
                    x = _matrix(part.column(0), len(shared.value))
                    binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(shared.value)], axis=1).astype("u1")
                    code = np.asarray(part.column(1)).astype("<i4")
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([len(x)]), pa.array([binned.tobytes()], pa.binary()), pa.array([code.tobytes()], pa.binary()), pa.array([b""], pa.binary())], ["block", "n", "bins", "code", "margins"])
                    block += 1

        return rows.mapInArrow(pack, _BLOCKS)

    def _folded(self, blocks: DataFrame, trees: list[list[Tree]], classes: int, width: int) -> DataFrame:
        """The blocks with these trees' scores added to their margins."""
        shared = blocks.sparkSession.sparkContext.broadcast(trees)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                margins = [_open(batch, i, shared.value, classes, width)[2].tobytes() for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(margins, pa.binary())], batch.schema.names)

        return blocks.mapInArrow(add, _BLOCKS)

    def _round(self, blocks: DataFrame, recent: list[list[Tree]], r: int, classes: int, width: int, n: int, edges: list[np.ndarray]) -> list[Tree]:
        """One tree a class: level by level as far as nodes are large, and what is below the others at once."""
        nodes: list[list[list]] = [[[-1, 0, 0.0, -1, -1, 0.0, 0.0]] for _ in range(classes)]
        open_ = [[0] for _ in range(classes)]
        small: list[dict[int, int]] = [{} for _ in range(classes)]
        for level in range(self.depth):
            found = self._splits(blocks, recent, [_tree(n) for n in nodes], open_, r, classes, width)
            following: list[list[int]] = [[] for _ in range(classes)]
            for k, node, f, gain, bin_, gl, hl, nl, g, h, whole in found:
                own = nodes[k]
                own[node][5] = self.rule.value(g, h)
                if gain <= 1e-9:
                    continue
                left = len(own)
                own[node][:5], own[node][6] = [f, bin_, float(edges[f][bin_]), left, left + 1], gain
                for child, a, b, rows in ((left, gl, hl, nl), (left + 1, g - gl, h - hl, whole - nl)):
                    own.append([-1, 0, 0.0, -1, -1, self.rule.value(a, b), 0.0])
                    if not self.rule.splits(b):
                        continue
                    if rows * max(64, width) > CELLS:
                        following[k].append(child)
                    elif level + 1 < self.depth:
                        small[k][child] = self.depth - level - 1
            open_ = following
            if not any(open_):
                break
        if any(small):
            for k, node, tree in self._below(blocks, recent, [_tree(n) for n in nodes], small, r, classes, width, edges):
                # Node 0 of what is below stands where it was sent from, the others at the end.
                own, shift = nodes[k], len(nodes[k]) - 1
                rows = [[f, b, e, left + shift if f >= 0 else -1, right + shift if f >= 0 else -1, v, gain] for f, b, e, left, right, v, gain in zip(*(c.tolist() for c in tree), strict=True)]
                own[node] = rows[0]
                own += rows[1:]
        return [_tree(n) for n in nodes]

    def _below(self, blocks: DataFrame, recent: list[list[Tree]], growing: list[Tree], small: list[dict[int, int]], r: int, classes: int, width: int, edges: list[np.ndarray]) -> list[tuple[int, int, Tree]]:
        """``class, node, tree`` below each of the small nodes, which are given with the levels left to them; a task has one's rows whole."""
        seed, subsample, rule = self.seed, self.subsample, self.rule
        shared = blocks.sparkSession.sparkContext.broadcast((recent, growing, small))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            recent, growing, small = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    x, code, margins = _open(batch, i, recent, classes, width)
                    chance, drawn = softmax(margins), _drawn(seed, r, batch.column(0)[i].as_py(), len(x), subsample)
                    out = []
                    for k, own in enumerate(small):
                        if not own:
                            continue
                        g, h = _derivatives(chance[:, k], code == k)
                        at = np.where(drawn, growing[k].leaves(x, growing[k].bin), -1)
                        order = np.argsort(at, kind="stable")
                        for rows in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                            if int(at[rows[0]]) in own:
                                out.append((k, int(at[rows[0]]), x[rows].tobytes(), g[rows].tobytes(), h[rows].tobytes()))
                    if out:
                        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True))], ["class", "node", "x", "g", "h"])

        def grow(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            x, g, h = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("x", "u1"), ("g", "f8"), ("h", "f8")))
            k, node = (v.as_py() for v in key)
            x = x.reshape(-1, width)
            tree, _ = _grown(x, _cells(x, rule.bins), g, h, shared.value[2][k][node], rule)
            return pa.Table.from_batches([_rows([(k, node)], [tree], "node")])

        sent = blocks.mapInArrow(send, "class long, node long, x binary, g binary, h binary")
        return sorted(_collected(sent.groupBy("class", "node").applyInArrow(grow, f"class long, node long, {_TREE}"), edges), key=lambda t: t[:2])

    def _splits(self, blocks: DataFrame, recent: list[list[Tree]], growing: list[Tree], open_: list[list[int]], r: int, classes: int, width: int) -> list[tuple]:
        """``class, node, feature, gain, bin, gl, hl, nl, g, h, n`` of each open node's best split, by class and node; a gain of 0: none.
        (First and second derivatives and rows, left of the split and in all.)
        """
        bins, seed, subsample, least, rule = self.bins, self.seed, self.subsample, self.least, self.rule
        shared = blocks.sparkSession.sparkContext.broadcast((recent, growing, open_))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            recent, growing, open_ = shared.value
            sums = [np.zeros((3, len(own) * width * bins), "i8") for own in open_]
            for batch in batches:
                for i in range(batch.num_rows):
                    x, code, margins = _open(batch, i, recent, classes, width)
                    chance, drawn = softmax(margins), _drawn(seed, r, batch.column(0)[i].as_py(), len(x), subsample)
                    for k, own in enumerate(open_):
                        if not own:
                            continue
                        place = np.full(len(growing[k].feature), -1)
                        place[own] = np.arange(len(own))
                        at = place[growing[k].leaves(x, growing[k].bin)]
                        rows = np.flatnonzero((at >= 0) & drawn)
                        cell = ((at[rows, None] * width + np.arange(width)) * bins + x[rows]).ravel()
                        for s, d in enumerate((*_derivatives(chance[rows, k], code[rows] == k), np.ones(len(rows)))):
                            part = np.bincount(cell, np.repeat(d, width), sums[k].shape[1])
                            sums[k][s] += part.astype("i8")
            for k, own in enumerate(open_):
                if not own:
                    continue
                own_sums = sums[k].reshape(3, -1, bins)
                keep = np.flatnonzero(own_sums[2].any(axis=1))
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(s[keep].ravel()), bins).cast(pa.list_(pa.int64())) for s in own_sums]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), k)), pa.array(np.array(own, "i8")[keep // width]), pa.array(keep % width), *lists], ["class", "node", "feature", "g", "h", "n"])

        def best(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            g, h, n = (np.asarray(table.column(s).combine_chunks().flatten(), "i8").reshape(-1, bins).sum(axis=0) for s in ("g", "h", "n"))
            gl, hl, nl = (np.cumsum(s)[:-1] for s in (g, h, n))
            whole_g, whole_h = int(g.sum()), int(h.sum())
            gain = rule.strength(gl, hl) + rule.strength(whole_g - gl, whole_h - hl) - rule.strength(whole_g, whole_h)
            gain = np.where((hl >= least * PARTS) & (whole_h - hl >= least * PARTS), gain, 0.0)
            at = int(gain.argmax())
            row = [k.as_py() for k in key] + [max(0.0, float(gain[at])), at, int(gl[at]), int(hl[at]), int(nl[at]), whole_g, whole_h, int(n.sum())]
            return pa.table([[v] for v in row], schema=_SPLIT)

        sums = blocks.mapInArrow(add, "class long, node long, feature long, g array<long>, h array<long>, n array<long>")
        each = sums.groupBy("class", "node", "feature").applyInArrow(best, ", ".join(f"{f.name} {'double' if f.name == 'gain' else 'long'}" for f in _SPLIT))
        chosen = each.groupBy("class", "node").agg(F.max(F.struct("gain", (-F.col("feature")).alias("order"), "feature", "bin", "gl", "hl", "nl", "g", "h", "n")).alias("s"))
        found = chosen.select("class", "node", *[f"s.{c}" for c in ("feature", "gain", "bin", "gl", "hl", "nl", "g", "h", "n")]).collect()  # a row a node
        return sorted(tuple(x) for x in found)


_BLOCKS = "block long, n long, bins binary, code binary, margins binary"
_TREE = "feature array<int>, bin array<int>, left array<int>, right array<int>, value array<double>, gain array<double>"
_SPLIT = pa.schema([(c, pa.float64() if c == "gain" else pa.int64()) for c in ("class", "node", "feature", "gain", "bin", "gl", "hl", "nl", "g", "h", "n")])


def _drawn(seed: int, r: int, block: int, n: int, subsample: float) -> np.ndarray:
    """Which of a block's rows a round is grown on."""
    return np.random.default_rng([seed, r, block]).random(n) < subsample if subsample < 1 else np.ones(n, bool)


def _rounds(own: list[tuple], rounds: int, depth: int, classes: int, rule: Rule, seed: int, subsample: float) -> Iterator[list[Tree]]:
    """The trees of each round by class, grown from blocks (number, binned values, codes, margins) that are all here; edges are left 0."""
    x, code, margins = (np.concatenate(part) for part in [*zip(*own, strict=True)][1:])
    cells = _cells(x, rule.bins)
    for r in range(rounds):
        drawn = np.concatenate([_drawn(seed, r, block, len(part), subsample) for block, part, _, _ in own])
        chance, trees = softmax(margins), []
        for k in range(classes):
            tree, at = _grown(x, cells, *(np.where(drawn, d, 0.0) for d in _derivatives(chance[:, k], code == k)), depth, rule)
            margins[:, k] += tree.value[at]
            trees.append(tree)
        yield trees


def _derivatives(p: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and second ones of a class's margins, in parts."""
    return np.rint((p - own) * PARTS), np.rint(p * (1 - p) * PARTS)


def _padded(bins: int) -> int:
    """Bins of a node's sums: they are added up by eights."""
    return -(-bins // 8) * 8


def _cells(x: np.ndarray, bins: int) -> np.ndarray:
    """Where the sums of binned values are among those of a node, which are by bin and feature."""
    width = x.shape[1]
    kind = np.min_scalar_type(bins * width)  # the largest is less
    return x.astype(kind) * kind.type(width) + np.arange(width, dtype=kind)


def _grown(x: np.ndarray, cells: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rule: Rule) -> tuple[Tree, np.ndarray]:
    """The tree of binned rows that are all here, with their :func:`_cells` (its edges are left 0), and the node that each row ends in.
    Rows with derivatives of 0 don't count. Nodes are those that jobs by level find, in the same order.

    Nodes are split by sums of their rows in each bin. Where a parent had HELD rows a bin, only its smaller child's sums are made from
    rows, and the other's are the rest (of whole numbers, so they are the same). Rows of nodes under FEW a bin are put in order instead.
    """
    width, bins, least = x.shape[1], _padded(rule.bins), np.ceil(rule.least * PARTS) / PARTS
    g, h = g / PARTS, h / PARTS  # still exact
    at = np.zeros(len(g), "i8")
    rows = np.flatnonzero((g != 0) | (h != 0))
    # Nodes of the level that may be split, their derivatives, their rows one node after the other, and which of the sums are theirs.
    open_, whole, counts, held, sums = np.array([0]), np.array([[g.sum()], [h.sum()]]), np.array([len(rows)]), np.array([-1]), np.zeros((0, 2, bins * width))
    level = [np.array([-1]), np.array([0]), np.array([-1]), np.array([-1]), rule.unit_value(*whole), np.zeros(1)]
    levels, first = [level], 0
    for _ in range(depth):
        may = whole[1] >= 2 * rule.least
        rows, open_, whole, counts, held = rows[np.repeat(may, counts)], open_[may], whole[:, may], counts[may], held[may]
        if not len(open_):
            break
        starts = np.cumsum(counts) - counts
        feature, bin_, found = np.zeros(len(open_), "i8"), np.zeros(len(open_), "i8"), np.zeros((3, len(open_)))
        few, large = (counts < FEW * rule.bins) & (held < 0), counts >= HELD * bins
        for some in _parts(np.flatnonzero(few), counts, min(2048, STEP // 16 // width)):
            feature[some], bin_[some], found[:, some] = _split_by_order(x, _of_nodes(rows, starts, counts, some), counts[some], g, h, whole[:, some], least, rule)
        kept, places = [sums], len(sums)
        for some in _parts(np.flatnonzero(~few), np.ones(len(open_), "i8"), max(1, STEP // 8 // (width * bins))):
            known, made = held[some] >= 0, np.empty((len(some), *sums.shape[1:]))
            made[known] = sums[held[some[known]]]
            if not known.all():
                made[~known] = _sums(cells, _of_nodes(rows, starts, counts, some[~known]), counts[some[~known]], g, h, bins)
                if len(new := np.flatnonzero(~known & large[some])):
                    kept.append(made[new])
                    held[some[new]] = places + np.arange(len(new))
                    places += len(new)
            feature[some], bin_[some], found[:, some] = _split_by_sums(made, whole[:, some], least, rule)
        gain, part = found[0], found[1:]
        split = np.flatnonzero(gain > 1e-9)
        if not len(split):
            break
        feature, bin_, left = feature[split], bin_[split], first + len(level[0]) + 2 * np.arange(len(split))
        for column, v in zip(level, (feature, bin_, left, left + 1, None, gain[split]), strict=True):
            if v is not None:
                column[open_[split] - first] = v
        # Rows of nodes that are split, dealt to the children in the nodes' order.
        rows = _of_nodes(rows, starts, counts, split)
        of = np.repeat(np.arange(len(split)), counts[split])
        child = 2 * of + (x[rows, feature[of]] > bin_[of])
        at[rows] = left[0] + child
        rows, held = rows[np.argsort(child, kind="stable")], np.where(large[split], held[split], -1)
        whole, counts = np.stack([part[:, split], whole[:, split] - part[:, split]], axis=2).reshape(2, -1), np.bincount(child, minlength=2 * len(split))
        held, sums = _of_children(cells, rows, counts, g, h, held, np.concatenate(kept) if len(kept) > 1 else sums, bins)
        first, open_ = first + len(level[0]), left[0] + np.arange(len(counts))
        level = [np.full(len(counts), -1), np.zeros(len(counts), "i8"), np.full(len(counts), -1), np.full(len(counts), -1), rule.unit_value(*whole), np.zeros(len(counts))]
        levels.append(level)
    feature, bin_, left, right, value, gain = (np.concatenate(c) for c in zip(*levels, strict=True))
    tree = Tree(feature, bin_, np.zeros(len(feature)), left, right, value, gain)
    others = np.flatnonzero((g == 0) & (h == 0))
    at[others] = tree.leaves(x[others], bin_)
    return tree, at


def _of_nodes(rows: np.ndarray, starts: np.ndarray, counts: np.ndarray, some: np.ndarray) -> np.ndarray:
    """The rows of some nodes, one node after the other."""
    n = counts[some]
    return rows if len(some) == len(counts) else rows[np.repeat(starts[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _parts(some: np.ndarray, counts: np.ndarray, most: int) -> list[np.ndarray]:
    """Nodes in parts of about so many rows."""
    part = (np.cumsum(counts[some]) - 1) // max(1, most)
    return np.split(some, np.flatnonzero(np.diff(part)) + 1) if len(some) else []


def _sums(cells: np.ndarray, rows: np.ndarray, counts: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int) -> np.ndarray:
    """First and second derivatives of nodes by bin and feature."""
    width, out = cells.shape[1], np.zeros((len(counts), 2, bins * cells.shape[1]))
    ends, step = np.cumsum(counts), max(1, STEP // 4 // width)
    for a in range(0, len(rows), step):
        part = rows[a : a + step]
        # The nodes that these rows are of.
        i, j = np.searchsorted(ends, [a, a + len(part) - 1], side="right")
        n = np.minimum(ends[i : j + 1], a + len(part)) - np.maximum(ends[i : j + 1] - counts[i : j + 1], a)
        place = cells[part].astype("i8")
        place += np.repeat(np.arange(len(n)) * (bins * width), n)[:, None]
        for s, d in enumerate((g, h)):
            out[i : j + 1, s] += np.bincount(place.ravel(), np.repeat(d[part], width), len(n) * bins * width).reshape(len(n), -1)
    return out


def _of_children(cells: np.ndarray, rows: np.ndarray, counts: np.ndarray, g: np.ndarray, h: np.ndarray, held: np.ndarray, sums: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sums that come with it are each child's (-1: none): of pairs whose parent's are held, the smaller child's sums are made
    from its rows, and the other's are the rest.
    """
    pairs, starts, out = counts.reshape(-1, 2), np.cumsum(counts) - counts, np.full(len(counts), -1)
    some = np.flatnonzero(held >= 0)
    both = np.empty((2 * len(some), *sums.shape[1:]))
    small = 2 * some + (pairs[some, 1] < pairs[some, 0])
    out[small], out[small ^ 1] = np.arange(len(some)), len(some) + np.arange(len(some))
    made = _sums(cells, _of_nodes(rows, starts, counts, small), counts[small], g, h, bins)
    both[: len(some)] = made
    np.subtract(sums[held[some]], made, out=both[len(some) :])
    return out, both


def _split_by_sums(sums: np.ndarray, whole: np.ndarray, least: float, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature and bin of each node's best split, and its gain and derivatives left of it; a gain of 0: none."""
    by_bin, nodes = sums.reshape(len(sums), 2, _padded(rule.bins), -1), np.arange(len(sums))
    eights = by_bin.reshape(len(sums), 2, -1, 8, by_bin.shape[3])
    for j in range(1, 8):
        eights[:, :, :, j] += eights[:, :, :, j - 1]
    for j in range(1, eights.shape[2]):
        eights[:, :, j] += eights[:, :, j - 1, -1:]
    gains = rule.gains(by_bin[:, 0], by_bin[:, 1], *whole[:, :, None, None], least)
    feature = gains.max(axis=1).argmax(axis=1)
    own = gains[nodes, :, feature]
    bin_ = own.argmax(axis=1)
    return feature, bin_, np.stack([own[nodes, bin_], by_bin[nodes, 0, bin_, feature], by_bin[nodes, 1, bin_, feature]])


def _split_by_order(x: np.ndarray, rows: np.ndarray, counts: np.ndarray, g: np.ndarray, h: np.ndarray, whole: np.ndarray, least: float, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`_split_by_sums`, from some 2,000 rows at most (a number of 32 bits has node, bin and place)."""
    nodes, starts, shift = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts, len(rows).bit_length()
    order = x[rows].T.astype("u4", order="C")
    order <<= shift
    order |= (nodes << (shift + 8) | np.arange(len(rows))).astype("u4")
    order.sort(axis=1)
    place = order & ((1 << shift) - 1)
    # Both derivatives as one number: under 256 rows, of which the second has 30 bits at most; what overflows between nodes cancels out.
    both = (g[rows] * PARTS).astype("i8") << 30 | (h[rows] * PARTS).astype("i8")
    left = np.cumsum(both.take(place, mode="clip"), axis=1)
    left -= np.repeat(np.cumsum(both)[starts] - both[starts], counts)
    lg, lh = (left >> 30) / PARTS, (left & ((1 << 30) - 1)) / PARTS
    gains = rule.gains(lg, lh, *whole[:, nodes], least)
    gains[:, :-1][(order[:, 1:] ^ order[:, :-1]) < 1 << shift] = 0  # a bin isn't split
    most = np.maximum.reduceat(gains, starts, axis=1)
    feature = most.argmax(axis=0)
    gain = most[feature, np.arange(len(counts))]
    tops = np.flatnonzero(gains[feature[nodes], np.arange(len(rows))] == gain[nodes])
    top = tops[np.searchsorted(tops, starts)]
    return feature, (order[feature, top] >> shift & 255).astype("i8"), np.stack([gain, lg[feature, top], lh[feature, top]])


def _rows(keys: list[tuple[int, int]], trees: list[Tree], second: str = "class") -> pa.RecordBatch:
    """A row a tree: two keys, and the nodes' columns but ``edge``."""
    columns = [c for c in Tree._fields if c != "edge"]
    lists = [pa.array([getattr(tree, c) for tree in trees], pa.list_(pa.float64() if c in ("value", "gain") else pa.int32())) for c in columns]
    return pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in zip(*keys, strict=True)), *lists], ["round" if second == "class" else "class", second, *columns])


def _collected(table: DataFrame, edges: list[np.ndarray]) -> list[tuple[int, int, Tree]]:
    """The keys and trees of such rows, with their edges: the model."""
    ends, out = np.zeros((len(edges), max(map(len, edges)))), []
    for f, e in enumerate(edges):
        ends[f, : len(e)] = e
    for batch in table.toArrow().to_batches():
        for i in range(batch.num_rows):
            feature, bin_, left, right, value, gain = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in range(2, 8))
            out.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), Tree(feature, bin_, np.where(feature >= 0, ends[feature, bin_], 0.0), left, right, value, gain)))
    return out


def _open(batch: pa.RecordBatch, i: int, recent: list[list[Tree]], classes: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's binned values, codes, and margins with the recent trees' scores."""
    n, bins, code, margins = (batch.column(k)[i].as_py() for k in (1, 2, 3, 4))
    x = np.frombuffer(bins, "u1").reshape(n, width)
    scores = np.frombuffer(margins, "f8").reshape(n, classes).copy() if margins else np.zeros((n, classes))
    for trees in recent:
        for k, tree in enumerate(trees):
            scores[:, k] += tree.value[tree.leaves(x, tree.bin)]
    return x, np.frombuffer(code, "<i4"), scores
