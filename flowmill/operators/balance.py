"""Class balancing: oversampling targets, undersampling, SMOTE, Borderline-SMOTE and ADASYN.

Neighbours are found exactly, in cells around pivots: the rows that ask (of the small classes) meet the rows that may answer only
where the triangle inequality doesn't rule it out, and each task compares one block with another by matrix products, which leave
few pairs to measure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions.expr import stable_hash, unit_draw
from flowmill.operators.sampling import rank_by_hash
from flowmill.storage import bounded, cut

#: Least rows of a cell; most pivots; rows that go to cells at once; of bounds, as a share of the lengths (distances are differences of squares).
BLOCK, PIVOTS, VISITS, SLACK = 2048, 256, 4096, 1e-7

#: Cells that a table is cut into, until they have so many rows; rows, columns and pairs of rows that are compared at once.
CELLS, LARGEST, ROWS, COLUMNS, PAIRS = 16, 32_768, 256, 4096, 1 << 16


def oversample_targets(df: DataFrame, label: str, ratio: float) -> DataFrame:
    """``label, n_rows, target``: smaller classes grow to int(largest * ratio); none shrinks."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n_rows"))
    most = counts.agg(F.max("n_rows").alias("most"))
    return counts.join(F.broadcast(most)).select("label", "n_rows", F.greatest("n_rows", (F.col("most") * F.lit(ratio)).cast("long")).alias("target"))


def undersample(df: DataFrame, label: str, most: int, key: list[str], *, seed: int = 42) -> DataFrame:
    """At most ``most`` rows of each class."""
    return rank_by_hash(df.where(F.col(label).isNotNull()), [label], key, seed=seed, name="__place", most=most).drop("__place")


def _vectors(df: DataFrame, key: str, label: str, features: list[str] | str) -> DataFrame:
    """``id, label, x``; rows with a missing or infinite feature take no part."""
    x = F.transform(F.col(features), lambda v: v.cast("double")) if isinstance(features, str) else F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), x.alias("x"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~F.coalesce(bad, F.lit(True)))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), "f8").reshape(len(flat), -1)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squares of the distances of all rows of x and y."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T, 0)


def _near_pivots(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` (id, label, x, of) with ``pivot, away``: the nearest pivot and how far it is."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            squares = _squares(_matrix(batch.column(2)), shared.value) if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(squares.argmin(axis=1)), pa.array(np.sqrt(squares.min(axis=1)))], [*batch.schema.names, "pivot", "away"])

    return rows.mapInArrow(nearest, "id long, label string, x array<double>, of string, pivot long, away double")


def _in_a_row(pivots: np.ndarray) -> np.ndarray:
    """The pivots, each followed by the nearest one that is left: neighbours in number are near each other."""
    order, left = [0], np.arange(1, len(pivots))
    while len(left):
        at = int(_squares(pivots[order[-1:]], pivots[left])[0].argmin())
        order.append(int(left[at]))
        left = np.delete(left, at)
    return pivots[order]


def visits(asking: DataFrame, pivots: np.ndarray, radii: dict[str, dict[int, tuple[float, int]]]) -> DataFrame:
    """``id, label, x, of, reach, visit`` of the rows that ask (with cell and reach): every cell but their own that has a pivot with rows that
    may be within their reach, by the triangle inequality. ``radii``: of each group and pivot, how far its rows are from it at most, and its cell.
    """
    groups = {g: (np.array([*x]), np.array([r for r, _ in x.values()]), np.array([c for _, c in x.values()])) for g, x in radii.items()}
    shared = asking.sparkSession.sparkContext.broadcast((pivots, groups))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, reached = shared.value
        norms = np.sqrt((centres * centres).sum(axis=1))
        for batch in batches:
            groups, own, reach = batch.column(3).to_pylist(), batch.column(5).to_numpy(), batch.column(4).to_numpy()
            rows, to = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
            for group in set(groups) & reached.keys():
                at, (names, radius, cells) = np.flatnonzero([g == group for g in groups]), reached[group]
                x = _matrix(batch.column(2).take(pa.array(at)))
                slack = SLACK * (np.sqrt((x * x).sum(axis=1))[:, None] + norms[names][None, :]) + SLACK
                may = np.sqrt(_squares(x, centres[names])) - radius[None, :] - slack <= reach[at][:, None]
                for cell in np.unique(cells):
                    row = np.flatnonzero(may[:, cells == cell].any(axis=1) & (own[at] != cell))
                    rows.append(at[row]), to.append(np.full(len(row), cell))
            rows, to = np.concatenate(rows), np.concatenate(to)
            for start in range(0, len(rows), VISITS):  # a row goes to many cells where nothing can be pruned
                part = batch.select([0, 1, 2, 3, 4]).take(pa.array(rows[start : start + VISITS]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(to[start : start + VISITS])], ["id", "label", "x", "of", "reach", "visit"])

    return asking.select("id", "label", "x", "of", "reach", "cell").mapInArrow(choose, "id long, label string, x array<double>, of string, reach double, visit long")


def _first_of_copies(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """The rows that may be among the k nearest of some other row: of equal ones, those of the k + 1 smallest ids."""
    if not x.shape[1]:
        same = np.zeros(len(x), "i8")
    else:
        same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1])))[:, 0], return_inverse=True)[1]
    order = np.lexsort((ids, same))
    group, id_ = same[order], ids[order]
    starts = np.r_[True, group[1:] != group[:-1]]
    nth = np.cumsum(starts | np.r_[True, id_[1:] != id_[:-1]])
    return np.sort(order[nth - nth[np.flatnonzero(starts)][np.cumsum(starts) - 1] <= k])


def _distances(x: np.ndarray, y: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squares of the distances of x[rows] and y[at], added in the order of the components, as SQL adds them."""
    out = np.zeros(len(rows))
    for start in range(0, len(rows), PAIRS):
        part = slice(start, start + PAIRS)
        apart = x[rows[part]] - y[at[part]]
        for column in (apart * apart).T:
            out[part] += column
    return out


def nearest_pairs(ids: np.ndarray, x: np.ndarray, reach: np.ndarray, other: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, square of the distance) of the k nearest rows y of each row x, those of its own id left out, ties by id; what is
    farther than ``reach`` may be missing.

    Lower bounds of the distances come from matrix products; only pairs whose bound is within reach, or within the k-th upper
    bound of the first rows, are measured and sorted.
    """
    kept = _first_of_copies(other, y, k)
    other, y = other[kept], y[kept]
    error = 1e-15 * (x.shape[1] + 8)  # of products, as a share of the squares of lengths
    lengths, lengths_y = (x * x).sum(axis=1), (y * y).sum(axis=1)
    left = np.hstack([-2 * x, np.ones((len(x), 1))])
    right = np.ascontiguousarray(np.hstack([y, (lengths_y * (1 - 2 * error))[:, None]]).T)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(0, len(x), ROWS):
        base = lengths[i : i + ROWS] * (1 - 2 * error)
        limit = reach[i : i + ROWS] ** 2 * (1 + 1e-12) - base
        rows, at = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
        for j in range(0, len(y), COLUMNS):
            bound = left[i : i + ROWS] @ right[:, j : j + COLUMNS]
            if bound.shape[1] > k and np.isinf(limit).any():
                bound[ids[i : i + ROWS][:, None] == other[j : j + COLUMNS][None, :]] = np.inf
                first = np.argpartition(bound, k - 1, axis=1)[:, :k]
                upper = np.take_along_axis(bound, first, axis=1) + 4 * error * (lengths_y[j + first] + lengths[i : i + ROWS][:, None])
                limit = np.minimum(limit, upper.max(axis=1))
            hit = np.flatnonzero(bound <= limit[:, None])
            rows.append(hit // bound.shape[1] + i), at.append(hit % bound.shape[1] + j)
        row, col = np.concatenate(rows), np.concatenate(at)
        real = ids[row] != other[col]
        row, col = row[real], col[real]
        distance = _distances(x, y, row, col)
        order = np.lexsort((other[col], distance, row))
        row, col, distance = row[order], col[order], distance[order]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, "i8")
        near = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)])) < k
        found.append((row[near], kept[col[near]], distance[near]))
    row, col, distance = (np.concatenate(c) if found else np.zeros(0, t) for c, t in zip(zip(*found, strict=True) if found else [()] * 3, ("i8", "i8", "f8"), strict=True))
    return row, col, distance


def neighbours(asking: DataFrame, all_rows: DataFrame, k: int, *, same_label: bool, block: int = BLOCK, max_pivots: int = PIVOTS) -> DataFrame:
    """``id, neighbour, place, same``: the k nearest other rows (Euclidean, ties by id), of the same label or of all.

    Rows are dealt to the nearest of a bounded sample of rows, the pivots (those whose ids hash lowest), and pivots beside each other
    are put together to cells of some thousand rows.  A first pass compares each asking row with the rows of its own cell, which gives it
    a k-th distance; a second one takes it to those cells only that may have nearer rows.  There are some 16 cells, so a row is sent some
    16 times at most, until cells have LARGEST rows; a cell that a pivot fills with more is dealt into blocks.
    """
    group = F.col("label") if same_label else F.lit("")
    cols = ["id", "label", "x"]
    asking, all_rows = asking.select(*cols, group.alias("of")), all_rows.select(*cols, group.alias("of"))
    n = all_rows.count()
    many, size = min(max_pivots, n // block + 1), max(block, min(n // CELLS + 1, LARGEST))
    chosen = [r["x"] for r in all_rows.orderBy(F.xxhash64("id"), "id").limit(many).collect()]  # at most max_pivots rows
    pivots = _in_a_row(np.array(chosen, "f8")) if chosen else np.zeros((1, 0))
    near = cut(_near_pivots(all_rows, pivots))
    before = Window.partitionBy("of").orderBy("pivot").rowsBetween(Window.unboundedPreceding, -1)  # a row a pivot
    sizes = near.groupBy("of", "pivot").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
    sizes = cut(sizes.withColumn("cell", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / size)))
    cells = cut(sizes.groupBy("of", F.col("cell").alias("visit")).agg(F.ceil(F.sum("n") / (2 * size)).cast("int").alias("blocks_b")))
    cell_of = bounded(sizes.select("of", "pivot", "cell"))
    all_rows = near.join(cell_of, ["of", "pivot"]).select(*cols, "of", "cell")
    # A pivot without rows of the group has no cell; its rows that ask start from none.
    asking = cut(_near_pivots(asking, pivots)).join(cell_of, ["of", "pivot"], "left").select(*cols, "of", F.coalesce("cell", F.lit(-1).cast("long")).alias("cell"))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("id", pa.int64()), ("neighbour", pa.int64()), ("same", pa.bool_()), ("distance", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ids, other = (np.asarray(t.column("id")) for t in (left, right))
        row, at, distance = nearest_pairs(ids, _matrix(left.column("x")), np.asarray(left.column("reach")), other, _matrix(right.column("x")), k)
        labels, labels_b = (np.array(t.column("label").to_pylist(), dtype=object) for t in (left, right))
        return pa.table([ids[row], other[at], (labels[row] == labels_b[at]).astype(bool), distance], schema=schema)

    def compared(rows: DataFrame) -> DataFrame:
        """The k nearest of each asking row among the rows of the cells that it visits."""
        blocks = rows.groupBy("of", "visit").agg(F.ceil(F.count("*") / (2 * size)).cast("int").alias("blocks_a"))
        blocks = bounded(cut(blocks.join(cells, ["of", "visit"])))
        own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        renewed = [F.col(c).alias(c) for c in (*cols, "of", "visit")]  # both sides may be of one table
        a = rows.join(blocks, ["of", "visit"]).select(*renewed, "reach", own("blocks_a").alias("a"), spread("blocks_b").alias("b"))
        b = all_rows.withColumnRenamed("cell", "visit").join(blocks, ["of", "visit"]).select(*renewed, own("blocks_b").alias("b"), spread("blocks_a").alias("a"))
        key = ["of", "visit", "a", "b"]
        found = a.groupBy(*key).cogroup(b.groupBy(*key)).applyInArrow(nearest, "id long, neighbour long, same boolean, distance double")
        return found.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))).where(F.col("place") <= k)

    found = compared(asking.select(*cols, "of", F.col("cell").alias("visit"), F.lit(float("inf")).alias("reach")))
    if many > 1:
        found = cut(found)
        radii: dict[str, dict[int, tuple[float, int]]] = {}
        for r in sizes.collect():  # a row a label and pivot
            radii.setdefault(r["of"], {})[r["pivot"]] = r["radius"], r["cell"]
        reach = found.where(F.col("place") == k).select(F.col("id").alias("of_id"), F.sqrt("distance").alias("reach"))
        told = cut(asking.join(reach, F.col("id") == F.col("of_id"), "left").select(*cols, "of", "cell", F.coalesce("reach", F.lit(float("inf"))).alias("reach")))
        found = found.drop("place").unionAll(compared(visits(told, pivots, radii)).drop("place"))
        found = found.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))).where(F.col("place") <= k)
    return found.select("id", "neighbour", "place", "same")


def _between(x: Column, y: Column, u: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + u * (b - a))


def _synthesise(wanted: DataFrame, near: DataFrame, rows: DataFrame, seed: int) -> DataFrame:
    """``label, x, id, neighbour, nth`` on the segment from each wanted (id, nth) to one of its neighbours, drawn by hash."""
    degree = near.groupBy("id").agg(F.count("*").alias("degree"))
    pick = F.floor(unit_draw([F.col("id"), F.col("nth")], seed) * F.col("degree")) + 1
    alone = F.raise_error(F.lit("a row to grow from has no neighbour"))
    drawn = wanted.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", alone)).withColumn("place", pick.cast("int")).withColumn("u", unit_draw([F.col("nth"), F.col("id")], seed + 1))
    linked = drawn.join(near.select("id", "neighbour", "place"), ["id", "place"])
    from_ = linked.join(rows, "id")
    to = rows.select(F.col("id").alias("neighbour"), F.col("x").alias("y"))
    return from_.join(to, "neighbour").select("label", _between(F.col("x"), F.col("y"), F.col("u")).alias("x"), "id", "neighbour", "nth")


def _growth(df: DataFrame, label: str, ratio: float) -> DataFrame:
    return oversample_targets(df, label, ratio).select(F.col("label").cast("string").alias("label"), "n_rows", (F.col("target") - F.col("n_rows")).alias("more")).where("more > 0")


def neighbour_count(smallest: int, most: int = 5) -> int:
    return max(1, min(smallest - 1, most))


def _setup(df: DataFrame, key: str, label: str, features: list[str] | str, ratio: float) -> tuple[DataFrame, DataFrame, int]:
    rows = cut(_vectors(df, key, label, features))
    growth = cut(_growth(rows, "label", ratio))
    smallest = growth.agg(F.min("n_rows")).first()[0]
    if smallest is not None and smallest < 2:
        raise ValueError("a class of one row has no neighbours to grow towards")
    return rows, growth, neighbour_count(smallest or 2)


def _dealt(ids: DataFrame, growth: DataFrame, seed: int) -> DataFrame:
    """``id, nth`` for ``more`` synthetic rows of each label, spread evenly over its rows in hash order."""
    ranked = rank_by_hash(ids, ["label"], ["id"], seed=seed, name="__place")
    counts = cut(ids.groupBy("label").agg(F.count("*").alias("__n")))
    joined = ranked.join(bounded(counts), "label").join(bounded(growth.select("label", "more")), "label")
    times = F.floor(F.col("more") / F.col("__n")) + (F.col("__place") <= F.col("more") % F.col("__n")).cast("long")
    return joined.withColumn("times", times).where("times > 0").select("id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("nth"))


def smote(df: DataFrame, key: str, label: str, features: list[str] | str, ratio: float, *, seed: int = 42) -> DataFrame:
    """``label, x, id, neighbour, nth``: synthetic rows that bring each class to its target (Chawla et al., 2002)."""
    rows, growth, k = _setup(df, key, label, features, ratio)
    small = rows.join(bounded(growth), "label").select("id", "label", "x")
    near = cut(neighbours(small, small, k, same_label=True))
    return _synthesise(_dealt(small.select("id", "label"), growth, seed), near, rows, seed)


def borderline_smote(df: DataFrame, key: str, label: str, features: list[str] | str, ratio: float, *, around: int = 10, seed: int = 42) -> DataFrame:
    """As :func:`smote`, from rows in danger only: at least half, but not all, of their ``around`` nearest rows are of other
    classes (Han et al., 2005). Classes without such rows stay as they are.
    """
    rows, growth, k = _setup(df, key, label, features, ratio)
    small = rows.join(bounded(growth), "label").select("id", "label", "x")
    foreign = neighbours(small, rows, around, same_label=False).groupBy("id").agg(F.count_if(~F.col("same")).alias("foreign"), F.count("*").alias("n"))
    danger = cut(small.join(foreign.where("foreign * 2 >= n and foreign < n").select("id"), "id"))
    near = cut(neighbours(danger, small, k, same_label=True))
    return _synthesise(_dealt(danger.select("id", "label"), growth, seed), near, rows, seed)


def adasyn(df: DataFrame, key: str, label: str, features: list[str] | str, ratio: float, *, seed: int = 42) -> DataFrame:
    """Synthetic rows in number proportional to the share of other classes around each row (He et al., 2008); by rounding,
    a class may miss its target by some. It is an error if no row of a class to grow has a neighbour of another.
    """
    rows, growth, k = _setup(df, key, label, features, ratio)
    small = rows.join(bounded(growth), "label").select("id", "label", "x")
    share = neighbours(small, rows, k, same_label=False).groupBy("id").agg((F.count_if(~F.col("same")) / F.count("*")).alias("share"))
    weighed = cut(small.select("id", "label").join(share, "id"))
    total = cut(weighed.groupBy("label").agg(F.sum("share").alias("total")))
    if growth.limit(1).count() and total.where("total > 0").limit(1).count() == 0:
        raise ValueError("no row has a neighbour of another class")
    counts = weighed.join(bounded(total), "label").join(bounded(growth), "label")
    wanted = counts.withColumn("times", F.bround(F.coalesce(F.try_divide("share", "total"), F.lit(0.0)) * F.col("more")).cast("long")).where("times > 0")
    near = cut(neighbours(small, small, k, same_label=True))
    return _synthesise(wanted.select("id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("nth")), near, rows, seed)


def with_synthetic(df: DataFrame, label: str, vector: str, synthetic: DataFrame, *, max_rows: int | None = None) -> DataFrame:
    """``label, x, synthetic``: original and synthetic rows together, original ones first where a cap cuts."""
    rows = df.select(F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("x"), F.lit(False).alias("synthetic"))
    out = rows.unionByName(synthetic.select("label", "x", F.lit(True).alias("synthetic")))
    return out if max_rows is None else out.orderBy("synthetic", stable_hash(F.col("x").cast("string"))).limit(max_rows)
