"""Profiles of wide labelled tables: labels, missing and infinite cells, types, dominant values, statistics, outliers.

Reports have one row a column (or a column and label), and come from aggregates that sum up in every task before they
shuffle. Wide tables are aggregated in batches of columns, so that the generated code stays small.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions.expr import INF, is_inf, number_of, value_type
from flowmill.operators.quantiles import group_percentiles, measured_percentiles, with_percentiles
from flowmill.operators.schema import numeric_columns
from flowmill.storage import cut

BATCH = 60


def melt(df: DataFrame, columns: Iterable[str], keep: Iterable[str | Column] = (), *, text: bool = False) -> DataFrame:
    """``keep, column, value``: one row a cell, as double or, with ``text``, as string. NULL cells stay."""
    cells = [F.struct(F.lit(n).alias("column"), (F.col(f"`{n}`").cast("string") if text else number_of(df, n)).alias("value")) for n in columns]
    return df.select(*keep, F.explode(F.array(*cells)).alias("cell")).select("*", "cell.column", "cell.value").drop("cell")


def each_column(df: DataFrame, columns: list[str], measures: dict[str, Column], *, by: list[str] | None = None) -> DataFrame:
    """``column`` and measures, from aggregates over all rows. A measure is an aggregate of column ``value``."""
    parts = []
    for start in range(0, len(columns), BATCH):
        some = columns[start : start + BATCH]
        parts.append(melt(df, some, by or []).groupBy(*(by or []), "column").agg(*[c.alias(n) for n, c in measures.items()]))
    return reduce(DataFrame.unionByName, parts)


def _wide(df: DataFrame, columns: list[str], measure) -> DataFrame:
    """``column, n_rows, x``: one pass, an aggregate a column, no row is multiplied."""
    parts = []
    for start in range(0, len(columns), BATCH):
        some = columns[start : start + BATCH]
        row = df.agg(F.count("*").alias("n_rows"), *[measure(n).alias(f"x{k}") for k, n in enumerate(some)])
        cells = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"x{k}").alias("x")) for k, n in enumerate(some)])
        parts.append(row.select("n_rows", F.explode(cells).alias("c")).select("c.column", "n_rows", "c.x"))
    return reduce(DataFrame.unionAll, parts)


def _percent(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.lit(100.0) * F.col(part), F.col(whole).cast("double")), F.lit(0.0))


# Labels


def label_distribution(df: DataFrame, label: str, *, with_null: bool = False) -> DataFrame:
    """``label, n_rows, percent`` of the rows counted; NULL labels only on request."""
    rows = df if with_null else df.where(F.col(label).isNotNull())
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n_rows"))
    total = counts.agg(F.sum("n_rows").alias("total"))
    return counts.join(F.broadcast(total)).select("label", "n_rows", _percent("n_rows", "total").alias("percent"))


def class_totals(df: DataFrame, is_normal: Column) -> DataFrame:
    """``normal, other, unlabelled`` rows, for a condition on the label (NULL where there is none)."""
    return df.agg(F.count_if(is_normal).alias("normal"), F.count_if(~is_normal).alias("other"), F.count_if(is_normal.isNull()).alias("unlabelled"))


def labels_by_source(df: DataFrame, label: str, source: str) -> DataFrame:
    """``label, n_sources, n_rows``: in how many files each label occurs."""
    per = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label"), F.col(source).alias("source")).agg(F.count("*").alias("n"))
    return per.groupBy("label").agg(F.count("*").alias("n_sources"), F.sum("n").alias("n_rows"))


def prediction_distribution(df: DataFrame, prediction: str) -> DataFrame:
    return label_distribution(df, prediction, with_null=True).withColumnRenamed("label", "prediction")


# Cells


def missing_profile(df: DataFrame, columns: list[str] | None = None, *, only_missing: bool = True) -> DataFrame:
    """``column, n_rows, missing, percent``."""
    out = _wide(df, columns or df.columns, lambda n: F.count_if(F.col(f"`{n}`").isNull())).withColumnRenamed("x", "missing")
    out = out.withColumn("percent", _percent("missing", "n_rows"))
    return out.where("missing > 0") if only_missing else out


def inf_profile(df: DataFrame, columns: list[str] | None = None, *, coerce: bool = False) -> DataFrame:
    """``column, n_rows, infinite, ratio``; with ``coerce`` text columns are read as numbers, else only numeric ones count."""
    names = columns or (df.columns if coerce else numeric_columns(df))
    out = _wide(df, names, lambda n: F.count_if(is_inf(number_of(df, n)))).withColumnRenamed("x", "infinite")
    return out.withColumn("ratio", F.coalesce(F.try_divide(F.col("infinite").cast("double"), F.col("n_rows").cast("double")), F.lit(0.0)))


#: What :func:`cell_profile` counts of each column.
KINDS = ("missing", "integer", "float", "inf", "string")


def cell_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, n_rows, missing, integer, float, inf, string, about_distinct``: what the cells' text is, and about how many different
    values there are: the state that the reports of cells read, filled by one pass over wide rows (a pass for each 60 columns).
    """
    names, parts = columns or df.columns, []
    for start in range(0, len(names), BATCH):
        some = names[start : start + BATCH]
        kinds = [F.count_if(value_type(_text(n)) == kind).alias(f"{kind}{k}") for k, n in enumerate(some) for kind in KINDS]
        row = df.agg(F.count("*").alias("n_rows"), *kinds, *[F.approx_count_distinct(_text(n)).alias(f"about{k}") for k, n in enumerate(some)])
        cells = [F.struct(F.lit(n).alias("column"), *[F.col(f"{kind}{k}").alias(kind) for kind in KINDS], F.col(f"about{k}").alias("about_distinct")) for k, n in enumerate(some)]
        parts.append(row.select("n_rows", F.explode(F.array(*cells)).alias("c")).select("c.column", "n_rows", *[f"c.{kind}" for kind in KINDS], "c.about_distinct"))
    return reduce(DataFrame.unionAll, parts)


def type_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, kind, cells`` of missing, integer, float, inf and string cells, and ``critical``: the column has strings or infinities."""
    each = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("cells")) for kind in KINDS])).alias("k")
    found = cell_profile(df, columns).select("column", each, ((F.col("string") > 0) | (F.col("inf") > 0)).alias("critical"))
    return found.select("column", "k.kind", "k.cells", "critical").where("cells > 0")


def low_variance(df: DataFrame, columns: list[str] | None = None, *, most: int = 3) -> DataFrame:
    """``column, n_distinct, kind, distinct_values``: columns of 1 (constant) to ``most`` distinct values, not counting NULL.

    One pass estimates all columns; only those that may be so few are shuffled and counted by value.
    """
    names = columns or df.columns
    about = _wide(df, names, lambda n: F.approx_count_distinct(F.col(f"`{n}`").cast("string"))).where(F.col("x") <= 2 * most + 10)
    names = sorted(r["column"] for r in about.select("column").collect())  # estimates; the columns left are counted exactly
    if not names:
        return df.sparkSession.createDataFrame([], "column string, n_distinct long, kind string, distinct_values string")
    seen = melt(df, names, text=True).where(F.col("value").isNotNull()).select("column", "value").distinct()
    few = seen.groupBy("column").agg(F.count("*").alias("n_distinct")).where(F.col("n_distinct") <= most)
    listed = seen.join(F.broadcast(few), "column").groupBy("column", "n_distinct").agg(F.array_join(F.sort_array(F.collect_list("value")), "|").alias("distinct_values"))
    return listed.select("column", "n_distinct", F.when(F.col("n_distinct") == 1, "constant").otherwise("low variance").alias("kind"), "distinct_values")


# Dominant values

#: Lower bounds of the report's buckets, in percent; a share of 1 has a bucket of its own. Fixed values.
BUCKETS = (95, 90, 80, 70, 60, 50)


def share_bucket(share: Column) -> Column:
    out = F.when(share >= 1.0, "100%")
    for low, high in zip(BUCKETS, (100, *BUCKETS), strict=False):
        out = out.when(share >= low / 100, f"{low}-{high}%")
    return out


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, value, n``; NULL isn't a value."""
    return melt(df, columns, text=True).where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))


def _text(name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


def heavy_candidates(df: DataFrame, columns: list[str], least: float) -> dict[str, list[str]]:
    """Of each column the values that may hold a share of ``least`` or more of its non-NULL cells: all that do, and few others.

    One pass over wide rows fills a frequent-items sketch a column (of some 32 / ``least`` counters, in each task) and merges them; no
    cell is shuffled.  A count is off by at most a ninth of ``least``, so the first 2 / ``least`` values hold all that are wanted.
    """
    if not 0 < least <= 1:
        raise ValueError("the share must be over 0 and at most 1")
    most, found = ceil(2 / least), {}
    for start in range(0, len(columns), BATCH):
        some = columns[start : start + BATCH]
        sketches = [F.call_function("approx_top_k", _text(n), F.lit(most + 1), F.lit(max(128, 16 * most))).alias(f"x{k}") for k, n in enumerate(some)]  # NULL takes one place
        row = df.agg(*sketches).first()
        for k, n in enumerate(some):
            found[n] = [x["item"] for x in row[f"x{k}"] if x["item"] is not None]
    return found


def dominance(df: DataFrame, columns: list[str], *, least: float = 0.5) -> DataFrame:
    """``column, dominant_value, dominant_count, total_count, dominant_ratio, bucket``: each column's most common value.

    Shares are of the non-NULL cells; of equally common values the least counts. Columns under ``least`` aren't reported.
    Two passes: sketches name the candidates (:func:`heavy_candidates`), which are then counted exactly, in wide rows.
    """
    candidates = heavy_candidates(df, columns, least)
    columns, parts = [n for n in columns if candidates[n]], []
    for start in range(0, len(columns), BATCH):
        some = columns[start : start + BATCH]
        counts = [F.count_if(_text(n) == F.lit(x)).alias(f"c{k}_{j}") for k, n in enumerate(some) for j, x in enumerate(candidates[n])]
        row = df.agg(*[F.count(F.col(f"`{n}`")).alias(f"n{k}") for k, n in enumerate(some)], *counts)
        cells = [F.struct(F.lit(n).alias("column"), F.lit(x).alias("value"), F.col(f"c{k}_{j}").alias("n"), F.col(f"n{k}").alias("total_count")) for k, n in enumerate(some) for j, x in enumerate(candidates[n])]
        parts.append(row.select(F.explode(F.array(*cells)).alias("x")).select("x.*"))
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, dominant_value string, dominant_count long, total_count long, dominant_ratio double, bucket string")
    top = F.min(F.struct((-F.col("n")).alias("n"), "value"))
    found = reduce(DataFrame.unionAll, parts).groupBy("column", "total_count").agg(top.alias("top"))
    ratio = -F.col("top.n") / F.col("total_count").cast("double")
    out = found.select("column", F.col("top.value").alias("dominant_value"), (-F.col("top.n")).alias("dominant_count"), "total_count", ratio.alias("dominant_ratio"))
    return out.where(F.col("dominant_ratio") >= least).withColumn("bucket", share_bucket(F.col("dominant_ratio")))


def _dominant(df: DataFrame, columns: list[str], least: float) -> dict[str, str]:
    """The dominant value of each dominated column: a row a column."""
    return {r["column"]: r["dominant_value"] for r in dominance(df, columns, least=least).select("column", "dominant_value").collect()}


def dominance_by_label(df: DataFrame, columns: list[str], label: str, *, least: float = 0.5) -> DataFrame:
    """``column, side, label, n``: the labels of the rows that hold the dominant value, and of those with another.

    Only dominated columns are counted, by label in wide rows.
    """
    top = _dominant(df, columns, least)
    named, parts = [n for n in columns if n in top], []
    for start in range(0, len(named), BATCH):
        some = named[start : start + BATCH]
        sides = [(k, n, side, F.count_if((_text(n) == F.lit(top[n])) if side == "dominant" else (_text(n) != F.lit(top[n])))) for k, n in enumerate(some) for side in ("dominant", "rest")]
        rows = df.groupBy(F.col(label).alias("label")).agg(*[c.alias(f"{side}{k}") for k, _, side, c in sides])
        cells = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(side).alias("side"), F.col(f"{side}{k}").alias("n")) for k, n, side, _ in sides])
        parts.append(rows.select("label", F.explode(cells).alias("x")).select("x.column", "x.side", "label", "x.n").where("n > 0"))
    if not parts:
        return df.select(F.lit("").alias("column"), F.lit("").alias("side"), F.col(label).alias("label"), F.lit(0).cast("long").alias("n")).limit(0)
    return reduce(DataFrame.unionAll, parts)


def dominance_rest(df: DataFrame, columns: list[str], *, least: float = 0.5, top: int = 5) -> DataFrame:
    """``column, value, n, place``: the most common values beside the dominant one, of dominated columns.

    Dominant values go before the others are counted, so at most a share of 1 - ``least`` of these columns' cells is shuffled.
    """
    found = _dominant(df, columns, least)
    if not found:
        return df.sparkSession.createDataFrame([], "column string, value string, n long, place long")
    known = F.create_map(*[F.lit(x) for pair in found.items() for x in pair])
    cells = melt(df, [n for n in columns if n in found], text=True).where(F.col("value") != known[F.col("column")])
    return top_values(cells.groupBy("column", "value").agg(F.count("*").alias("n")), top)


def top_values(counts: DataFrame, top: int) -> DataFrame:
    """``column, value, n, place`` of the ``top`` most common values; ranks are cut in every task before they shuffle."""
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("column", "value", "n", F.col("place").cast("long").alias("place"))


# Statistics


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, n, mean, std, min, p25, p50, p75, max`` of the non-NULL values; exact percentiles, sample deviation."""
    v = F.col("value")
    stats = {"n": F.count(v), "mean": F.avg(v), "std": F.stddev_samp(v), "min": F.min(v), "max": F.max(v)}
    out = measured_percentiles(melt(df, columns), ["column"], stats, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return out.select("column", "n", "mean", "std", "min", "p25", "p50", "p75", "max")


def percentiles(df: DataFrame, columns: list[str], at: Iterable[float], *, accuracy: int | None = None) -> DataFrame:
    """``column, q, value``: linear between ranks; with ``accuracy``, approximate in one pass. A column of NULLs has NULLs."""
    at = [float(q) for q in at]
    if accuracy is None:
        names = F.explode(F.array(*map(F.lit, columns))).alias("column")
        every = df.sparkSession.range(1).select(names)
        found = with_percentiles(every, melt(df, columns), ["column"], {f"x{k}": q for k, q in enumerate(at)}).select("column", F.array(*[f"x{k}" for k in range(len(at))]).alias("x"))
    else:
        found = each_column(df, columns, {"x": F.percentile_approx("value", at, accuracy)})
    return found.select("column", F.explode(F.arrays_zip(F.array(*map(F.lit, at)).alias("q"), F.col("x").alias("value"))).alias("z")).select("column", "z.q", "z.value")


def feature_stats(df: DataFrame, columns: list[str], *, by: list[str] | None = None, distinct: bool = False) -> DataFrame:
    """``column, min, median, max, mean, zero_percent`` (and n_distinct), by label if asked. NULL cells count in the
    zeros' denominator, not as zeros.
    """
    v, groups = F.col("value"), [*(by or []), "column"]
    zero = F.lit(100.0) * F.count_if(v == 0) / F.count("*")
    stats = {"min": F.min(v), "max": F.max(v), "mean": F.avg(v), "zero_percent": zero}
    out = measured_percentiles(melt(df, columns, by or []), groups, stats, {"median": 0.5}).select(*groups, "min", "median", "max", "mean", "zero_percent")
    if not distinct:
        return out
    values = melt(df, columns, by or []).where(v.isNotNull()).select(*groups, "value").distinct().groupBy(*groups).agg(F.count("*").alias("__d"))
    same = F.lit(True)
    for k, g in enumerate(groups):
        values = values.withColumnRenamed(g, f"__d{k}")
        same = same & F.col(g).eqNullSafe(F.col(f"__d{k}"))
    return out.join(values, same, "left").select(*out.columns, F.coalesce("__d", F.lit(0)).alias("n_distinct"))


def abnormal_by_label(df: DataFrame, columns: list[str], label: str, threshold: float) -> DataFrame:
    """``label, column, abnormal, n, percent``: values over the threshold, of the non-NULL ones."""
    v = F.col("value")
    out = each_column(df.withColumn("label", F.col(label)) if label != "label" else df, columns, {"abnormal": F.count_if(v > threshold), "n": F.count(v)}, by=["label"])
    return out.withColumn("percent", _percent("abnormal", "n"))


def median_compare(df: DataFrame, columns: list[str], first: Column, second: Column) -> DataFrame:
    """``column, first_median, second_median`` of two subsets, side by side."""
    marked = df.select("*", F.when(first, 1).when(second, 2).alias("__side")).where("__side is not null")
    return _side_medians(melt(marked, columns, ["__side"]))


def _side_medians(cells: DataFrame) -> DataFrame:
    """``column, first_median, second_median`` of cells whose __side is 1 or 2; every column that has a cell."""
    medians = group_percentiles(cells, ["column", "__side"], [0.5])
    found = medians.groupBy("column").agg(*[F.max(F.when(F.col("__side") == k, F.col("q")[0])).alias(n) for k, n in ((1, "first_median"), (2, "second_median"))])
    return cells.select("column").distinct().join(found, "column", "left")


def iqr_bounds(df: DataFrame, columns: list[str], *, factor: float = 1.5) -> DataFrame:
    """``column, low, high``: quartiles less and plus ``factor`` times their distance; of columns with over one value."""
    v = F.col("value")
    quarters = measured_percentiles(melt(df, columns), ["column"], {"a": F.min(v), "b": F.max(v)}, {"p25": 0.25, "p75": 0.75}).where("a < b")
    low, high = F.col("p25"), F.col("p75")
    return quarters.select("column", (low - factor * (high - low)).alias("low"), (high + factor * (high - low)).alias("high"))


def iqr_outliers(df: DataFrame, columns: list[str], label: str, *, factor: float = 1.5) -> DataFrame:
    """``column, label, outliers, n``: values strictly outside the bounds, by label."""
    bounds = iqr_bounds(df, columns, factor=factor)
    cells = melt(df, columns, [F.col(label).alias("label")]).where(F.col("value").isNotNull()).join(F.broadcast(bounds), "column")
    outside = (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))
    return cells.groupBy("column", "label").agg(F.count_if(outside).alias("outliers"), F.count("*").alias("n"))


def histogram(df: DataFrame, column: str, *, bins: int = 50) -> DataFrame:
    """``bin, low, n`` of equal bins, the last one closed; or of each value, if there are at most ``bins``. Infinite and
    NULL values take no part.
    """
    value = number_of(df, column)
    rows = df.select(value.alias("v")).where("v is not null").where(F.abs("v") < INF)
    span = rows.agg(F.min("v").alias("a"), F.max("v").alias("b"), F.approx_count_distinct("v").alias("about"))
    span = cut(span)
    few = span.first()["about"] <= 2 * bins + 10  # the estimate is off by a few percent, so near ones are counted exactly
    if few:
        counts = cut(rows.groupBy("v").agg(F.count("*").alias("n")))
        if counts.count() <= bins:
            return counts.select(F.lit(None).cast("long").alias("bin"), F.col("v").alias("low"), "n")
    width = (F.col("b") - F.col("a")) / bins
    bin_ = F.least(F.floor(F.try_divide(F.col("v") - F.col("a"), width)), F.lit(bins - 1))
    binned = rows.join(F.broadcast(span)).groupBy(bin_.cast("long").alias("bin"), "a", "b").agg(F.count("*").alias("n"))
    return binned.select("bin", (F.col("a") + F.col("bin") * width).alias("low"), "n")


def drift_range(first: DataFrame, second: DataFrame, columns: list[str], *, tail: float = 0.005) -> DataFrame:
    """``column, low, high`` of the union's central values, and both medians and means. A constant is padded by a
    twentieth of its size, or 1.
    """
    both = first.select(*columns, F.lit(1).alias("__side")).unionByName(second.select(*columns, F.lit(2).alias("__side")))
    v, side = F.col("value"), F.col("__side")
    cells = melt(both, columns, ["__side"])
    means = {"first_mean": F.avg(F.when(side == 1, v)), "second_mean": F.avg(F.when(side == 2, v))}
    out = measured_percentiles(cells, ["column"], means, {"low": tail, "high": 1 - tail}).join(_side_medians(cells), "column")
    low, high = F.col("low"), F.col("high")
    pad = F.when(low == high, F.when(low == 0, 1.0).otherwise(F.abs(low) * 0.05)).otherwise(0.0)
    return out.select("column", (low - pad).alias("low"), (high + pad).alias("high"), "first_median", "second_median", "first_mean", "second_mean")


def spread_by_label(df: DataFrame, column: str, label: str) -> DataFrame:
    """``label, p0, p25, p50, p75, p100``: what a violin or box plot of the column by label shows."""
    cells = df.select(F.col(label).alias("label"), number_of(df, column).alias("value"))
    at = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p100": 1.0}
    return with_percentiles(cells.select("label").distinct(), cells, ["label"], at)


def dominance_compare(first: DataFrame, second: DataFrame, columns: list[str], *, low: float = 0.9, high: float = 1.0) -> DataFrame:
    """``column, first_ratio, second_ratio, side``: columns whose dominant share is from low to high in both, or one."""
    a, b = (dominance(d, columns, least=low).where(F.col("dominant_ratio") <= high).select("column", F.col("dominant_ratio").alias(n)) for d, n in ((first, "first_ratio"), (second, "second_ratio")))
    side = F.when(F.col("second_ratio").isNull(), "first only").when(F.col("first_ratio").isNull(), "second only").otherwise("both")
    return a.join(b, "column", "full").withColumn("side", side)
