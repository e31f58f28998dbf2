"""Evaluation of predictions: confusion counts, reports by class, anomaly reports, confidence thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.functions.expr import safe_ratio
from flowmill.storage import cut

UNKNOWN = "Unknown_Zero_Day_Attack"

#: Labels of a confusion grid, which has their square of rows.
MAX_LABELS = 5_000


def confusion(df: DataFrame, truth: str, prediction: str, labels: DataFrame | None = None) -> DataFrame:
    """``truth, prediction, n`` over the full grid of labels, 0 where nothing fell. Rows without a true label, or with one
    that isn't in ``labels`` (column label), are left out. The grid is the labels', not the rows'; it is an error if there are more
    than MAX_LABELS.
    """
    counts = cut(df.where(F.col(truth).isNotNull()).groupBy(F.col(truth).alias("truth"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n")))
    if labels is None:
        labels = counts.select(F.explode(F.array("truth", "prediction")).alias("label")).where("label is not null").distinct()
    label = labels.select("label").distinct()
    if label.limit(MAX_LABELS + 1).count() > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    grid = label.select(F.col("label").alias("t")).join(F.broadcast(label.select(F.col("label").alias("p"))))
    joined = grid.join(counts, (F.col("t") == F.col("truth")) & (F.col("p") == F.col("prediction")), "left")
    return joined.select(F.col("t").alias("truth"), F.col("p").alias("prediction"), F.coalesce("n", F.lit(0)).alias("n"))


def class_report(matrix: DataFrame) -> DataFrame:
    """``label, precision, recall, f1, support`` from a full confusion grid; 0 where a divisor is 0."""
    rows = matrix.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0)).alias("hits"))
    said = matrix.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("said"))
    joined = rows.join(said, "label")
    p, r = safe_ratio(F.col("hits"), F.col("said")), safe_ratio(F.col("hits"), F.col("support"))
    return joined.select("label", p.alias("precision"), r.alias("recall"), safe_ratio(2 * p * r, p + r).alias("f1"), "support")


def macro_average(report: DataFrame) -> DataFrame:
    """The unweighted means of a class report, and all its support."""
    return report.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support"))


def macro_f1_by(df: DataFrame, by: str, truth: str, prediction: str) -> DataFrame:
    """``by, f1``: the unweighted mean of the labels' F1 (as of a class report) for each value of ``by``, from counts of pairs that
    occur. Rows without a true label are left out.
    """
    counts = df.where(F.col(truth).isNotNull()).groupBy(F.col(by), F.col(truth).alias("truth"), F.col(prediction).alias("said")).agg(F.count("*").alias("n"))
    none = F.lit(0).cast("long")
    hits = F.when(F.col("truth") == F.col("said"), F.col("n")).otherwise(0)
    sides = F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), none.alias("said"), hits.alias("hits")), F.struct(F.col("said").alias("label"), none.alias("support"), F.col("n").alias("said"), none.alias("hits")))
    sums = counts.select(by, F.inline(sides)).where("label is not null").groupBy(by, "label").agg(*[F.sum(c).alias(c) for c in ("support", "said", "hits")])
    p, r = safe_ratio(F.col("hits"), F.col("said")), safe_ratio(F.col("hits"), F.col("support"))
    return sums.select(by, safe_ratio(2 * p * r, p + r).alias("f1")).groupBy(by).agg(F.avg("f1").alias("f1"))


def accuracy(matrix: DataFrame) -> DataFrame:
    return matrix.agg(safe_ratio(F.sum(F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))


def anomaly_report(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """``tp, fp, fn, tn, precision, recall, f1, accuracy`` of two conditions that are true for anomalies."""
    row = df.agg(F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth & ~predicted).alias("fn"), F.count_if(~truth & ~predicted).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    return row.select("tp", "fp", "fn", "tn", p.alias("precision"), r.alias("recall"), safe_ratio(2 * p * r, p + r).alias("f1"), safe_ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def named_prediction(code: Column, confidence: Column, names: dict[int, str], *, least: float = 0.60, unknown: str = UNKNOWN) -> Column:
    """The class of a code: ``unknown`` strictly under the least confidence, ``Unknown_Class_n`` for a code without a name."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.create_map().cast("map<int,string>")
    name = F.coalesce(F.try_element_at(table, code.cast("int")), F.concat(F.lit("Unknown_Class_"), code.cast("int").cast("string")))
    return F.when(confidence < least, F.lit(unknown)).otherwise(name)


def mean_by_two(df: DataFrame, rows: str, columns: str, value: str, values: list | None = None) -> DataFrame:
    """The mean by two keys, the second's values as columns: a tuning heat map."""
    return df.groupBy(rows).pivot(columns, values).agg(F.avg(value))


def lowest(df: DataFrame, column: str, n: int, tie: list[str]) -> DataFrame:
    """The n rows of the lowest value; each task sends its n lowest only."""
    return df.where(F.col(column).isNotNull()).orderBy(column, *tie).limit(n)


def highest(df: DataFrame, column: str, n: int, tie: list[str]) -> DataFrame:
    return df.where(F.col(column).isNotNull()).orderBy(F.desc(column), *tie).limit(n)
