"""Training sets, interleaved parts, drift samples and held-out reports, composed of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.functions.expr import is_label
from flowmill.operators import cleaning, evaluate, models, sampling
from flowmill.operators.dedup import distinct_rows
from flowmill.operators.schema import align, normalize_columns, require_columns


def binary_training_set(normal: DataFrame, attacks: DataFrame, label: str, key: list[str], *, least: int = 500, most: int = 30_000, ratio: float = 2.0, normal_label: str = "benign", seed: int = 42) -> DataFrame:
    """Distinct rows of both; attack classes floored and capped, normal rows at most ``ratio`` times these; label 0 or 1."""
    kept = sampling.class_floor_cap(distinct_rows(attacks), label, key, least=least, most=most, seed=seed)
    few = sampling.ratio_sample(distinct_rows(normal), kept, ratio, key, seed=seed)
    a, b = align(few, kept)
    return a.unionByName(b).withColumn(label, sampling.binary_label(label, normal_label))


def multiclass_training_set(attacks: DataFrame, label: str, features: list[str], key: list[str], *, least: int = 500, most: int = 30_000, normal_label: str = "Benign", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(the features and the label's code of the attack rows, floored and capped; ``label, code``)."""
    rows = sampling.class_floor_cap(distinct_rows(normalize_columns(attacks)), label, key, least=least, most=most, exempt=(normal_label,), seed=seed)
    codes = sampling.label_codes(rows, label)
    coded = sampling.map_labels(rows, label, codes, name="__code").withColumn(label, F.col("__code"))
    return require_columns(coded, [*features, label]), codes


def interleaved_parts(df: DataFrame, label: str, source: str, key: list[str], rows: int, *, mode: str = "both", normal_label: str = "benign", max_rows: int | None = None, seed: int = 42) -> DataFrame:
    """Rows of one kind (``normal``, ``attacks`` or ``both``; NULL labels are neither) with ``turn`` and ``part``: sources take
    turns, and parts have ``rows`` rows each in that order.
    """
    if mode not in ("normal", "attacks", "both"):
        raise ValueError("mode is normal, attacks or both")
    normal = is_label(F.col(label), normal_label)
    kind = {"normal": normal, "attacks": ~normal, "both": F.lit(True)}[mode]
    turns = sampling.round_robin(df.where(F.col(label).isNotNull() & kind), source, key, seed=seed)
    numbered = sampling.number_rows(turns, ["turn", source, *key], name="__at")
    capped = numbered if max_rows is None else numbered.where(F.col("__at") <= max_rows)
    return capped.withColumn("part", F.floor((F.col("__at") - 1) / rows).cast("long")).drop("__at")


def drift_sample(df: DataFrame, columns: list[str], label: str, normal_label: str, n: int, key: list[str], *, seed: int = 42) -> DataFrame:
    """At most ``n`` rows of one class, their columns as finite numbers; rows without any number are left out first."""
    rows = df.where(is_label(F.col(label), normal_label)).select(*key, *[F.col(f"`{c}`") for c in columns])
    numbers = cleaning.drop_all_missing(cleaning.inf_to_null(rows, columns), columns)
    return sampling.sample_rows(numbers, n, key, seed=seed)


def holdout_report(df: DataFrame, label: str, features: list[str], key: list[str], *, ratio: float = 0.8, seed: int = 42, **options) -> DataFrame:
    """The class report of a forest on the rows held out of a stratified split."""
    split = sampling.stratified_split(df, label, ratio, key, seed=seed, name="__split")
    trained = models.train_forest(split.where("__split = 'train'"), label, features, seed=seed, **options)
    scored = models.score(trained, split.where("__split = 'test'"), [F.col(label).cast("string").alias("truth")])
    return evaluate.class_report(evaluate.confusion(scored, "truth", "predicted_label"))
