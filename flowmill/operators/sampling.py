"""Samples, caps, splits and interleaving that every run repeats: rows are drawn in the order of a stable hash.

Ranks within groups are exact and no group meets in one task: rows are dealt by group and the leading digits of their
hash, counted, and numbered within these pieces from the counts before them.
"""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions.expr import stable_hash, unit_draw
from flowmill.storage import bounded, cut

#: Leading hex digits of the hash that rows of a group are dealt by: 4096 pieces a group.
DIGITS = 3

#: Places in a block that make a piece, as a power of 2; rows that a task sorts to number them in file order.
PIECE_BITS, SORTED = 15, 1 << 18

#: Labels that are numbered in one task; more are sorted in parts.
MAX_LABELS = 100_000


def rank_by_hash(df: DataFrame, by: list[str], key: list[str], *, seed: int = 42, name: str = "place", most: int | None = None) -> DataFrame:
    """``df`` with each row's place (from 1) in its group, in the order of the stable hash of ``key``, then of key.

    With ``most``, only the rows up to that place: whole pieces behind it go before anything is shuffled or sorted.  The key
    should be unique within a group. NULL groups are groups.
    """
    hashed = df.withColumn("__hash", stable_hash([F.col(k) for k in key], seed)).withColumn("__piece", F.substring("__hash", 1, DIGITS))
    counts = hashed.groupBy(*by, "__piece").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(b).alias(f"__by{k}") for k, b in enumerate(by)], F.col("__piece").alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    same = F.col("__piece") == F.col("__at")
    for k, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"__by{k}"))
    within = Window.partitionBy(*by, "__piece").orderBy("__hash", *key)
    if most is not None:
        few = hashed.join(bounded(cut(starts.where(F.col("__start") < most))), same)
        ranked = few.withColumn(name, F.row_number().over(within) + F.col("__start")).where(F.col(name) <= most)
    else:
        ranked = hashed.withColumn("__row", F.row_number().over(within)).join(starts, same).withColumn(name, F.col("__row") + F.col("__start"))
    return ranked.select(*[F.col(f"`{c}`") for c in df.columns], name)


def file_order() -> Column:
    """Where a row stands in its files: file, start of the block that was read, place in it. Only right at a scan, before any shuffle;
    rows sort by it in the order of the files' names and of their lines, however the files are cut into blocks.
    """
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def rank_in_files(df: DataFrame, by: list[str], order: str, *, name: str = "place") -> DataFrame:
    """``df`` with each row's place (from 1) in its group, in file order (``order``: a column of :func:`file_order`).

    Rows are counted by group and piece (some thousand rows of a block that follow each other) and numbered within these from the
    counts before them, so no group meets in one task.  Pieces are dealt to as many tasks as keep each at SORTED rows or so.
    """
    at = F.col(order)["at"]
    rows = df.withColumn("__piece", F.struct(F.col(order)["file"].alias("file"), F.col(order)["block"].alias("block"), F.shiftright(at, PIECE_BITS).alias("at")))
    counts = cut(rows.groupBy(*by, "__piece").agg(F.count("*").alias("__n")))
    before = Window.partitionBy(*by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(b).alias(f"__by{k}") for k, b in enumerate(by)], F.col("__piece").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    same = F.col("__piece") == F.col("__of")
    for k, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"__by{k}"))
    within = Window.partitionBy(*by, "__piece").orderBy(at)
    tasks = (counts.agg(F.sum("__n")).first()[0] or 0) // SORTED + 1
    ranked = rows.repartition(tasks, *by, "__piece").withColumn("__row", F.row_number().over(within)).join(bounded(cut(starts)), same)
    return ranked.withColumn(name, F.col("__row") + F.col("__start")).select(*[F.col(f"`{c}`") for c in df.columns], name)


def split_in_files(df: DataFrame, label: str, ratio: float, order: str, *, name: str = "split") -> DataFrame:
    """As :func:`stratified_split`, but the rows that train are the first of each label in file order."""
    rows = df.where(F.col(label).isNotNull())
    counts = rows.groupBy(F.col(label).alias("__label")).agg(F.bround(F.count("*") * F.lit(ratio)).alias("__train"))
    ranked = rank_in_files(rows, [label], order, name="__place").join(bounded(cut(counts)), F.col(label) == F.col("__label"))
    return ranked.withColumn(name, F.when(F.col("__place") <= F.col("__train"), "train").otherwise("test")).drop("__label", "__train", "__place")


def number_rows(df: DataFrame, order: list[str | Column], *, name: str = "row") -> DataFrame:
    """``df`` with global row numbers from 1 in ``order`` (unique): sorted parts, counted, and numbered from the counts."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(parts.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")))
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = counts.select("__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    joined = placed.join(F.broadcast(starts), "__part")
    return joined.withColumn(name, F.col("__at") - F.col("__first") + F.col("__start") + 1).select(*[F.col(f"`{c}`") for c in df.columns], name)


def sample_rows(df: DataFrame, n: int, key: list[str], *, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer): those whose hashes come first in the whole table."""
    return rank_by_hash(df, [], key, seed=seed, name="__place", most=n).drop("__place")


def sample_fraction(df: DataFrame, fraction: float, key: list[str], *, seed: int = 42) -> DataFrame:
    """Each row with this probability, by its own hash: no count, no shuffle."""
    return df.where(unit_draw([F.col(k) for k in key], seed) < fraction)


def class_floor_cap(df: DataFrame, label: str, key: list[str], *, least: int, most: int, exempt: tuple[str, ...] = (), seed: int = 42) -> DataFrame:
    """Classes of under ``least`` rows are left out, those of over ``most`` cut to ``most``; exempt and NULL classes too are left out."""
    rows = df.where(F.col(label).isNotNull() & ~F.col(label).isin(*exempt) if exempt else F.col(label).isNotNull())
    counts = rows.groupBy(F.col(label).alias("__label")).agg(F.count("*").alias("__count")).where(F.col("__count") >= least)
    ranked = rank_by_hash(rows, [label], key, seed=seed, name="__place", most=most)
    return ranked.join(counts, F.col(label) == F.col("__label"), "left_semi").drop("__place")


def ratio_sample(rows: DataFrame, others: DataFrame, ratio: float, key: list[str], *, seed: int = 42) -> DataFrame:
    """At most ``ratio`` times as many of ``rows`` as ``others`` has."""
    return sample_rows(rows, floor(others.count() * ratio), key, seed=seed)


def downscale(df: DataFrame, is_normal: Column, fraction: float, key: list[str], *, seed: int = 42, null_label: str = "other") -> DataFrame:
    """A fraction of the normal rows and all others; rows without label are ``other`` or dropped."""
    keep = ~is_normal | (unit_draw([F.col(k) for k in key], seed) < fraction)
    return df.where(F.coalesce(keep, F.lit(null_label == "other")))


def shuffled(df: DataFrame, key: list[str], *, seed: int = 42) -> DataFrame:
    """All rows in the order of the stable hash."""
    return df.orderBy(stable_hash([F.col(k) for k in key], seed), *key)


def round_robin(df: DataFrame, source: str, key: list[str], *, seed: int = 42, name: str = "turn") -> DataFrame:
    """Rows with their turn: the first of each source, then the second of each, and so on; order by turn and source."""
    return rank_by_hash(df, [source], key, seed=seed, name=name)


def stratified_split(df: DataFrame, label: str, ratio: float, key: list[str], *, seed: int = 42, name: str = "split") -> DataFrame:
    """``df`` without NULL labels, and ``train`` or ``test``: round-half-even(count * ratio) rows of each label train."""
    rows = df.where(F.col(label).isNotNull())
    counts = rows.groupBy(F.col(label).alias("__label")).agg(F.bround(F.count("*") * F.lit(ratio)).alias("__train"))
    ranked = rank_by_hash(rows, [label], key, seed=seed, name="__place").join(counts, F.col(label) == F.col("__label"))
    return ranked.withColumn(name, F.when(F.col("__place") <= F.col("__train"), "train").otherwise("test")).drop("__label", "__train", "__place")


def folds(df: DataFrame, label: str, k: int, key: list[str], *, seed: int = 42, name: str = "fold") -> DataFrame:
    """Stratified folds 0 to k - 1."""
    ranked = rank_by_hash(df, [label], key, seed=seed, name="__place")
    return ranked.withColumn(name, F.pmod(F.col("__place") - 1, F.lit(k)).cast("int")).drop("__place")


def binary_label(label: str, normal: str = "benign") -> Column:
    """0 for the normal class (white space and case aside), 1 for others, NULL for NULL."""
    return F.when(F.col(label).isNotNull(), (F.lower(F.btrim(F.col(label), F.lit(" \t\r\n"))) != normal).cast("int"))


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """``label, code``: distinct labels numbered from 0 in order; up to MAX_LABELS in one task, more in sorted parts."""
    labels = cut(df.where(F.col(label).isNotNull()).select(F.col(label).alias("label")).distinct())
    if labels.count() > MAX_LABELS:
        return number_rows(labels, ["label"], name="code").withColumn("code", (F.col("code") - 1).cast("int"))
    return labels.withColumn("code", (F.row_number().over(Window.orderBy("label")) - 1).cast("int"))


def map_labels(df: DataFrame, label: str, codes: DataFrame, *, name: str = "code", unknown: int | None = None, max_broadcast: int = 100_000) -> DataFrame:
    """``df`` with the code of each label; labels that aren't in ``codes`` get ``unknown``."""
    small = codes.select(F.col("label").alias("__label"), F.col("code").alias(name))
    if small.limit(max_broadcast + 1).count() <= max_broadcast:
        small = F.broadcast(small)
    out = df.join(small, F.col(label) == F.col("__label"), "left").drop("__label")
    return out if unknown is None else out.withColumn(name, F.coalesce(name, F.lit(unknown)))
