"""Exact duplicates and differences of tables, by whole rows (NULL equals NULL), never by a hash alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.functions.expr import stable_hash


def distinct_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One of each row (or of each value of the columns); rows are merged in every task before they shuffle."""
    return df.dropDuplicates(columns) if columns else df.distinct()


def first_rows(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Of the rows with equal ``columns`` the first in ``order`` (which should be unique): a minimum, not a sort of groups."""
    rest = [c for c in df.columns if c not in columns]
    best = df.groupBy(*columns).agg(F.min(F.struct(*order, *[F.struct(*rest).alias("__rest")] if rest else [])).alias("__best"))
    return best.select(*[F.col(c) if c in columns else F.col(f"__best.__rest.{c}") for c in df.columns])


def duplicate_counts(df: DataFrame) -> DataFrame:
    """``n_rows, n_distinct, duplicates``."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    return groups.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicates"))


def top_duplicates(df: DataFrame, n: int = 10) -> DataFrame:
    """The most repeated rows with ``n_copies``, ties by the rows themselves."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("n_copies")).where("n_copies > 1")
    return groups.orderBy(F.desc("n_copies"), *df.columns).limit(n)


def missing_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distinct rows of the first table that the second lacks (columns by name, of the first)."""
    return first.subtract(second.select(*[F.col(f"`{c}`") for c in first.columns]))


def sample_missing(first: DataFrame, second: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` of these rows in their own order."""
    return missing_rows(first, second).orderBy(*first.columns).limit(n)


def difference_counts(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """``raw_distinct, processed_distinct, missing, extra``, from one full comparison of the distinct rows."""
    a = raw.distinct().withColumn("__raw", F.lit(1)).withColumn("__processed", F.lit(0))
    b = processed.select(*[F.col(f"`{c}`") for c in raw.columns]).distinct().withColumn("__raw", F.lit(0)).withColumn("__processed", F.lit(1))
    rows = a.unionByName(b).groupBy(*raw.columns).agg(F.max("__raw").alias("__raw"), F.max("__processed").alias("__processed"))
    return rows.agg(
        F.count_if(F.col("__raw") == 1).alias("raw_distinct"), F.count_if(F.col("__processed") == 1).alias("processed_distinct"),
        F.count_if(F.col("__processed") == 0).alias("missing"), F.count_if(F.col("__raw") == 0).alias("extra"),
    )


def row_key(df: DataFrame, seed: int = 0):
    """A text key of whole rows for stable orders where a table has no key of its own."""
    return stable_hash([F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in df.columns], seed)
