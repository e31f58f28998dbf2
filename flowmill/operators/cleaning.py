"""Rows and cells that don't belong: impossible values, sentinels, missing and infinite cells, text among numbers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.functions.expr import any_of, finite, finite_or_zero, has_keyword, is_inf, number_of
from flowmill.operators.profile import inf_profile, melt
from flowmill.operators.quantiles import group_percentiles
from flowmill.operators.schema import numeric_columns

#: Name parts of quantities that can't be negative, and of those that can. Fixed values.
NON_NEGATIVE = ("port", "duration", "count", "bytes", "size", "rate", "percentage", "variance", "std", "total", "max", "min", "median", "mode", "mean", "iat", "active", "idle", "bulk", "handshake", "subflow")
SIGNED = ("skew", "cov", "delta")
PORTS, MAX_PORT = ("src_port", "dst_port"), 65_535

SENTINEL = "not a complete handshake"


def invalid_row(df: DataFrame, *, keywords: tuple[str, ...] = NON_NEGATIVE, signed: tuple[str, ...] = SIGNED, ports: Iterable[str] = PORTS) -> Column:
    """True for rows with a negative value in a column named as non-negative, or a port outside 0 to 65535. A missing
    number is valid, a missing port isn't.
    """
    negative = [F.coalesce(number_of(df, n) < 0, F.lit(False)) for n in df.columns if has_keyword(n, keywords) and not has_keyword(n, signed)]
    wrong = [~F.coalesce(number_of(df, n).between(0, MAX_PORT), F.lit(False)) for n in df.columns if n.strip().lower() in set(ports)]
    return any_of([*negative, *wrong])


def validity_counts(df: DataFrame, invalid: Column) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if(invalid).alias("invalid"), F.count_if(~invalid).alias("valid"))


def drop_invalid(df: DataFrame, **options) -> DataFrame:
    return df.where(~invalid_row(df, **options))


def holds_sentinel(column: str, sentinel: str = SENTINEL) -> Column:
    return F.coalesce(F.lower(F.col(column).cast("string")).contains(sentinel), F.lit(False))


def sentinel_counts(df: DataFrame, column: str, label: str, sentinel: str = SENTINEL) -> DataFrame:
    """``label, valid, invalid`` rows by label."""
    hit = holds_sentinel(column, sentinel)
    return df.groupBy(F.col(label).alias("label")).agg(F.count_if(~hit).alias("valid"), F.count_if(hit).alias("invalid"))


def has_missing(df: DataFrame, columns: Iterable[str] | None = None) -> Column:
    return any_of([F.col(f"`{n}`").isNull() for n in columns or df.columns])


def missing_split(df: DataFrame, columns: Iterable[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows without NULL, rows with)."""
    hit = has_missing(df, columns)
    return df.where(~hit), df.where(hit)


def drop_all_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna("all", subset=columns)


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def drop_text_rows(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Without the rows that have text that is no number in one of the columns; missing cells stay."""
    return df.where(~any_of([F.col(f"`{n}`").isNotNull() & number_of(df, n).isNull() & (F.btrim(F.col(f"`{n}`").cast("string")) != "") for n in columns]))


def _replace(df: DataFrame, columns: Iterable[str], make) -> DataFrame:
    chosen = set(columns)
    return df.select(*[make(n).alias(n) if n in chosen else F.col(f"`{n}`") for n in df.columns])


def coerce_numbers(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The columns as doubles; what is no number is NULL."""
    return _replace(df, columns, lambda n: number_of(df, n))


def inf_to_null(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return _replace(df, columns, lambda n: finite(number_of(df, n)))


def inf_and_null_to_zero(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """First numbers, then infinite ones, then missing ones to 0: text like ``inf`` is caught, too."""
    return _replace(df, columns, lambda n: finite_or_zero(number_of(df, n)))


def null_to_zero(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the table with 0 for NULL, ``replaced``: the number of such cells)."""
    replaced = df.agg(sum((F.count_if(F.col(f"`{n}`").isNull()) for n in columns), F.lit(0).cast("long")).alias("replaced"))
    return df.fillna(0, subset=columns), replaced


def inf_to_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Infinite values as the median of the column's finite ones; missing values stay. The medians are one row, broadcast."""
    columns = list(columns)
    if not columns:
        return df
    cells = melt(inf_to_null(df.select(*[F.col(f"`{n}`") for n in columns]), columns), columns)
    medians = group_percentiles(cells, ["column"], [0.5])
    row = medians.agg(F.map_from_entries(F.collect_list(F.struct("column", F.col("q")[0]))).alias("__medians"))
    joined = df.join(F.broadcast(row))
    return _replace(joined, columns, lambda n: F.when(is_inf(number_of(df, n)), F.try_element_at("__medians", F.lit(n))).otherwise(number_of(df, n))).drop("__medians")


def drop_inf_columns(df: DataFrame, columns: list[str] | None = None, *, most: float = 0.30) -> DataFrame:
    """Without the columns whose share of infinite cells is over ``most``. The decision takes one small report."""
    report = inf_profile(df, columns or numeric_columns(df), coerce=True).where(F.col("ratio") > most).collect()
    return df.drop(*[r["column"] for r in report])


def handle_inf_columns(df: DataFrame, zero: Iterable[str] = (), delete: Iterable[str] = ()) -> DataFrame:
    """Chosen columns with infinities: set these to 0, or leave the column out."""
    return inf_and_null_to_zero(df, zero).drop(*delete)


def abnormal_iat(total: Column, duration: Column, *, most: float = 1000.0, times: float = 10.0) -> Column:
    """A total over ``most``, or over ``times`` the duration; missing values are not abnormal."""
    return F.coalesce(total > most, F.lit(False)) | F.coalesce(total > duration * times, F.lit(False))
