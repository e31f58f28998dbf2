"""Column expressions shared by the operators. All are built-in functions, so plans stay in generated code.

Missing is NULL only: NaN and infinities in input columns are turned to NULL, or counted, by the functions here.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text that counts as missing. Fixed values (the usual tokens of CSV readers).
NA_TOKENS = ("", "#N/A", "#NA", "-NaN", "-nan", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

#: What counts as a number in text: shared by Spark and SQL engines, unlike their own casts of ``1d`` or ``1_000``.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INFINITE = r"(?i)^[+-]?inf(inity)?$"

INF = float("inf")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def clean_text(c: Column) -> Column:
    """Without white space (also tabs and line ends) at both ends."""
    return F.btrim(c, F.lit(" \t\r\n\x0b\x0c"))


def blank_to_null(c: Column, tokens: tuple[str, ...] = NA_TOKENS) -> Column:
    text = clean_text(c)
    return F.when(~text.isin(*tokens), text)


def to_number(c: Column, kind: T.DataType | None = None) -> Column:
    """A double: numbers as they are, numeric and infinite text as numbers, other text and NaN NULL."""
    if kind is not None and isinstance(kind, T.NumericType):
        return F.nullif(c.cast("double"), F.lit(float("nan"))) if isinstance(kind, (T.DoubleType, T.FloatType)) else c.cast("double")
    text = clean_text(c.cast("string"))
    sign = F.when(F.startswith(text, F.lit("-")), F.lit(-INF)).otherwise(F.lit(INF))
    return F.when(text.rlike(NUMBER), text.try_cast("double")).when(text.rlike(INFINITE), sign)


def number_of(df: DataFrame, name: str) -> Column:
    return to_number(F.col(f"`{name}`"), df.schema[name].dataType)


def is_inf(c: Column) -> Column:
    return F.coalesce(F.abs(c) == INF, F.lit(False))


def finite(c: Column) -> Column:
    """NULL where infinite or NaN."""
    return F.when((F.abs(c) < INF) & ~F.isnan(c), c)


def finite_or_zero(c: Column) -> Column:
    return F.coalesce(finite(c), F.lit(0.0))


def value_type(c: Column) -> Column:
    """missing, integer, float, inf or string, of a value given as text."""
    text = blank_to_null(c)
    number = text.try_cast("double")
    return (
        F.when(text.isNull(), "missing").when(text.rlike(INFINITE), "inf").when(~text.rlike(NUMBER), "string")
        .when(F.abs(number) == INF, "inf").when(number == F.floor(number), "integer").otherwise("float")
    )


def label_key(c: Column) -> Column:
    """A label as compared: no white space around it, lower case."""
    return F.lower(clean_text(c.cast("string")))


def is_label(c: Column, *labels: str) -> Column:
    """NULL labels are none of them."""
    return F.coalesce(label_key(c).isin([x.strip().lower() for x in labels]), F.lit(False))


def stable_hash(key: Column | list[Column], seed: int = 42) -> Column:
    """32 hex digits that depend on key and seed only: a draw that every engine, run and partitioning repeats."""
    keys = key if isinstance(key, list) else [key]
    parts = [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws(":", *parts, F.lit(str(seed))).cast("binary"))


def unit_draw(key: Column | list[Column], seed: int = 42) -> Column:
    """[0, 1) from the first 12 digits of the stable hash."""
    return F.conv(F.substring(stable_hash(key, seed), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def file_safe(c: Column) -> Column:
    """Runs of characters other than letters, digits, ``_`` and ``-`` as one ``_``, none at the ends."""
    return F.btrim(F.regexp_replace(c, "[^A-Za-z0-9_-]+", "_"), F.lit("_"))


def plain_title(c: Column) -> Column:
    """Letters, digits, spaces and ``_`` only."""
    return F.regexp_replace(c, "[^0-9A-Za-z _]", "")


def has_keyword(name: str, words: tuple[str, ...]) -> bool:
    return re.search("|".join(map(re.escape, words)), name.lower()) is not None
