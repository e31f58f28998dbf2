"""Column names and projections: normalising, aliases, required columns, drop lists, comparisons of schemas."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of one quantity under two exporters. Fixed values.
ALIASES = {"segment_size_mean": "avg_segment_size", "fwd_segment_size_mean": "fwd_avg_segment_size"}


def normal_name(name: str, aliases: Mapping[str, str] | None = None) -> str:
    name = name.strip().lower()
    return (aliases or {}).get(name, name)


def duplicate_names(names: Iterable[str], aliases: Mapping[str, str] | None = None) -> list[str]:
    """Names that occur more than once after normalising, in order."""
    counts = Counter(normal_name(n, aliases) for n in names)
    return [n for n, k in counts.items() if k > 1]


def normalize_columns(df: DataFrame, aliases: Mapping[str, str] | None = None, on_duplicate: str = "error") -> DataFrame:
    """Names stripped and in lower case, aliases replaced. ``on_duplicate``: error, first or last of one name stays."""
    names = [normal_name(n, aliases) for n in df.columns]
    if (twice := duplicate_names(df.columns, aliases)) and on_duplicate == "error":
        raise ValueError(f"columns that are the same after normalising: {twice}")
    df = df.toDF(*[f"c{k}" for k in range(len(names))])
    place = {}
    for k, n in enumerate(names):
        if n not in place or on_duplicate == "last":
            place[n] = k
    return df.select(*[F.col(f"c{k}").alias(n) for n, k in place.items()])


def find_label(df: DataFrame, label: str = "label") -> str:
    """The column's real name, whatever its case and the spaces around it."""
    found = [c for c in df.columns if c.strip().lower() == label]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns are named {label}")
    return found[0]


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Exactly these columns, in this order; an error names all that are missing."""
    names = list(names)
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(f"`{n}`") for n in names])


def forbid_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """An error if a column that leaks the answer is among the features."""
    have = {c.strip().lower() for c in df.columns}
    if leaks := [n for n in names if n in have]:
        raise ValueError(f"columns that must not be in the input: {leaks}")
    return df


def reindex(df: DataFrame, features: Iterable[str], fill: float = 0.0) -> DataFrame:
    """The features in order; absent ones are ``fill``, others are dropped."""
    return df.select(*[F.col(f"`{n}`") if n in df.columns else F.lit(fill).alias(n) for n in features])


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Without the listed columns, compared as normalised; absent ones don't matter."""
    gone = {normal_name(n) for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if normal_name(c) not in gone])


def drop_report(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``column, found`` for each name of a drop list."""
    have = {normal_name(c) for c in df.columns}
    rows = [(n, normal_name(n) in have) for n in dict.fromkeys(names)]
    return df.sparkSession.createDataFrame(rows, "column string, found boolean")


def deletion_summary(spark: SparkSession, files: dict[str, Iterable[str]], names: Iterable[str]) -> DataFrame:
    """``file, found_count, not_found_count, removed_columns, requested_missing`` of a drop list and each file's columns."""
    wanted = list(dict.fromkeys(names))
    rows = []
    for file, columns in files.items():
        columns, asked = list(columns), {normal_name(n) for n in wanted}
        have = {normal_name(c) for c in columns}
        missing = [n for n in wanted if normal_name(n) not in have]
        rows.append((file, len(wanted) - len(missing), len(missing), [c for c in columns if normal_name(c) in asked], missing))
    return spark.createDataFrame(rows, "file string, found_count int, not_found_count int, removed_columns array<string>, requested_missing array<string>")


def deletion_list(base: Iterable[str], add: Iterable[str] = (), keep: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """(names to drop, names given more than once): base, then add, without keep; first occurrence wins."""
    keep = {normal_name(n) for n in keep}
    names = [normal_name(n) for n in [*base, *add]]
    return [n for n in dict.fromkeys(names) if n not in keep], [n for n, k in Counter(names).items() if k > 1]


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns of both, in the order of the first."""
    other = set(b.columns)
    return [c for c in a.columns if c in other]


def align(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    names = common_columns(a, b)
    return require_columns(a, names), require_columns(b, names)


def numeric_columns(df: DataFrame, without: Iterable[str] = ()) -> list[str]:
    without = set(without)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in without]


def availability(spark: SparkSession, wanted: Iterable[str], first: Iterable[str], second: Iterable[str]) -> DataFrame:
    """``column, status``: both, first only, second only or neither."""
    a, b = ({normal_name(x) for x in names} for names in (first, second))
    kinds = {(True, True): "both", (True, False): "first only", (False, True): "second only", (False, False): "neither"}
    return spark.createDataFrame([(n, kinds[normal_name(n) in a, normal_name(n) in b]) for n in wanted], "column string, status string")


def unique_header(names: list[str]) -> list[int]:
    """Positions of the columns to keep of a raw header with repeated names: the first of each, also of ``x`` and ``x.1``."""
    seen: dict[str, int] = {}
    for k, n in enumerate(names):
        base = m[1] if (m := re.fullmatch(r"(.+)\.\d+", n.strip())) and m[1] in {x.strip() for x in names} else n.strip()
        seen.setdefault(base, k)
    return list(seen.values())


def same_columns(df: DataFrame, names: Iterable[str]) -> bool:
    """Equal names in equal order."""
    return df.columns == list(names)


def schema_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """``column, first_type, second_type, status`` for each column of either, status: same, type, first only, second only."""
    left, right = dict(a.dtypes), dict(b.dtypes)
    rows = []
    for n in [*left, *[x for x in right if x not in left]]:
        status = "second only" if n not in left else "first only" if n not in right else "same" if left[n] == right[n] else "type"
        rows.append((n, left.get(n), right.get(n), status))
    return a.sparkSession.createDataFrame(rows, "column string, first_type string, second_type string, status string")
