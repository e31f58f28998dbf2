"""CSV and Parquet readers: folders, declared or text schemas, missing tokens, headers, column lists, label maps."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmill.functions.expr import NA_TOKENS, blank_to_null, to_number
from flowmill.operators.sampling import file_order
from flowmill.operators.schema import unique_header
from flowmill.storage import cut

#: Lines of a column list or label map, which the driver reads; longer files are an error.
MAX_LINES = 100_000

#: Different headers in one folder; each is a scan of its own.
MAX_HEADERS = 1000


def _options(path: str | list[str], recursive: bool, pattern: str | None) -> dict[str, str]:
    """A file glob applies to folders only, so it is left out where a path already is one."""
    return {"recursiveFileLookup": str(recursive).lower()} | ({"pathGlobFilter": pattern} if pattern else {})


def headers(spark: SparkSession, path: str | list[str], *, recursive: bool = True, pattern: str | None = "*.[cC][sS][vV]", sep: str = ",") -> DataFrame:
    """``file, names, n_columns`` of every CSV file: a job of a task for some files each, which reads only the first line of each.

    Names are trimmed, without quotes and a byte-order mark, as they stand otherwise; files of no bytes are left out.  Files are opened
    through ``pyarrow.fs`` (local or mounted, S3, GCS, HDFS), compressed ones by their ending.
    """
    listed = spark.read.format("binaryFile").options(**_options(path, recursive, pattern)).load(path).select(F.col("path").alias("file"), "length")
    listed = listed.repartition(spark.sparkContext.defaultParallelism, "file")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(0).to_pylist()
            names = [_first_names(f, sep) if n else [] for f, n in zip(files, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(names, pa.list_(pa.string())), pa.array([len(x) for x in names], pa.int64())], ["file", "names", "n_columns"])

    return listed.mapInArrow(probe, "file string, names array<string>, n_columns long")


def _first_names(uri: str, sep: str) -> list[str]:
    """The names in a CSV file's first line."""
    fs, path = pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", quote(uri, safe=":/")))
    with fs.open_input_stream(path) as raw, io.TextIOWrapper(io.BufferedReader(raw), encoding="utf-8-sig", errors="replace", newline="") as text:
        return [x.strip() for x in next(csv.reader([text.readline()], delimiter=sep), [])]


def header_groups(found: DataFrame, *, most: int = MAX_HEADERS) -> list[tuple[list[str], list[str]]]:
    """(names, files) of each different header of :func:`headers`, by the first file's name; files without names are left out."""
    grouped = found.where("n_columns > 0").groupBy("names").agg(F.sort_array(F.collect_list("file")).alias("files"))
    rows = grouped.limit(most + 1).collect()  # names of files, which the driver lists for a scan in any case
    if len(rows) > most:
        raise ValueError(f"more than {most} different headers")
    return sorted(((r["names"], r["files"]) for r in rows), key=lambda g: g[1][0])


def read_csv_text(spark: SparkSession, path: str | list[str], *, recursive: bool = True, pattern: str | None = "*.[cC][sS][vV]", source_col: str | None = None, order_col: str | None = None, sep: str = ",") -> DataFrame:
    """All columns as text, as written; missing only where empty. ``source_col``: adds each row's file; ``order_col``: its place in the
    files (:func:`flowmill.operators.sampling.file_order`).

    Files may have different headers: there is one scan for those that have the same, and scans are united by name (a trimmed
    name's case is that of its first file; of columns of one name in a file the first counts).  What a file lacks is NULL.
    """
    spelled: dict[str, str] = {}
    parts, added = [], [n for n in (source_col, order_col) if n]
    for names, files in header_groups(headers(spark, path, recursive=recursive, pattern=pattern, sep=sep)):
        keep = unique_header(names)
        raw = spark.read.schema(T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(names))])).csv([_escaped(f) for f in files], header=True, sep=sep)
        columns = {}
        for k in keep:
            columns.setdefault(spelled.setdefault(names[k].lower(), names[k]), F.col(f"c{k}"))
        more = {source_col: F.col("_metadata.file_path"), order_col: file_order()}
        parts.append(raw.select(*[c.alias(n) for n, c in columns.items()], *[more[n].alias(n) for n in added]))
    if not parts:
        place = T.StructType([T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("at", T.LongType())])
        return spark.createDataFrame([], T.StructType([T.StructField(n, place if n == order_col else T.StringType()) for n in added]))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return whole.select(*[F.col(f"`{n}`") for n in [*spelled.values(), *added]])


def _escaped(file: str) -> str:
    """A file's name as a path that isn't read as a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", file)


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str, *, recursive: bool = True, pattern: str | None = "*.[cC][sS][vV]", na_tokens: Iterable[str] = NA_TOKENS, source_col: str | None = None) -> DataFrame:
    """Columns of one declared schema, found by name in each file. Cells of ``na_tokens``, and text in numeric columns, are NULL.

    Types are never inferred, so a file's first rows can't change another file's types.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    raw = read_csv_text(spark, path, recursive=recursive, pattern=pattern, source_col=source_col)
    have, tokens, out = {c.strip().lower(): c for c in raw.columns}, tuple(na_tokens), []
    for f in kind.fields:
        if f.name.lower() not in have:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        text = blank_to_null(F.col(f"`{have[f.name.lower()]}`"), tokens)
        value = to_number(text) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else text
        out.append(value.try_cast(f.dataType).alias(f.name))
    return raw.select(*out, *([source_col] if source_col else []))


def file_counts(spark: SparkSession, path: str | list[str], *, recursive: bool = True, pattern: str | None = "*.[cC][sS][vV]", sep: str = ",") -> DataFrame:
    """``source, n_rows, n_columns`` of every CSV file, each with the columns of its own header; files without rows, too."""
    found = cut(headers(spark, path, recursive=recursive, pattern=pattern, sep=sep))
    counts = [
        spark.read.schema(T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(names))])).csv([_escaped(f) for f in files], header=True, sep=sep).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n_rows"))
        for names, files in header_groups(found)
    ]
    if not counts:
        return found.select(F.col("file").alias("source"), F.lit(0).cast("long").alias("n_rows"), "n_columns")
    rows = reduce(DataFrame.unionAll, counts).select(_plain(F.url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B")))).alias("of"), "n_rows")  # escaped there
    return found.join(rows, _plain(F.col("file")) == F.col("of"), "left").select(F.col("file").alias("source"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "n_columns")


def _plain(file: Column) -> Column:
    """A file's path, whether it is written file:/x or file:///x."""
    return F.regexp_replace(file, "^file:/+", "file:/")


def mark_missing(df: DataFrame, tokens: Iterable[str]) -> DataFrame:
    """Text columns with cells of these tokens (as they are, white space around them ignored) as NULL."""
    tokens = tuple(tokens)
    return df.select(*[F.when(~F.btrim(F.col(f"`{n}`")).isin(*tokens), F.col(f"`{n}`")).alias(n) if t == "string" else F.col(f"`{n}`") for n, t in df.dtypes])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float columns as NULL; to be done once, where data come in."""
    return df.select(*[F.nullif(F.col(f"`{n}`"), F.lit(float("nan")).cast(t)).alias(n) if t in ("double", "float") else F.col(f"`{n}`") for n, t in df.dtypes])


def raw_header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """The first line's names, as they stand in the file, with repeats; a byte-order mark is left out."""
    first = spark.read.text(path).first()
    return [] if first is None else [x.strip().strip('"') for x in first[0].lstrip("﻿").split(sep)]


def row_counts(df: DataFrame, source_col: str | None = None) -> DataFrame:
    """``source, n_rows, n_columns`` by file (or for all rows, without ``source_col``) of a table; of CSV files, see :func:`file_counts`."""
    columns = len([c for c in df.columns if c != source_col])
    grouped = df.groupBy(F.col(source_col).alias("source")) if source_col else df.groupBy()
    return grouped.agg(F.count("*").alias("n_rows"), F.lit(columns).cast("long").alias("n_columns"))


def preview(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def read_unique(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as text, of columns of one name only the first: also of ``x`` and ``x.1``, and where case differs by nothing."""
    names = raw_header(spark, path, sep)
    keep = unique_header(names)
    raw = spark.read.schema(", ".join(f"c{k} string" for k in range(len(names)))).csv(path, header=True, sep=sep)
    return raw.select(*[F.col(f"c{k}").alias(names[k]) for k in keep])


def _lines(spark: SparkSession, path: str, most: int) -> list[str]:
    """The lines of a small text file, in order; it is an error if there are more than ``most``."""
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id()).orderBy("n").limit(most + 1).collect()
    if len(lines) > most:
        raise ValueError(f"{path} has more than {most} lines")
    return [r[0] for r in lines]


def read_column_list(spark: SparkSession, path: str, *, most: int = MAX_LINES) -> list[str]:
    """Names of a small text file: one or several (by commas) a line, ``#`` starts a comment."""
    return [n for line in _lines(spark, path, most) for x in line.split("#")[0].split(",") if (n := x.strip())]


def read_label_map(spark: SparkSession, path: str, skip: int = 2, *, most: int = MAX_LINES) -> DataFrame:
    """``label, code`` of a text file of ``name : number`` lines after ``skip`` header lines. A name may hold colons."""
    pairs = [(a.strip(), int(b)) for a, _, b in (x.rpartition(":") for x in _lines(spark, path, most)[skip:] if x.strip())]
    return spark.createDataFrame(pairs, "label string, code int")
