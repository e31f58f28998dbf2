"""Writers: parts of exact size, one folder a class, capped outputs, reports, label maps."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.operators.sampling import number_rows


def run_folder(base: str) -> str:
    """A folder that no other run writes to."""
    return f"{base.rstrip('/')}/run-{uuid.uuid4().hex[:12]}"


def write_csv(df: DataFrame, path: str, *, max_rows: int | None = None, order: list[Column] | None = None) -> None:
    """CSV parts with headers; with ``max_rows`` the first rows in ``order``. Never overwrites."""
    out = df.orderBy(*order) if order and max_rows is not None else df
    (out if max_rows is None else out.limit(max_rows)).write.mode("errorifexists").csv(path, header=True)


def split_parts(df: DataFrame, rows: int, order: list[str], *, name: str = "part") -> DataFrame:
    """``df`` with the number of its part: ``rows`` rows each, in ``order``, the last part shorter."""
    if rows < 1:
        raise ValueError("a part has at least one row")
    numbered = number_rows(df, order, name="__row")
    return numbered.withColumn(name, F.floor((F.col("__row") - 1) / rows).cast("long")).drop("__row")


def write_parts(df: DataFrame, path: str, rows: int, order: list[str]) -> None:
    """One folder ``part=n`` for each part of exactly ``rows`` rows."""
    split_parts(df, rows, order).write.mode("errorifexists").partitionBy("part").csv(path, header=True)


def write_by_class(df: DataFrame, path: str, label: Column, *, name: str = "class") -> None:
    """One folder a class, so that later readers of one class read its files only."""
    df.withColumn(name, label).write.mode("errorifexists").partitionBy(name).parquet(path)


def write_label_map(labels: DataFrame, path: str) -> None:
    """``label, code`` as JSON lines: no separator that a label could contain."""
    labels.coalesce(1).write.mode("errorifexists").json(path)


def report_text(report: DataFrame, title: str, limit: int = 1000) -> str:
    """A small report as aligned text; at most ``limit`` rows are shown."""
    rows = [[("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r] for r in report.limit(limit).collect()]
    table = [report.columns, *rows]
    widths = [max(len(r[k]) for r in table) for k in range(len(report.columns))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in table]
    return "\n".join([title, "=" * len(title), lines[0], "-" * len(lines[0]), *lines[1:]]) + "\n"
