"""Pairwise-complete Pearson correlation of columns, and groups of columns that are correlated."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.functions.expr import finite, number_of


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``first, second, r`` of each pair, in the order of ``columns``. Infinite values count as missing.

    Sums are taken as matrices in every task (a Gram matrix a batch), then added up.  r is NULL where a column is constant over
    the pair's rows: its spread there is under 1e-12 of the squares around the column's mean, which is as far as doubles tell.
    """
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "first string, second string, r double")
    return _by_matrices(df.select(*[finite(number_of(df, n)).alias(f"v{k}") for k, n in enumerate(columns)]), columns)


def _by_matrices(values: DataFrame, columns: list[str]) -> DataFrame:
    many = len(columns)
    # Sums of squares lose digits far from 0, so a rough centre is taken off first.
    centre = np.array([x if x is not None else 0.0 for x in values.agg(*[F.avg(f"v{k}") for k in range(many)]).first()])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, many, many))
        for batch in batches:
            x = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns], axis=1) - centre
            known = (~np.isnan(x)).astype("f8")
            x = np.nan_to_num(x)
            squares = x * x
            total += np.stack([known.T @ known, x.T @ known, known.T @ x, squares.T @ known, known.T @ squares, x.T @ x])
        first, second = np.triu_indices(many, 1)
        yield pa.RecordBatch.from_arrays([pa.array(first.astype("i4")), pa.array(second.astype("i4")), *[pa.array(t[first, second]) for t in total]], ["a", "b", "n", "sx", "sy", "sxx", "syy", "sxy"])

    parts = values.mapInArrow(sums, "a int, b int, n double, sx double, sy double, sxx double, syy double, sxy double")
    whole = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    spread = lambda s, ss: F.col("n") * F.col(ss) - F.col(s) * F.col(s)
    tiny = 1e-12
    flat = (spread("sx", "sxx") <= tiny * F.col("n") * F.col("sxx")) | (spread("sy", "syy") <= tiny * F.col("n") * F.col("syy"))
    r = F.when(~flat, F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt(spread("sx", "sxx") * spread("sy", "syy"))))
    names = F.array(*map(F.lit, columns))
    return whole.select(names[F.col("a")].alias("first"), names[F.col("b")].alias("second"), r.alias("r"))


def correlation_groups(pairs: DataFrame, *, least: float = 0.85) -> list[list[str]]:
    """Connected groups of columns, by pairs with ``abs(r) >= least``; sorted, the first of each stands for it. The graph's
    nodes are columns, so it is small.
    """
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for e in pairs.where(F.abs("r") >= least).select("first", "second").collect():
        a, b = sorted((root(e["first"]), root(e["second"])))
        parent[b] = a
    groups: dict[str, list[str]] = {}
    for x in list(parent):
        groups.setdefault(root(x), []).append(x)
    return sorted(sorted(g) for g in groups.values())


def group_report(pairs: DataFrame, groups: list[list[str]], *, least: float = 0.85) -> DataFrame:
    """``group, first, second, r, is_edge``: every pair within a group, also those under the threshold."""
    rows = [(k, x) for k, g in enumerate(groups) for x in g]
    of = pairs.sparkSession.createDataFrame(rows, "group int, member string")
    a, b = of.select(F.col("group"), F.col("member").alias("first")), of.select(F.col("group").alias("other"), F.col("member").alias("second"))
    inside = pairs.join(F.broadcast(a), "first").join(F.broadcast(b), "second").where("group = other")
    return inside.select("group", "first", "second", "r", F.coalesce(F.abs("r") >= least, F.lit(False)).alias("is_edge"))


def drop_correlated(df: DataFrame, columns: list[str], *, least: float = 0.85) -> DataFrame:
    """Of each group of correlated columns only the first stays; all other columns stay, too."""
    groups = correlation_groups(correlations(df, columns), least=least)
    return df.drop(*[x for g in groups for x in g[1:]])
