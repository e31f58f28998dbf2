"""Exact percentiles by brackets against numpy's."""

import numpy as np
import pytest

from flowmill.operators.quantiles import group_percentiles

AT = [0.0, 0.005, 0.25, 0.5, 0.75, 0.995, 1.0]


def groups(seed=1):
    rng = np.random.default_rng(seed)
    return {
        "normal": rng.normal(size=4000), "few": rng.integers(0, 3, 3000).astype("f8"), "zeros": np.where(rng.random(3000) < 0.6, 0.0, rng.lognormal(size=3000)),
        "one": np.array([7.5]), "two": np.array([1.0, 2.0]), "same": np.full(500, -3.25), "infinite": np.concatenate([rng.normal(size=800), [np.inf] * 300]), None: rng.normal(size=101) * 1e9,
    }


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_percentiles_are_exact(spark, accuracy):
    data = groups()
    rows = [(g, float(v)) for g, x in data.items() for v in x] + [("none", None), ("few", None)]
    cells = spark.createDataFrame(rows, "g string, value double").repartition(5)
    got = {r["g"]: r["q"] for r in group_percentiles(cells, ["g"], AT, accuracy=accuracy).collect()}
    assert got.keys() == data.keys()
    for g, x in data.items():
        with np.errstate(invalid="ignore"):
            want = [v if np.isfinite(v) else np.inf for v in np.quantile(x, AT)] if g == "infinite" else np.quantile(x, AT)
        assert got[g] == pytest.approx(list(want), rel=1e-12, abs=1e-12), g


def test_no_rows_and_wrong_ranks(spark):
    assert group_percentiles(spark.createDataFrame([], "g string, value double"), ["g"], [0.5]).count() == 0
    with pytest.raises(ValueError, match="0 to 1"):
        group_percentiles(spark.range(1).selectExpr("'a' g", "1.0D value"), ["g"], [1.5])


def test_nothing_holds_a_column(spark):
    cells = spark.range(1000).selectExpr("'a' g", "double(id) value")
    plan = group_percentiles(cells, ["g"], [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "median(" not in plan and "collect_" not in plan


def plain(x, at):
    """Linear between ranks, NaN as the largest value, without arithmetic on equal neighbours."""
    x, out = np.sort(x), []
    for q in at:
        rank = (len(x) - 1) * q
        low, high = x[int(np.floor(rank))], x[int(np.ceil(rank))]
        same = low == high or (np.isnan(low) and np.isnan(high)) or np.floor(rank) == rank
        out.append(float(low) if same else float((np.ceil(rank) - rank) * low + (rank - np.floor(rank)) * high))
    return out


def adversarial(seed=2):
    rng = np.random.default_rng(seed)
    return {
        "infinite and nan": np.array([np.inf] * 100 + [np.nan] * 100), "mixed ends": np.concatenate([[-np.inf] * 70, rng.normal(size=100), [np.inf] * 60, [np.nan] * 40]), "sorted": np.arange(3000.0), "reversed": np.arange(3000.0)[::-1],
        "runs": np.repeat(rng.normal(size=7), 300), "run beside few": np.concatenate([np.full(2000, 5.0), rng.normal(size=30)]), "wide": rng.choice([-1, 1], 2500) * 10.0 ** rng.uniform(-300, 300, 2500), "tiny steps": 1.0 + np.arange(2000) * 2.0**-52,
    }


@pytest.mark.parametrize("accuracy, most", [(10, 1), (10, 40), (3, 7), (50, 200_000)])
def test_brackets_are_checked_and_narrowed(spark, accuracy, most):
    """Rough first brackets miss or hold too much; every group with values has its exact percentiles all the same."""
    data = adversarial()
    cells = spark.createDataFrame([(g, float(v)) for g, x in data.items() for v in x], "g string, value double")
    got = {r["g"]: r["q"] for r in group_percentiles(cells, ["g"], AT, accuracy=accuracy, most=most).collect()}
    for g, x in data.items():
        assert got[g] == pytest.approx(plain(x, AT), rel=1e-12, nan_ok=True), g


def test_measures_come_from_the_first_pass(spark):
    from pyspark.sql import functions as F

    cells = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("a", None), ("none", None)], "g string, value double")
    rows = group_percentiles(cells, ["g"], [0.5], measures={"cells": F.count("*"), "mean": F.avg("value")}).collect()
    assert {r["g"]: (r["q"], r["cells"], r["mean"]) for r in rows} == {"a": ([2.5], 3, 2.5), "none": (None, 1, None)}
