"""Every registered query of the library against its SQL, over the smallest tables."""

import pytest
from pyspark.sql import functions as F

from flowmill.plans.catalogue import QUERIES, SQL
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    compare(spark, SF, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", ["boosting_importance", "isolation_forest"])
def test_model_queries_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_models_use_whole_embeddings(spark, tmp_path):
    from flowmill.plans import catalogue

    raw = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = catalogue.embedded(spark, SF)
    assert rows.columns == ["vec_id", "label", *[f"e{k}" for k in range(64)]] and rows.count() == raw.count()
    one = rows.orderBy("vec_id").first()
    assert list(one)[2:] == list(raw.orderBy("vec_id").first()["embedding"])
    assert {r["feature"] for r in QUERIES["boosting_importance"](spark, SF).collect()} == set(catalogue.DIMS)
    raw.limit(5).withColumn("embedding", F.slice("embedding", 1, 8)).write.parquet(f"{tmp_path}/embeddings.parquet")
    with pytest.raises(Exception, match="64 components"):
        catalogue.embedded(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("rows", [0, 600])
def test_csv_discovery_by_many_tasks(spark, tmp_path, monkeypatch, rows):
    """Several tasks write the file of a flag; rows without a flag are counted, but are no file."""
    from flowmill.plans import catalogue

    items = spark.range(0, rows, 1, 3).select(F.col("id").alias("l_orderkey"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("a/"), (F.col("id") % 3).cast("string"))).alias("l_returnflag"))
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(catalogue, "_folder", lambda spark: f"{tmp_path}/out")
    assert tuple(catalogue.csv_discovery(spark, str(tmp_path)).first()) == (2 if rows else 0, rows)
    assert len([*tmp_path.glob("out/**/*.csv")]) > 3 or not rows


def test_search_report_tries_the_whole_grid(spark, monkeypatch):
    """All 36 combinations of 100 to 300 rounds over 3 folds, on all labelled rows and components."""
    from flowmill.plans import catalogue

    asked = {}

    def search(train, test, label, features, options, make, key, **how):
        asked.update(rows=train.count() + test.count(), features=features, options=options, folds=how["k"])
        return None, None, None, "report"

    monkeypatch.setattr(catalogue.models, "search", search)
    assert catalogue.search_report(spark, SF) == "report"
    values = {n: {x[n] for x in asked["options"]} for n in asked["options"][0]}
    assert values == {"rounds": {100, 200, 300}, "depth": {5, 10, 20}, "rate": {0.01, 0.1}, "subsample": {0.8, 1.0}}
    assert len(asked["options"]) == 36 and asked["folds"] == 3 and asked["features"] == catalogue.DIMS
    assert asked["rows"] == spark.read.parquet(f"{SF}/embeddings.parquet").where("label is not null").count()
