import pytest
from pyspark.sql import functions as F

from flowmill.plans import assembly
from flowmill.streaming import scoring


def flows(spark):
    labels = ["Benign"] * 60 + ["DoS"] * 30 + ["Bot"] * 3 + [None] * 2
    return spark.createDataFrame([(k, x, f"f{k % 3}", float(k)) for k, x in enumerate(labels)], "id long, label string, source string, rate double")


def test_binary_training_set(spark):
    rows = flows(spark)
    normal, attacks = rows.where("label = 'Benign'"), rows.where("label <> 'Benign'").drop("source")
    got = assembly.binary_training_set(normal.unionAll(normal), attacks, "label", ["id"], least=5, most=20, ratio=1.5)
    assert got.columns == ["id", "label", "rate"]
    assert {r[0]: r[1] for r in got.groupBy("label").count().collect()} == {0: 30, 1: 20}


def test_multiclass_training_set(spark):
    got, codes = assembly.multiclass_training_set(flows(spark), "label", ["rate"], ["id"], least=2, most=10)
    assert got.columns == ["rate", "label"]
    assert {r[0]: r[1] for r in got.groupBy("label").count().collect()} == {0: 3, 1: 10}
    assert [r["label"] for r in codes.orderBy("code").collect()] == ["Bot", "DoS"]


@pytest.mark.parametrize(("mode", "rows"), [("normal", 60), ("attacks", 33), ("both", 93)])
def test_interleaved_parts(spark, mode, rows):
    got = assembly.interleaved_parts(flows(spark), "label", "source", ["id"], 10, mode=mode)
    sizes = [r["count"] for r in got.groupBy("part").count().orderBy("part").collect()]
    assert sum(sizes) == rows and set(sizes[:-1]) == {10}
    assert got.where("turn = 1").agg(F.max("part")).first()[0] == 0
    with pytest.raises(ValueError, match="mode"):
        assembly.interleaved_parts(flows(spark), "label", "source", ["id"], 10, mode="x")


def test_holdout_report(spark):
    got = assembly.holdout_report(flows(spark).where("label in ('Benign', 'DoS')"), "label", ["rate"], ["id"], trees=5, depth=4)
    assert {r["label"]: r["support"] for r in got.collect()} == {"Benign": 12, "DoS": 6}


def test_windowed_counts_and_distinct_stream(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:00:01", "a"), ("2024-01-01 00:04:00", "a"), ("2024-01-01 00:06:00", "b"), ("2024-01-01 00:06:00", "b")], "t string, label string").select(F.to_timestamp("t").alias("t"), "label").write.parquet(str(tmp_path / "in"))
    stream = scoring.read_captures(spark, str(tmp_path / "in"), "t timestamp, label string")
    for name, made, mode in (("counted", scoring.windowed_counts(stream, "t", "label"), "complete"), ("firsts", scoring.distinct_stream(stream, ["t", "label"], "t"), "append")):
        made.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(r["n_rows"] for r in spark.table("counted").collect()) == [2, 2]
    assert spark.table("firsts").count() == 3
