import duckdb
import pytest
from pyspark.sql import functions as F

from flowmill.llm import mixing
from flowmill.llm.queries import MIX_WEIGHTS, OP8_SQL, op8_mixing
from tests.oracle import compare


def fill(sizes, weights, share, cap):
    """Targets by taking the excess away again and again."""
    budget, full = share * sum(sizes), set()
    while True:
        left = budget - sum(cap * sizes[k] for k in full)
        open_ = [k for k in range(len(sizes)) if k not in full]
        level = left / sum(weights[k] for k in open_) if open_ else 0
        over = {k for k in open_ if level * weights[k] > cap * sizes[k]}
        if not over:
            return [cap * sizes[k] if k in full else level * weights[k] for k in range(len(sizes))]
        full |= over


@pytest.mark.parametrize("sizes", [[10, 20, 30], [1, 1000, 5, 7, 0, 300], [100], [5, 5, 5, 5, 5, 5, 5], [0, 0]])
@pytest.mark.parametrize(("share", "cap"), [(1.5, 2.0), (0.5, 1.0), (3.0, 2.0)])
def test_targets(spark, sizes, share, cap):
    weights = [(5.0, 2.0, 1.0)[k % 3] for k in range(len(sizes))]
    df = spark.createDataFrame([(f"s{k:02}", s) for k, s in enumerate(sizes)], "source string, source_size long")
    got = [r["target"] for r in mixing.targets(mixing.cyclic_weights(df, MIX_WEIGHTS), share, cap).orderBy("source").collect()]
    want = fill(sizes, weights, share, cap) if share <= cap else [cap * s for s in sizes]
    assert got == pytest.approx(want)


def test_query_equals_sql(spark):
    compare(spark, "/root/testdata/sf0.001", op8_mixing, OP8_SQL)


def test_a_mix_comes_near_its_targets(spark):
    docs = spark.range(20_000).selectExpr("id doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 7)) source", "repeat('w ', int(1 + id % 50)) text", "1 size", "2 copies")
    mixed = mixing.mix(docs, MIX_WEIGHTS)
    assert mixed.columns == docs.columns
    words = mixing.word_count(F.col("text"))
    got = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(words).alias("n")).collect()}
    for r in mixing.source_targets(docs, MIX_WEIGHTS).collect():
        assert got[r["source"]] == pytest.approx(r["target"], rel=0.05)
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert sorted(map(tuple, mixing.mix(docs.repartition(7), MIX_WEIGHTS).collect())) == sorted(map(tuple, mixed.collect()))


def test_edges(spark, edges):
    planned, names = mixing.plan_mix(edges, mixing.source_targets(edges, MIX_WEIGHTS))
    rows = planned.collect()
    assert len(rows) == edges.count() and all(r[names["copies"]] in (0, 1, 2) for r in rows)
    assert {r[names["size"]] for r in rows if r["text"] is None or not r["text"].strip()} == {0}
    assert all(r[names["source_size"]] is not None for r in rows)
    assert mixing.mix(edges.limit(0), MIX_WEIGHTS).count() == 0
    with pytest.raises(ValueError, match="positive"):
        mixing.source_targets(edges, (1.0, 0.0))


def test_rows_without_ids_are_drawn_by_their_texts(spark, tmp_path):
    docs = spark.range(6000).selectExpr("cast(null as bigint) doc_id", "'a' source", "concat('w ', id) text").unionAll(spark.range(6000).selectExpr("id", "'b'", "'w w'"))
    mixed = mixing.mix(docs, (1.0, 2.0), share=0.75, cap=1.0).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"))
    got = {r["source"]: r["n"] for r in mixed.collect()}
    for r in mixing.source_targets(docs, (1.0, 2.0), share=0.75, cap=1.0).collect():
        assert got[r["source"]] == pytest.approx(r["target"], rel=0.05)
    docs.selectExpr("doc_id", "text", "'en' lang", "source").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(f"select size, sum(taken) taken, count(*) n from ({OP8_SQL}) group by size order by size").fetchall()
    assert [tuple(r) for r in op8_mixing(spark, str(tmp_path)).groupBy("size").agg(F.sum("taken"), F.count("*")).orderBy("size").collect()] == want


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    with pytest.raises(ValueError, match="sources"):
        mixing.source_targets(spark.range(3).selectExpr("id doc_id", "string(id) source", "'a' text"), (1.0,))
