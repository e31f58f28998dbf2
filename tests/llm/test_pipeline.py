"""The pipeline's stages, each judged on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from flowmill.llm.common import table
from flowmill.llm.mixing import word_count

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), table(spark, SF, "documents"), []
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return [r["doc_id"] for r in df.select("doc_id").collect()]


def test_columns_and_rows(spark, stages):
    names = table(spark, SF, "documents").columns
    assert [set(after.columns) == set(names) for _, after in stages] == [True] * 4 + [False]
    for before, after in stages[:3]:
        assert set(ids(after)) <= set(ids(before)) and 0 < after.count() <= before.count()
        assert after.exceptAll(before).count() == 0


def test_quality(spark, stages):
    before, after = stages[0]
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    kept = set(ids(after))
    assert sum((d in kept) == (q == 1) for d, q in labels.items()) / len(labels) > 0.95


def test_near_duplicates(stages):
    from tests.llm.test_similar import plain_similar

    before, after = stages[1]
    want = set(plain_similar([(r["doc_id"], r["text"]) for r in before.collect()])[0])
    assert sorted(ids(after)) == sorted(want)


def test_decontamination(spark, stages):
    before, after = stages[2]
    from flowmill.llm import decontaminate

    hit = set(ids(decontaminate.find_passages(before, table(spark, SF, "benchmark"))))
    assert sorted(ids(after)) == sorted(set(ids(before)) - hit)


def test_mixing(spark, stages):
    before, after = stages[3]
    total = before.agg(F.sum(word_count(F.col("text")))).first()[0]
    assert after.agg(F.sum(word_count(F.col("text")))).first()[0] == pytest.approx(1.5 * total, rel=0.15)
    assert max(r["count"] for r in after.groupBy("doc_id").count().collect()) <= 2


def test_tokens(stages):
    before, after = stages[4]
    assert sorted(ids(after)) == sorted(ids(before))
    rows = after.orderBy("start").collect()
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))


def test_run_repeats(spark):
    a, b = (sorted(map(tuple, p.run(spark, SF).collect())) for _ in range(2))
    assert [r[0] for r in a] == [r[0] for r in b] and a == b


@pytest.mark.parametrize("k", range(5))
def test_stages_take_edges(spark, edges, k):
    """Nulls in any column, empty and long texts, repeated rows, clashing names; what must stay stays."""
    name, stage = p.STAGES[k]
    rows = stage(spark, edges, SF)
    assert k == 4 or rows.columns == edges.columns
    got = sorted(str(r["doc_id"]) for r in rows.collect())
    mine = sorted(str(r["doc_id"]) for r in edges.collect())
    if name == "near duplicates":
        assert got == sorted(["1", "10", "11", "4", "5", "6", "7", "8", "9", "None"])  # 1 to 3 are without words, 6 repeats
    elif name == "mixing":
        assert set(got) <= set(mine) and max(map(got.count, got)) <= 4
    elif name == "quality":
        assert set(got) <= set(mine) and got.count("6") in (0, 2)
    else:
        assert got == mine


@pytest.mark.parametrize("k", range(5))
def test_stages_take_empty_tables(spark, edges, k):
    rows = p.STAGES[k][1](spark, edges.limit(0), SF)
    assert rows.count() == 0 and (k == 4 or rows.columns == edges.columns)
