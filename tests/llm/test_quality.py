from bisect import bisect_right
from math import exp

import numpy as np
import pytest

from flowmill.llm import quality
from flowmill.llm.common import held_out, table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.learn(docs, labels.where(~held_out()))
    got = quality.score(docs, model, keep=["doc_id"]).join(labels.where(held_out()), "doc_id").toPandas()
    assert ((got.score >= 0.3) == (got.quality == 1)).mean() > 0.95
    assert model.pairs and all(t.any() for t in model.pair_tables[:1])


def test_scores_equal_the_plain_sum(spark):
    """Each row's score by bisection of its features, one table entry after the other."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = quality.learn(docs, table(spark, "/root/testdata/sf0.001", "labels"))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model, keep=["doc_id"]).collect()}
    for r in docs.collect():
        x = quality.features((r["text"] or "").encode())
        z = model.intercept + sum(t[bisect_right(e.tolist(), v)] for v, e, t in zip(x, model.edges, model.tables, strict=True))
        for (a, b), t in zip(model.pairs, model.pair_tables, strict=True):
            z += t[bisect_right(model.pair_edges[a].tolist(), x[a]), bisect_right(model.pair_edges[b].tolist(), x[b])]
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + exp(-z)), abs=1e-9)
    assert len(set(got.values())) > 10 and model.pairs


def test_interactions_are_learned():
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype("f8")  # no single feature tells anything
    model = quality.fit(x[:3000], y[:3000], pairs=1, pair_rounds=80)
    assert model.pairs == [(0, 1)]
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def test_shallow_tree_finds_the_best_cut():
    g, h = np.array([[3.0], [2.0], [-4.0], [-5.0]]), np.full((4, 1), 5.0)
    tree = quality.shallow_tree(g, h, 2, ridge=0.0)
    assert tree[:, 0].tolist() == [0.5, 0.5, -0.9, -0.9]
    assert quality.shallow_tree(g, h, 1).ptp() == 0 if hasattr(g, "ptp") else np.ptp(quality.shallow_tree(g, h, 1)) == 0


@pytest.mark.parametrize("y", [[], [1], [0, 0, 0]])
def test_constant_models(y):
    model = quality.fit(np.zeros((len(y), len(quality.FEATURES))), np.array(y, "f8"))
    scores = model.score(np.random.default_rng(1).normal(size=(5, len(quality.FEATURES))))
    assert np.ptp(scores) == 0 and 0 < scores[0] < 1


def test_features():
    f = dict(zip(quality.FEATURES, quality.features("Aa bb bb!\nAa bb bb!\n".encode()), strict=True))
    assert f["distinct_words"] == 3 / 6 and f["distinct_lines"] == 2 / 3 and f["exclaims"] == 2 / 20 and f["upper"] == 2 / 12
    assert len(quality.features(b"")) == len(quality.features("é 🙂".encode())) == len(quality.FEATURES)


def test_edges(spark, edges):
    labels = spark.createDataFrame([(6, 1, 0), (7, 1, 0), (8, 0, 0), (9, 0, 0), (None, 1, 0), (4, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.learn(edges, labels)
    got = quality.score(edges.drop("score"), model)
    assert got.count() == edges.count() and got.where("score between 0 and 1").count() == edges.count()
    by_id = {r["doc_id"]: r["score"] for r in got.collect()}
    assert by_id[1] == by_id[2]  # null and empty
    assert quality.score(edges.limit(0).drop("score"), model).count() == 0
    assert quality.learn(edges, labels.limit(0)).intercept == 0
    same = quality.learn(edges.repartition(3), labels.repartition(2))
    assert same.intercept == model.intercept and all(map(np.array_equal, same.tables, model.tables))
