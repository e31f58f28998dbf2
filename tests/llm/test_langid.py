import numpy as np
import pytest

from flowmill.llm import langid
from flowmill.llm.common import held_out, table

SF = "/root/testdata/sf0.001"


def plain_vector(text):
    """The sum of the bound vectors of each trigram, one after the other."""
    numbers = langid.letters().number
    codes = [0]
    for c in text.lower():
        n = int(numbers[ord(c)])
        if n or codes[-1]:
            codes.append(n)
    if codes[-1]:
        codes.append(0)
    out = np.zeros(langid.DIM)
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        if b:
            v = [langid.letters().vector(x) for x in (a, b, c)]
            out += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
    return out


@pytest.mark.parametrize("chars", [1 << 21, 7, 1])
def test_bundles_equal_the_plain_sum(monkeypatch, chars):
    monkeypatch.setattr(langid, "BLOCK_CHARS", chars)
    monkeypatch.setattr(langid, "CHUNK_GRAMS", 5)
    texts = ["The cat, the hat.", "", " -- ", "a", "Größe  und\nmehr 123 ok", "日本 語"]
    got = langid._bundles(list(enumerate(texts)), len(texts))
    assert np.array_equal(got, np.stack([plain_vector(t) for t in texts]))


@pytest.mark.parametrize("source", ["documents", "edges"])
def test_predictions_equal_the_plain_cosine(spark, edges, source):
    docs = (edges if source == "edges" else table(spark, SF, "documents")).where("text is null or length(text) < 1500").select("doc_id", "text", "lang")
    rows = docs.collect()
    vectors = [plain_vector(r["text"] or "") for r in rows]
    sums = {}
    for r, v in zip(rows, vectors, strict=True):
        if r["text"] is not None and r["lang"] is not None:
            sums[r["lang"]] = sums.get(r["lang"], 0) + np.rint(v * (langid.SCALE / max(np.linalg.norm(v), 1)))
    known = sorted((x, v / np.linalg.norm(v)) for x, v in sums.items() if np.any(v))
    want = []
    for r, v in zip(rows, vectors, strict=True):
        size = np.linalg.norm(v)
        cosines = [float(v @ p) / size for _, p in known] if size else []
        best = max(range(len(known)), key=lambda k: cosines[k]) if size else None
        want.append((str(r["doc_id"]), known[best][0] if size else "und", max(0.0, min(1.0, cosines[best])) if size else 0.0))
    got = [(str(r["doc_id"]), r["lang_pred"], r["score"]) for r in langid.identify(docs, langid.learn(docs)).collect()]
    assert [g[:2] for g in sorted(got)] == [w[:2] for w in sorted(want)]
    assert [g[2] for g in sorted(got)] == pytest.approx([w[2] for w in sorted(want)], abs=1e-5)


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    model = langid.learn(docs.where(~held_out()))
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held_out()).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_edges(spark, edges):
    model = langid.learn(edges)
    got = langid.identify(edges, model)
    assert got.columns == ["doc_id", "lang_pred", "score"] and got.count() == edges.count()
    said = {r["doc_id"]: r for r in got.collect()}
    assert all(said[k]["lang_pred"] == "und" and said[k]["score"] == 0 for k in (1, 2, 3, 5))
    assert said[6]["lang_pred"] == "en" and said[7]["lang_pred"] == "de" and said[9]["lang_pred"] in ("en", "de")
    again = langid.identify(edges.repartition(5), langid.learn(edges.repartition(3)))
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))


def test_nothing_learned_or_read(spark, edges):
    none = langid.learn(edges.limit(0))
    assert {r["lang_pred"] for r in langid.identify(edges, none).collect()} == {"und"}
    assert langid.identify(edges.limit(0), langid.learn(edges)).count() == 0
