import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from flowmill.llm import simhash
from flowmill.llm.common import table
from flowmill.llm.components import components

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text, width=4, distinct=False):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    shingles = set(shingles) if distinct else shingles
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if hashes else 0


def plain_components(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in parent}


def near_pairs(fps, radius):
    a = np.array(fps, "u8")
    return [(i, i + 1 + int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= radius)]


@pytest.mark.parametrize("text", ["", " ", "a", "A b", "a b c d", "The CAT\tsat\non the mat, the CAT sat", "Ä É ß İ x\x85y\xa0z \x1c k", "w " * 3000])
def test_fingerprint(text, monkeypatch):
    assert simhash.fingerprint(text.encode()) % (1 << 64) == plain_fingerprint(text)
    monkeypatch.setattr(simhash, "HASHES", 2)
    assert simhash.fingerprint(text.encode(), 3) % (1 << 64) == plain_fingerprint(text, 3)


def clustered(n=3000, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 64, 20, dtype="u8")
    out = []
    for _ in range(n):
        x = int(rng.choice(centres)) if rng.random() < 0.8 else int(rng.integers(0, 1 << 64, dtype="u8"))
        for b in rng.choice(64, rng.integers(0, 9), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("radius", [0, 1, 4, 7])
def test_forest_connects_what_is_near(radius):
    fps = np.array(clustered(), "u8")
    a, b = simhash.forest(fps, radius)
    got = plain_components(zip(a.tolist(), b.tolist(), strict=True))
    want = plain_components((int(fps[i]), int(fps[j])) for i, j in near_pairs(fps, radius))
    assert {frozenset(k for k in got if got[k] == r) for r in got.values()} == {frozenset(k for k in want if want[k] == r) for r in want.values()}


@pytest.mark.parametrize("max_shard", [200_000, 100, 10])
@pytest.mark.parametrize("radius", [2, 4])
def test_links_lose_nothing(spark, max_shard, radius):
    fps = [x - (1 << 64) if x >> 63 else x for x in clustered(1500)]
    df = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(4)
    found = components(simhash.links(df, radius=radius, max_shard=max_shard)).collect()
    got = {r["node"]: r["root"] for r in found}
    want = plain_components((fps[i], fps[j]) for i, j in near_pairs([x % (1 << 64) for x in fps], radius))
    assert got == want


@pytest.mark.parametrize("count", [100, 1 << 28, 1 << 40])
def test_masks_meet_within_the_radius(count):
    masks, rng = simhash._masks(count, 4), np.random.default_rng(1)
    for _ in range(300):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(not flips & m for m in masks)


def test_components_of_odd_graphs(spark):
    pairs = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 180)] + [(7, 7), (300, 299), (299, 300), (301, 299)]
    found = components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r["node"]: r["root"] for r in found.collect()} == plain_components(p for p in pairs if p[0] != p[1])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def expected(rows, radius=4):
    """keep id by row, ids null last."""
    fps = [plain_fingerprint(t) for _, t in rows]
    comp = plain_components([(i, i) for i in range(len(fps))] + near_pairs(fps, radius))
    groups = {}
    for i, r in comp.items():
        groups.setdefault(r, []).append(rows[i][0])
    return [(rows[i][0], fps[i], min((x for x in groups[comp[i]] if x is not None), default=None)) for i in range(len(fps))]


@pytest.mark.parametrize("source", ["documents", "edges"])
def test_components_of_documents(spark, edges, source):
    docs = edges if source == "edges" else table(spark, SF, "documents")
    got = simhash.near_duplicates(docs).select("id", simhash.hex_digits(F.col("fp")).alias("fp"), "keep_id").collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((i, f"{fp:016x}", keep)) for i, fp, keep in expected(rows))


@pytest.mark.parametrize("source", ["documents", "edges"])
def test_one_of_each_group_stays(spark, edges, source):
    docs = edges if source == "edges" else table(spark, SF, "documents")
    kept = simhash.drop_near_duplicates(docs, simhash.near_duplicates(docs))
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    fps = [plain_fingerprint(t) for _, t in rows]
    comp = plain_components([(i, i) for i in range(len(fps))] + near_pairs(fps, 4))
    assert kept.count() == len(set(comp.values()))
    ids = sorted(str(min((rows[i][0] for i in comp if comp[i] == r), key=lambda x: (x is None, x))) for r in set(comp.values()))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ids


def test_empty_table(spark, edges):
    assert simhash.near_duplicates(edges.limit(0)).count() == 0
    assert simhash.drop_near_duplicates(edges.limit(0), simhash.near_duplicates(edges.limit(0))).count() == 0
