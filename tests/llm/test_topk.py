import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmill.llm import topk
from flowmill.llm.queries import OP4_SQL, op4_topk
from tests.oracle import compare


def data(kind, n, dims, seed=3):
    rng = np.random.default_rng(seed)
    if kind == "same":
        return np.ones((n, dims))
    if kind == "clusters":
        return np.floor(rng.normal(size=(6, dims))[rng.integers(0, 6, n)] * 200 + rng.normal(size=(n, dims)) * 5)
    if kind == "few values":
        return rng.integers(-1, 2, (n, dims)).astype("f8")
    return np.floor(rng.normal(size=(n, dims)) * 256)


def brute(q, q_ids, x, ids, k):
    s = q @ x.T
    out = []
    for row, own in zip(s, q_ids, strict=True):
        best = sorted((-v, i) for v, i in zip(row, ids, strict=True) if i != own)[:k]
        out.append([(int(-v), int(i)) for v, i in best])
    return out


@pytest.mark.parametrize("kind", ["same", "clusters", "few values", "noise"])
@pytest.mark.parametrize(("n", "k"), [(1, 3), (4, 5), (700, 5)])
def test_search_is_exact(kind, n, k):
    x = data(kind, n, 6).astype("i8")
    ids = np.random.default_rng(1).permutation(10 * n)[:n]
    q, q_ids = x[::3], ids[::3]
    scores, found = topk.search(q, q_ids, x, ids, k)
    got = [[(int(s), int(i)) for s, i in zip(a, b, strict=True) if s != topk.NONE] for a, b in zip(scores, found, strict=True)]
    assert got == brute(q, q_ids, x, ids, k)


def test_tree_covers():
    x = data("clusters", 900, 5)
    t = topk.CoverTree(x)
    for k in range(len(t.centre)):
        own = t.order[t.start[k] : t.stop[k]]
        assert np.sqrt(((x[own] - x[t.centre[k]]) ** 2).sum(axis=1)).max() <= t.radius[k] + 1e-6
        if t.last[k]:
            assert sum(t.stop[c] - t.start[c] for c in range(t.first[k], t.last[k])) == len(own)
    assert sorted(t.order) == list(range(900)) and t.last.max() > 0


def test_pruning_saves_work(monkeypatch):
    x, seen = data("clusters", 3000, 5).astype("i8"), []
    offer = topk._Best.offer
    monkeypatch.setattr(topk._Best, "offer", lambda self, which, scores, ids: (seen.append(scores.size), offer(self, which, scores, ids))[1])
    topk.search(x[:300], np.arange(300), x, np.arange(3000), 5)
    assert sum(seen) < 0.6 * 300 * 3000


@pytest.mark.parametrize("k", [1, 5])
def test_large_components(k):
    rng = np.random.default_rng(2)
    x = rng.integers(-(1 << 28), 1 << 28, (400, 16))
    x[200:] = x[0] + rng.integers(-3, 4, (200, 16))  # scores that doubles can't tell apart
    ids = np.arange(400)
    scores, found = topk.search(x[::5], ids[::5], x, ids, k)
    for q, a, b in zip(ids[::5], scores.tolist(), found.tolist(), strict=True):
        mine = [int(v) for v in x[q]]
        want = sorted((-sum(m * int(v) for m, v in zip(mine, r, strict=True)), i) for i, r in enumerate(x) if i != q)[:k]
        assert [(-s, i) for s, i in zip(a, b, strict=True)] == want


@pytest.mark.parametrize("shift", [3, 8, 30])
def test_components_beyond_64_bits(shift):
    """Scores that fit are exact beside rows whose products don't; those count as the highest or lowest number."""
    rng = np.random.default_rng(4)
    x = rng.integers(-(1 << 28), 1 << 28, (300, 16))
    x[::7] <<= shift
    x[5] = x[7] * np.where(np.arange(16) % 2, 1, -1)  # large terms that nearly cancel
    ids = np.arange(300)
    scores, found = topk.search(x[::3], ids[::3], x, ids, 4)
    for q, a, b in zip(ids[::3], scores.tolist(), found.tolist(), strict=True):
        exact = [sum(int(u) * int(v) for u, v in zip(x[q], r, strict=True)) for r in x]
        want = sorted((-max(-topk.TOP, min(topk.TOP, s)), i) for i, s in enumerate(exact) if i != q)[:4]
        assert [(-s, i) for s, i in zip(a, b, strict=True)] == want


def test_one_huge_row_ends_nothing(spark):
    rows = [(k, [float(v) for v in np.random.default_rng(k).normal(size=8)]) for k in range(40)] + [(40, [1e7, -1e12] * 4), (41, [3e15] * 8)]
    df = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in topk.top_k(df, df.where("vec_id % 2 = 0"), 3).collect()}
    whole = {k: [int(np.floor(256 * v)) for v in x] for k, x in rows}
    for q in range(0, 41, 2):
        scored = sorted((-max(-topk.TOP, min(topk.TOP, sum(a * b for a, b in zip(whole[q], x, strict=True)))), k) for k, x in whole.items() if k != q)[:3]
        assert [got[q, n + 1] for n in range(3)] == [(k, -s) for s, k in scored]


def test_least_scores_prune_only_what_is_below():
    x = data("clusters", 500, 5).astype("i8")
    ids = np.arange(500)
    scores, found = topk.search(x[:50], ids[:50], x, ids, 5)
    again, same = topk.search(x[:50], ids[:50], x, ids, 5, scores[:, -1].copy())
    assert (scores == again).all() and (found == same).all()


def test_pivots_prune(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = np.eye(6) * 4000
    x = np.floor(centres[np.arange(1200) % 6] + rng.normal(size=(1200, 6)) * 20).astype("i8")
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, vector array<long>")
    seen, reach = [], topk._reach
    monkeypatch.setattr(topk, "_reach", lambda *a: (seen.append(a), reach(*a))[1])
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), 5, shard_rows=50).orderBy("query_id", "rank").collect()
    assert [(r["score"], r["id"]) for r in got] == [p for q in brute(x[::50], range(0, 1200, 50), x, range(1200), 5) for p in q]
    assert len(seen) > 50


@pytest.mark.parametrize("pivots", [1, 256])
def test_repeated_ids_equal_sql(spark, tmp_path, pivots, monkeypatch):
    monkeypatch.setattr(topk.top_k, "__kwdefaults__", topk.top_k.__kwdefaults__ | {"max_pivots": pivots, "shard_rows": 8})
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(v) for v in rng.normal(size=4)]) for i in rng.integers(0, 60, 150)] + [(50, [1.0, 1.0, 0.0, 0.0])] * 2 + [(1, [9.0, 9.0, 0.0, 0.0]), (None, [1.0] * 4), (7, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(con.sql(f"select query_id, rank, vec_id, score from ({OP4_SQL})").fetchall())
    assert sorted(map(tuple, op4_topk(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect())) == want


@pytest.mark.parametrize(("shard", "block"), [(4096, 4096), (40, 7)])
def test_grid_of_blocks(spark, shard, block):
    x = data("few values", 300, 4)
    rows = [(k, [int(v) for v in r], "mine", 1) for k, r in enumerate(x)]
    rows += [(300, None, "x", 1), (301, [1, None, 1, 1], "x", 1), (302, [], "x", 1), (None, [1, 1, 1, 1], "x", 1), (303, [1, 1], "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>, score string, rank int")
    got = topk.top_k(df, df.where(F.col("vec_id") % 10 == 0), 4, shard_rows=shard, block_rows=block).orderBy("query_id", "rank").collect()
    want = brute(x[::10], range(0, 300, 10), x, range(300), 4)
    assert [(r["score"], r["id"]) for r in got] == [p for q in want for p in q]
    assert topk.top_k(df.limit(0), df.limit(0), 4).count() == 0


def test_quantized(spark):
    df = spark.createDataFrame([(1, [0.5, -0.001]), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 0.0]), (5, None)], "vec_id int, embedding array<float>")
    assert [r["vector"] for r in topk.quantized(df).orderBy("vec_id").collect()] == [[128, -1], None, None, None, None]


def test_query_equals_sql(spark):
    compare(spark, "/root/testdata/sf0.001", op4_topk, OP4_SQL)
