"""Near duplicates by exact similarity, against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmill.llm import set_join, shingle_sets, similar, simhash
from flowmill.llm.common import table
from tests.llm.test_simhash import SF, clustered, near_pairs, plain_components


def plain_similar(rows, least=0.8, width=5):
    """The least id of each row's component under exact similarity, and the number of linked pairs."""
    sets = []
    for _, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set())
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if (not sets[i] and not sets[j]) or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) > 0]
    comp = plain_components([(i, i) for i in range(len(rows))] + pairs)
    groups = {}
    for i, r in comp.items():
        groups.setdefault(r, []).append(rows[i][0])
    return [min((x for x in groups[comp[i]] if x is not None), default=None) for i in range(len(rows))], pairs


def mutated(seed=4):
    rng = np.random.default_rng(seed)
    vocabulary, rows = [f"w{k}" for k in range(400)], []
    for group in range(40):
        base = [str(w) for w in rng.choice(vocabulary, rng.integers(80, 300))]
        for copy in range(6):
            words = list(base)
            for _ in range(int(len(words) * 0.015 * copy)):
                words[rng.integers(len(words))] = str(rng.choice(vocabulary))
            rows.append((group * 10 + copy, " ".join(words)))
    return rows


def test_similar_documents_recall_and_precision(spark):
    rows = mutated()
    got = {r["id"]: r["keep_id"] for r in similar.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want, pairs = plain_similar(rows)
    exact = dict(zip([i for i, _ in rows], want, strict=True))
    assert len(got) == len(rows)
    assert all(exact[i] == exact[k] for i, k in got.items())  # no false link
    assert all(got[rows[i][0]] == got[rows[j][0]] for i, j in pairs)  # none lost


@pytest.mark.parametrize("source", ["documents", "edges"])
def test_similar_documents_of_tables(spark, edges, source):
    docs = edges if source == "edges" else table(spark, SF, "documents")
    groups = similar.similar_documents(docs)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, _ = plain_similar(rows)
    got = sorted(map(str, (tuple(r) for r in groups.select("id", "keep_id").collect())))
    exact = sorted(str((i, k)) for (i, _), k in zip(rows, want, strict=True))
    assert got == exact
    kept = simhash.drop_near_duplicates(docs, groups)
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0


@pytest.mark.parametrize("radius", [4, 10])
def test_close_pairs_span_and_are_close(radius):
    fps = np.array(clustered(1200), "u8")
    places = np.arange(len(fps))
    a, b = (fps[x] for x in similar.close_pairs(fps, radius, fps, places, places))
    assert (np.bitwise_count(a ^ b) <= radius).all()
    got = plain_components(zip(a.tolist(), b.tolist(), strict=True))
    want = plain_components((int(fps[i]), int(fps[j])) for i, j in near_pairs(fps, radius))
    assert got == want and len(a) == len(got) - len(set(got.values()))
    every = [similar.close_pairs(fps, radius, fps, places, places[k::3]) for k in range(3)]
    assert plain_components((int(fps[i]), int(fps[j])) for x, y in every for i, j in zip(x, y, strict=True)) == want


@pytest.mark.parametrize("max_shard", [1 << 30, 20])
def test_hot_shards_of_close_links_are_split(spark, max_shard):
    fps = sorted(set(clustered(500)))
    nodes = spark.createDataFrame([(simhash.signed(x), simhash.signed(x), k) for k, x in enumerate(fps)], "fp long, other long, name long")
    got = plain_components([(k, k) for k in range(len(fps))] + [(r["a"], r["b"]) for r in similar.close_links(nodes, max_shard=max_shard).collect()])
    want = plain_components([(k, k) for k in range(len(fps))] + near_pairs(fps, similar.RADIUS))
    apart = sum(got[i] != got[j] for i, j in near_pairs(fps, similar.RADIUS))
    assert all(want[i] == want[k] for i, k in got.items()) and apart <= 0.05 * len(near_pairs(fps, similar.RADIUS))


def boilerplate(many, seed=9):
    """Texts that share 82 of 100 words (J of about 0.7), and for every tenth one a copy with six words changed (J of 0.8 and more)."""
    rng = np.random.default_rng(seed)
    shared, rows = [f"b{k}" for k in range(86)], []
    for k in range(many):
        own = [f"t{k}x{j}" for j in range(14)]
        rows.append((2 * k, " ".join(own + shared)))
        if k % 10 == 0:
            at = int(rng.integers(20, 80))
            rows.append((2 * k + 1, " ".join(own + shared[:at] + [f"c{k}x{j}" for j in range(6)] + shared[at + 6 :])))
    return rows


def test_similar_documents_lose_nothing(spark):
    for rows in (mutated(), mutated(7)):
        got = {r["id"]: r["keep_id"] for r in similar.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == dict(zip([i for i, _ in rows], plain_similar(rows)[0], strict=True))


def test_similar_documents_among_boilerplate(spark):
    rows = boilerplate(1500)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["id"]: r["keep_id"] for r in similar.similar_documents(docs).collect()} == dict(zip([i for i, _ in rows], plain_similar(rows)[0], strict=True))


@pytest.mark.parametrize("max_token_rows", [1 << 30, 3])
def test_meetings_of_prefixes(spark, max_token_rows):
    rows = [(k, t.encode()) for k, (_, t) in enumerate(mutated())]
    texts = spark.createDataFrame(rows, "text_hash long, utf8 binary").repartition(3)
    shared = shingle_sets.dealt(shingle_sets.prefixes(texts, np.zeros(shingle_sets.BUCKETS, "i8"), shingle=5, similarity=0.8), max_token_rows)
    sets = [simhash.shingle_set(t, 5) for _, t in rows]
    groups = spark.createDataFrame([(k, k - k % 2, k - k % 3, *shingle_sets.sketch(s).tolist()) for k, s in enumerate(sets)], f"node long, `group` long, star long, {', '.join(f'{x} long' for x in shingle_sets.SKETCH)}")
    got = {tuple(r) for r in set_join.block_pairs(shared, groups, similarity=0.8).collect()}
    want = {(min(p), max(p)) for p in plain_similar([(k, t.decode()) for k, t in rows])[1] if p[0] // 2 != p[1] // 2 and p[0] // 3 != p[1] // 3}
    assert all(a // 2 != b // 2 and a // 3 != b // 3 for a, b in got) and want <= got


def near_threshold(count, words=840, changed=11, seed=1):
    """Texts of one template, each with some words of its own: a coefficient of about 0.77 with each other."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(count):
        own = [f"t{j}" for j in range(words)]
        for at in rng.choice(words, changed, replace=False):
            own[at] = f"c{k}x{at}"
        rows.append((k, " ".join(own)))
    return rows


def test_work_on_texts_near_the_threshold_grows_in_proportion(spark):
    """Pairs written and texts compared, for texts of one template just under the similarity."""
    written = []
    for count in (150, 300):
        texts = spark.createDataFrame([(k, k, t.encode()) for k, t in near_threshold(count)], "id long, text_hash long, utf8 binary").repartition(3)
        shared = shingle_sets.prefixes(texts, np.zeros(shingle_sets.BUCKETS, "i8"), shingle=5, similarity=0.8).cache()
        sets = {r["id"]: simhash.shingle_set(r["utf8"], 5) for r in texts.collect()}
        sketches = spark.createDataFrame([(k, *shingle_sets.sketch(x).tolist()) for k, x in sets.items()], f"node long, {', '.join(f'{x} long' for x in shingle_sets.SKETCH)}")
        links, told, stars = set_join.star_answers(shared, sketches.withColumn("id", F.col("node")), texts, shingle=5, similarity=0.8)
        groups = sketches.join(stars, "node", "left").select("node", F.col("node").alias("group"), F.coalesce("star", "node").alias("star"), *shingle_sets.SKETCH)
        written.append(told.count() + set_join.block_pairs(shingle_sets.dealt(shared, 50_000), groups, similarity=0.8).join(told, ["a", "b"], "left_anti").count())
        near = [(a, b) for a in sets for b in range(a) if shingle_sets.jaccard(sets[a], sets[b]) >= 0.8]
        assert links.count() <= len(near)
        shared.unpersist()
    assert written[0] <= 3 * 150 and written[1] <= 3 * 300, written


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(200):
        pool = rng.integers(0, 1 << 62, 900, dtype="u8")
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 900))) for _ in range(2))
        differ = len(np.setxor1d(a, b))
        assert shingle_sets.apart(shingle_sets.long_sketch(a), shingle_sets.long_sketch(b)) <= differ
        assert shingle_sets.apart(shingle_sets.sketch(a, 4096), shingle_sets.sketch(b)) == shingle_sets.apart(shingle_sets.sketch(a), shingle_sets.sketch(b))
        assert np.bitwise_count((shingle_sets.sketch(a) ^ shingle_sets.sketch(b)).view("u8")).sum() <= differ


def test_one_row_batches_keep_what_meets(spark):
    rows = [(k, t.encode()) for k, (_, t) in enumerate(mutated()[:60])] * 2
    texts = spark.createDataFrame(rows, "text_hash long, utf8 binary")
    def found():
        return sorted(map(tuple, shingle_sets.prefixes(texts, np.zeros(shingle_sets.BUCKETS, "i8"), shingle=5, similarity=0.8).collect()))
    want, size = found(), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert found() == want and len(want) == len(set(want))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_empty_table_of_similar(spark, edges):
    assert similar.similar_documents(edges.limit(0)).count() == 0
    assert simhash.drop_near_duplicates(edges.limit(0), similar.similar_documents(edges.limit(0))).count() == 0


def test_groups_over_parts(spark):
    rows = boilerplate(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["id"]: r["keep_id"] for r in similar.similar_documents(docs, max_token_rows=40).collect()}
    assert got == dict(zip([i for i, _ in rows], plain_similar(rows)[0], strict=True))
