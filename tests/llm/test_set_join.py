"""The Jaccard join against brute force, whole and in its parts."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowmill.llm import queries, set_join, shingle_sets, simhash, stars
from flowmill.llm.common import table
from tests.llm.test_similar import mutated
from tests.llm.test_simhash import plain_components
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


def plain_sets(texts, width):
    out = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set())
    return out


def plain_rows(rows, percent=85, width=4):
    """id, size of the set, least id of the component. ``rows``: id, text."""
    sets = plain_sets([t for _, t in rows], width)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    comp, groups = plain_components([(i, i) for i in range(len(rows))] + pairs), {}
    for i, r in comp.items():
        groups.setdefault(r, []).append(rows[i][0])
    return sorted(((rows[i][0], len(sets[i]), min((x for x in groups[comp[i]] if x is not None), default=None)) for i in range(len(rows))), key=str)


def joined(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string") if isinstance(rows, list) else rows
    return sorted((tuple(r) for r in set_join.jaccard_join(docs, **more).select("id", "size", "keep_id").collect()), key=str)


def family(count, words, changed, seed):
    """Texts of one template, each with some other words of its own."""
    rng = np.random.default_rng(seed)
    base, rows = [f"t{k}" for k in range(words)], []
    for k in range(count):
        own = list(base)
        for at in rng.choice(words, changed, replace=False):
            own[at] = f"c{rng.integers(0, 5)}_{at}"
        rows.append((k, " ".join(own)))
    return rows


def test_mutated_texts(spark):
    rows = mutated()
    assert joined(spark, rows) == plain_rows(rows)


@pytest.mark.parametrize("changed", [3, 6, 9, 12])
def test_family_about_the_threshold(spark, changed):
    rows = family(60, 300, changed, changed)
    assert joined(spark, rows, max_token_rows=25) == plain_rows(rows)


@pytest.mark.parametrize("source", ["documents", "edges"])
def test_tables(spark, edges, source):
    docs = edges if source == "edges" else table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert joined(spark, docs) == plain_rows(rows)


def test_repeated_rows_and_no_rows(spark, edges):
    rows = [(k % 3, "the same nine words are in every one here") for k in range(40)] + [(None, "the same nine words are in every one here"), (None, None), (None, "null ids only here"), (9, " ")]
    more = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(x) for x in ("id", "node", "size", "first", "token", "star", "group")])
    assert joined(spark, more) == plain_rows(rows)
    assert joined(spark, edges.limit(0)) == []


@pytest.mark.parametrize("similarity", [0.5, 0.85, 1.0])
def test_other_similarities(spark, similarity):
    rows = mutated(8)[:90] + family(20, 60, 3, 5)
    assert joined(spark, rows, similarity=similarity, shingle=2) == plain_rows(rows, round(100 * similarity), 2)


@pytest.mark.parametrize("star_rows", [3, 100])
def test_links_in_a_star(spark, star_rows):
    rows = [(k, t) for k, t in family(50, 200, 5, 2)] + [(50 + k, t) for k, t in family(10, 200, 1, 3)]
    sets = [np.sort(np.array([hash(s) % 2**63 for s in own], "u8")) for own in plain_sets([t for _, t in rows], 4)]
    lead, members = sets[-1], []
    for k, own in enumerate(sets[:-1]):
        diff = np.setxor1d(lead, own)
        members.append((7, k, len(own), int(shingle_sets.jaccard(lead, own) >= 0.85), diff.tobytes()))
    frame = spark.createDataFrame([(a, b, c, d, bytearray(e)) for a, b, c, d, e in members], "leader long, node long, size long, linked long, diff binary")
    got = [(r["a"], r["b"]) for r in stars.star_links(frame, similarity=0.85, star_rows=star_rows).collect()]
    near = [(i, j) for i in range(len(members)) for j in range(i) if shingle_sets.jaccard(sets[i], sets[j]) >= 0.85]
    known = [(m[1], -1) for m in members if m[3]]
    assert all(shingle_sets.jaccard(sets[a], sets[b]) >= 0.85 for a, b in got) and got
    alone = [(k, k) for k in range(len(members))]
    want, have = plain_components(alone + near + known), plain_components(alone + got + known)
    assert {frozenset(k for k in want if want[k] == r) for r in set(want.values())} == {frozenset(k for k in have if have[k] == r) for r in set(have.values())}


def test_blocks_lose_no_pair():
    """All pairs of a list that the size and position bounds leave, of different groups and stars."""
    rng = np.random.default_rng(3)
    n = rng.integers(10, 40, 300)
    left = n - rng.integers(0, 6, 300)
    rows = np.zeros((300, 4 + len(shingle_sets.SKETCH)), "i8")
    rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3] = (n << 32) + left, np.arange(300), rng.integers(0, 40, 300), rng.integers(0, 60, 300)
    starts = np.array([0, 1, 100, 180])
    ends = np.array([1, 100, 180, 300])
    for s, e in zip(starts, ends, strict=True):
        rows[s:e] = rows[s:e][np.argsort(rows[s:e, 0], kind="stable")]
    got = {(int(a), int(b)) for x, y in set_join.block_meetings(rows, starts, ends, 0.85) for a, b in zip(x, y, strict=True)}
    want = set()
    for s, e in zip(starts, ends, strict=True):
        for a in range(s, e):
            for b in range(a + 1, e):
                (na, la), (nb, lb) = ((int(rows[k, 0]) >> 32, int(rows[k, 0]) & 0xFFFFFFFF) for k in (a, b))
                least = -(-85 * (na + nb) // 185)
                if least <= min(na, nb, la, lb) and rows[a, 2] != rows[b, 2] and rows[a, 3] != rows[b, 3]:
                    want.add((a, b))
    assert got == want


def passages(count, words, seed):
    """Texts of ``words`` words of their own, and a passage that all share."""
    rng = np.random.default_rng(seed)
    passage = " ".join(f"p{k}" for k in range(80))
    rows = []
    for k in range(count):
        own = [f"o{k}x{j}" for j in range(int(rng.integers(words, words + 200)))]
        rows.append((k, f"{' '.join(own[: words // 2])} {passage} {' '.join(own[words // 2 :])}"))
    return rows


def test_long_texts_that_share_a_passage_are_no_pairs(spark, monkeypatch):
    """Pairs written, before texts are compared, for long texts that lists bring together and that have little in common."""
    written, plain = [], set_join.block_pairs

    def counted(*args, **more):
        written.append(plain(*args, **more).count())
        return plain(*args, **more)

    monkeypatch.setattr(set_join, "block_pairs", counted)
    for count in (20, 40):
        rows = passages(count, 2500, 1)
        assert joined(spark, rows) == plain_rows(rows)
    assert written[0] <= 20 and written[1] <= 40, written


@pytest.mark.parametrize("words,changed", [(1030, 10), (2060, 20), (2060, 21)])
def test_sets_about_the_sizes_where_sketches_lengthen(spark, words, changed):
    rows = [(k, " ".join(t.split()[: words - 4 * (k % 8)])) for k, t in family(30, words, changed, changed)] + [(100 + k, t) for k, t in passages(10, words, 2)]
    assert joined(spark, rows) == plain_rows(rows)


@pytest.mark.parametrize("max_token_rows", [1 << 30, 7])
def test_nearest_entries_are_one_each_and_all_that_meet(spark, max_token_rows):
    rows = family(40, 200, 2, 6) + [(100 + k, t) for k, t in family(12, 1500, 14, 7)] + [(200 + k, t) for k, t in passages(10, 1800, 2)]
    texts = spark.createDataFrame([(k, t.encode()) for k, t in rows], "text_hash long, utf8 binary").repartition(3)
    shared = shingle_sets.dealt(shingle_sets.prefixes(texts, np.zeros(shingle_sets.BUCKETS, "i8"), shingle=4, similarity=0.85), max_token_rows)
    sets = {k: simhash.shingle_set(t.encode(), 4) for k, t in rows}
    drawn = [(k, k - k % 2, k - k % 3, *shingle_sets.sketch(x).tolist(), shingle_sets.large_sketch(x)) for k, x in sets.items()]
    groups = spark.createDataFrame(drawn, f"node long, `group` long, star long, {', '.join(f'{x} long' for x in shingle_sets.SKETCH)}, bins binary")
    got = [tuple(r) for r in set_join.nearest_entries(shared, groups, similarity=0.85).select("token", "part", "with_part", "node", "partner").collect()]
    pairs = {tuple(r) for r in set_join.block_pairs(shared, groups, similarity=0.85).collect()}
    assert got and len(got) == len({r[:4] for r in got}) <= shared.count()
    assert {r[3] for r in got} == {k for p in pairs for k in p} and {(min(r[3:]), max(r[3:])) for r in got} <= pairs
    near = {(a, b) for a in sets for b in sets if a < b and a // 2 != b // 2 and a // 3 != b // 3 and shingle_sets.jaccard(sets[a], sets[b]) >= 0.85}
    assert near <= pairs and any(a >= 100 for a, _ in near) and not any(b >= 200 for _, b in pairs)


def test_distances_of_large_sketches():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 62, n, dtype="u8")) for n in (500, 1024, 1025, 2048, 2049, 9000)]
    bins = pa.array([None, None, None, *[shingle_sets.large_sketch(x) for x in sets]], pa.binary()).slice(3)
    x, y = (k.ravel() for k in np.indices((6, 6)))
    want = [shingle_sets.apart(*[np.frombuffer(bins[int(k)].as_py(), "i8") for k in p]) if min(p) > 1 else 0 for p in zip(x, y, strict=True)]
    assert shingle_sets.large_apart(bins, x, y).tolist() == want
    assert all(d <= len(np.setxor1d(sets[a], sets[b])) for a, b, d in zip(x, y, want, strict=True))


def test_leaders_come_first(spark):
    rows = family(40, 200, 4, 6)
    texts = spark.createDataFrame([(k, t.encode()) for k, t in rows], "text_hash long, utf8 binary")
    shared = shingle_sets.prefixes(texts, np.zeros(shingle_sets.BUCKETS, "i8"), shingle=4, similarity=0.85)
    sizes = dict(enumerate(map(len, plain_sets([t for _, t in rows], 4))))
    for max_list in (10, 1000):
        led = {r["node"]: r["leader"] for r in stars.leaders(shared, similarity=0.85, max_list=max_list).collect()}
        assert led and all((sizes[b], b) < (sizes[a], a) for a, b in led.items())


def test_differences_add_up(spark):
    rows = family(30, 200, 4, 6)
    sets = [np.sort(np.array([hash(s) % 2**63 for s in own], "u8")) for own in plain_sets([t for _, t in rows], 4)]
    chain = [(k + 1, k) for k in range(20)] + [(k, 0) for k in range(21, 30)]  # node, leader
    told = [(b, a, len(sets[a]), len(sets[b]), int(shingle_sets.jaccard(sets[a], sets[b]) >= 0.85), bytearray(np.setxor1d(sets[a], sets[b]).tobytes())) for a, b in chain]
    got = stars.followed(spark.createDataFrame(told, "leader long, node long, size long, leader_size long, linked long, diff binary"), similarity=0.85).collect()
    assert sorted(r["node"] for r in got) == list(range(1, 30)) and {r["leader"] for r in got} == {0}
    for r in got:
        assert bytes(r["diff"]) == np.setxor1d(sets[r["node"]], sets[0]).tobytes() and r["linked"] == int(shingle_sets.jaccard(sets[r["node"]], sets[0]) >= 0.85)


def test_query_equals_sql(spark):
    compare(spark, SF, queries.op12_jaccard_join, queries.oracle_sql()["op12_jaccard_join"])

