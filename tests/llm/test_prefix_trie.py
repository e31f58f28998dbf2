"""The trie of conversations against brute force."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmill.llm import prefix_trie, queries
from flowmill.llm.common import table
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


def plain_nodes(rows):
    """The query's rows, by prefixes of whole sequences. ``rows``: conv_id, turn, role, text."""
    original = {}
    for c, turn, role, text in rows:
        if c is not None:
            original.setdefault(c, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode(), role or "", text or ""))
    original = {c: [x[4:] for x in sorted(v)] for c, v in original.items()}
    built = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = original.get(c - int(np.fmod(c, 100)), [])[:h] + own[h:]
    members, ends = {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out, leaves, saved = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[x] for x in below) or 1
        saved[p] = sum(saved[x] for x in below) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), leaves[p], saved[p], sha))
    return sorted(out, key=str)


def nodes_of(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return sorted((tuple(r) for r in queries.conversation_nodes(turns).collect()), key=str)


def many(seed):
    """Conversations of few different turns, so that prefixes are shared at all depths; with gaps, ties and turnless ones."""
    rng, rows = np.random.default_rng(seed), []
    for c in rng.choice(1200, 260, replace=False).tolist():
        for turn in range(int(rng.integers(0, 9))):
            rows.append((c, turn, "user" if turn % 2 else "assistant", f"é{rng.integers(0, 2)}" * int(rng.integers(1, 3))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = many(seed)
    assert nodes_of(spark, rows) == plain_nodes(rows)


def test_edges(spark):
    rows = [
        (None, 0, "user", "no id"), (5, None, None, None), (5, None, "user", ""), (5, 1, "user", "b"), (5, 1, "user", "b"), (5, 1, "user", "a"), (7, 0, "user", "x" * 50000), (-3, 0, "user", "z"), (-3, 2**40, "user", "late"),
        (-3, -(2**40), "user", "early"), (100, 0, "user", "hi"), (102, 0, "user", "hi"), (101, 0, "user", "hi"), (0, 3, "user", "t"), (0, 2, "user", ""),
    ]
    rows += [(c, t, "user", "same") for c in range(300, 340) for t in range(7)]
    assert nodes_of(spark, rows) == plain_nodes(rows)
    assert nodes_of(spark, [(1, 0, "user", "hi")]) == plain_nodes([(1, 0, "user", "hi")])
    assert nodes_of(spark, []) == []


def test_extra_columns(spark):
    rows = many(3)[:60]
    plain = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    more = plain.select("*", *[F.lit(9).alias(x) for x in ("pos", "key", "node", "depth", "n_convs", "piece", "start")])
    assert sorted(map(str, queries.conversation_nodes(more).collect())) == sorted(map(str, queries.conversation_nodes(plain).collect()))


def test_pieces_of_a_long_conversation(spark):
    rows = spark.range(5000).select(F.lit(1).alias("conv_id"), F.when(F.col("id") < 4990, F.col("id") * 3).alias("turn"), F.lit("user").alias("role"), F.format_string("%06d", "id").alias("text"))
    got = prefix_trie.ordered_turns(rows).orderBy("pos").collect()
    plain = rows.orderBy(F.col("turn").asc_nulls_first(), "text").select(F.unhex(F.sha2(F.concat(F.lit("4:user"), "text"), 256)).alias("key")).collect()
    assert [r["pos"] for r in got] == list(range(5000)) and [r["key"] for r in got] == [r["key"] for r in plain]


def test_digests_of_many_ids(spark):
    ends = spark.range(-3000, 5000, 1, 7).select(F.lit(2).cast("long").alias("depth"), F.lit(-3000).cast("long").alias("node"), F.col("id").alias("conv_id"))
    one = prefix_trie.id_digests(ends).collect()
    assert [r["sha"] for r in one] == [hashlib.sha256(",".join(map(str, range(-3000, 5000))).encode()).hexdigest()]


def test_table(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.op13_prefix_trie(spark, SF).collect()), key=str) == plain_nodes(rows)


def test_query_equals_sql(spark):
    compare(spark, SF, queries.op13_prefix_trie, queries.oracle_sql()["op13_prefix_trie"])
