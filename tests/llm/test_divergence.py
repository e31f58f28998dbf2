"""Divergences of sources against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from flowmill.llm import divergence, queries
from flowmill.llm.common import table
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain_rows(docs, min_docs, top):
    """The operator's rows. ``docs``: text, lang, source."""
    groups, in_docs, out = defaultdict(Counter), defaultdict(Counter), []
    for text, lang, source in ((t or "", g or "", s or "") for t, g, s in docs):
        words = [lowered(w) for w in TERM.findall(text)]
        groups[lang, source].update(words)
        in_docs[lang].update(set(words))
    for lang in in_docs.keys() | {x for x, _ in groups}:
        kept = [t for t, n in in_docs[lang].items() if n >= min_docs]
        own = {s: c for (g, s), c in groups.items() if g == lang}
        whole = sum(own.values(), Counter())

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in own.items()}, shares(whole)
        for s in own:
            pairs = [(sum(abs(p[s][t] - p[x][t]) for t in kept), x) for x in own if x != s]
            terms = [(p[s][t] - q[t], t) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def invented(seed=1):
    rng, words = np.random.default_rng(seed), ["The", "the", "cat", "Éa", "éa", "日本", "x1y", "a-b", "zebra", "q"]
    rows = []
    for k in range(120):
        some = rng.choice(words[: 4 + k % 7], rng.integers(0, 12))
        rows.append((" ".join(map(str, some)) + ("tail" if k % 3 else " "), ["en", "de", None][k % 5 % 3], [None, "a", "b", "é", "z"][int(rng.integers(0, 1 + k % 5))]))
    return rows + [(None, "fr", "only"), ("", "fr", "other"), ("Once " * 3000, "en", "a")] * 2


def rows_of(spark, docs, **more):
    frame = spark.createDataFrame(docs, "text string, lang string, source string") if isinstance(docs, list) else docs
    return sorted(tuple(r) for r in divergence.source_divergence(frame, **more).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("more", [{}, {"bits": 2, "window": 16}, {"max_keys": 0, "block_cells": 3}, {"window": 7, "block_cells": 1}])
def test_equals_brute_force(spark, more):
    docs = invented()
    assert rows_of(spark, docs, min_docs=6, top=3, **more) == plain_rows(docs, 6, 3)


@pytest.mark.parametrize("min_docs", [1, 30])
def test_edges(spark, edges, min_docs):
    docs = [(r["text"], r["lang"], r["source"]) for r in edges.collect()]
    more = edges.select("*", *[F.lit(1).alias(x) for x in ("term", "n", "total", "block", "kind", "item", "value", "docs", "key")])
    assert rows_of(spark, more, min_docs=min_docs) == plain_rows(docs, min_docs, 50)
    assert rows_of(spark, [], min_docs=min_docs) == []


@pytest.mark.parametrize("size", [1, 3, 64])
def test_boundaries(size):
    """Terms of concatenated buffers, wherever windows are cut; no term crosses from one text to the next."""
    texts = ["Abc", "def", "", "x--Y é", "", "éé日本", "end\x00 9z", "word" * 20, "a"]
    column = pa.array([t.encode() for t in ["skipped", *texts]], pa.binary()).slice(1)
    got = defaultdict(list)
    for low, a, b, docs in divergence.windows(*divergence.buffers(column), size):
        for x, y, d in zip(a.tolist(), b.tolist(), docs.tolist(), strict=True):
            got[d].append(low[x:y].decode())
    assert [got[k] for k in range(len(texts))] == [[lowered(w) for w in TERM.findall(t)] for t in texts]


@pytest.mark.parametrize("bits", [1, 64])
def test_distinct_slices_are_verified(bits):
    long = [b"abcdefghijklmnop" + x for x in (b"", b"q", b"qr", b"qs", b"r" * 40, b"r" * 39 + b"s")]
    words = [b"aa", b"ab", b"aa", b"b", b"abcdefgh", b"abcdefghi", b"abcdefgj", *long, b"ab", b"aa", *long]
    low = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    places, number, hashed = divergence.distinct(low, starts, ends, bits)
    assert [words[places[k]] for k in number] == words and len(places) == len(set(words))
    assert hashed.tolist() == [xxhash.xxh64_intdigest(words[k]) for k in places]


def test_shares_are_exact():
    rng = np.random.default_rng(5)
    of = rng.integers(10**6, 9 * 10**15, 2000)
    count = (of * rng.random(2000)).astype("i8") - 5
    assert divergence.shares(count, of).tolist() == [1 + 10**9 * (c + 5) // n for c, n in zip(count.tolist(), of.tolist(), strict=True)]
    with pytest.raises(ValueError):
        divergence.shares(np.zeros(1, "i8"), np.array([10**16]))


def test_table(spark):
    docs = [(r["text"], r["lang"], r["source"]) for r in table(spark, SF, "documents").collect()]
    got = sorted(tuple(r) for r in queries.op11_source_divergence(spark, SF).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_rows(docs, 30, 50) and any(r[2] == "term" for r in got)


def test_query_equals_sql(spark):
    compare(spark, SF, queries.op11_source_divergence, queries.oracle_sql()["op11_source_divergence"])
