import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmill.llm import decontaminate as d
from flowmill.llm.common import table
from flowmill.llm.text import numbers, words

SF = "/root/testdata/sf0.001"


def passage_distance(item, text):
    """The least edit distance of the item to any run of words, by the textbook table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(item, k, vocabulary, rng):
    item = list(item)
    for _ in range(k):
        at, kind = rng.integers(len(item)), rng.integers(3)
        if kind == 0:
            item[at] = str(rng.choice(vocabulary))
        elif kind == 1:
            item.insert(at, str(rng.choice(vocabulary)))
        else:
            del item[at]
    return item


@pytest.fixture(scope="module")
def bench(spark):
    rows = table(spark, SF, "benchmark").orderBy("item_id").collect()
    return [(r["item_id"], r["text"]) for r in rows]


def test_recall_at_the_bound_and_precision(spark, bench):
    rng = np.random.default_rng(11)
    vocabulary = [w for r in table(spark, SF, "documents").limit(60).collect() for w in words(r["text"])][:20_000]
    made = d.Bench(bench, d.EDITS, d.MIN_WORDS)
    texts, planted = [], []
    for n in range(160):
        k = n % len(bench)
        item = words(bench[k][1])
        around = [str(x) for x in rng.choice(vocabulary, 40)]
        texts.append(numbers(" ".join(around[:20] + edited(item, d.allowed(len(item), d.EDITS), vocabulary, rng) + around[20:]), made.number.get))
        planted.append((n, k))
    found = made.find(texts)
    assert np.mean([p in found for p in planted]) >= 0.95
    for (t, i), edits in found.items():
        assert edits == passage_distance(made.items[i].tolist(), texts[t].tolist()) <= made.bound[i]


def test_all_documents_against_brute_force(spark, bench):
    docs = table(spark, SF, "documents")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in d.find_passages(docs, table(spark, SF, "benchmark")).collect()}
    want = {}
    for r in docs.collect():
        own = words(r["text"])
        for item_id, text in bench:
            item = words(text)
            k = d.allowed(len(item), d.EDITS)
            # No passage has more of the item's words than the text has.
            if len(set(item) & set(own)) >= len(set(item)) - k and (edits := passage_distance(item, own)) <= k:
                want[r["doc_id"], item_id] = edits
    assert got == want and got


def test_short_end_repeats_and_blocks(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "too short"), (3, None), (None, "a b c d e f g h"), (4, "same same same same same same same same"), (5, "")], "item_id int, text string")
    texts = [(1, "One, two THREE four; five six seven eight nine ten."), (1, "one two three four five six seven eight"), (2, "zero one two three four five six seven eight nine"), (3, "same " * 500), (4, None), (None, "one two three four five six seven eight nine ten"), (5, ""), (6, "one two three"), (7, "x " * 70 + "one two three four five six nine ten")]
    docs = spark.createDataFrame([(*t, "mine", 9) for t in texts], "doc_id int, text string, item string, edits int")
    want = {(1, 1, 10, 0), (2, 1, 10, 1), (3, 4, 8, 0), (7, 1, 10, 2)}
    for most in (50_000, 1):
        assert {tuple(r) for r in d.find_passages(docs, items, max_items=most).collect()} == want
    kept = d.remove_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "5", "6"]
    assert d.find_passages(docs.limit(0), items).count() == 0
    assert d.find_passages(docs, items.limit(0)).count() == 0 and d.remove_contaminated(docs, items.limit(0)).count() == len(texts)
    assert d.remove_contaminated(docs, items.where("item_id = 2")).count() == len(texts)


def test_edges(spark, edges):
    assert d.find_passages(edges, table(spark, SF, "benchmark")).count() == 0
    assert d.remove_contaminated(edges, table(spark, SF, "benchmark")).exceptAll(edges).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    from flowmill.llm import text

    whole = " ".join(f"Wörd{k}, x_y" for k in range(300)) + " é" * 50
    get = {w: k + 1 for k, w in enumerate(dict.fromkeys(words(whole)))}.get
    want = numbers(whole, get)
    monkeypatch.setattr(text, "PIECE_CHARS", 7)
    assert np.array_equal(numbers(whole, get), want)
    assert F is not None


@pytest.mark.parametrize("size", [40, 60, 100, 250, 500])
def test_recall_of_long_items(size):
    rng = np.random.default_rng(size)
    vocabulary = [f"v{k}" for k in range(3000)]
    items = [(k, " ".join(map(str, rng.choice(vocabulary, size)))) for k in range(20)]
    made = d.Bench(items, d.EDITS, d.MIN_WORDS)
    texts, planted = [], []
    for n in range(100):
        k, around = n % len(items), [str(x) for x in rng.choice(vocabulary, 40)]
        texts.append(numbers(" ".join(around[:20] + edited(words(items[k][1]), d.allowed(size, d.EDITS), vocabulary, rng) + around[20:]), made.number.get))
        planted.append((n, k))
    found = made.find(texts)
    assert np.mean([p in found for p in planted]) >= 0.98
    for t, i in list(found)[:5]:
        assert found[t, i] == passage_distance(made.items[i].tolist(), texts[t].tolist())


def test_items_of_few_words_are_found_word_for_word(spark):
    items = spark.createDataFrame([(k, " ".join("abcdefgh"[:k])) for k in range(1, 8)] + [(9, "--- !")], "item_id int, text string")
    texts = [(k, "x y " + " ".join("abcdefgh"[:k]) + " z") for k in range(1, 8)] + [(8, "b a c"), (9, "a b x d e"), (10, "A, b; C d e!"), (11, "")]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    got = {(r["doc_id"], r["item_id"]) for r in d.find_passages(docs, items).collect()}
    split = {i: words(t) for i, t in [*texts, *((-i, " ".join("abcdefgh"[:i])) for i in range(1, 8))]}
    want = {(i, k) for i, _ in texts for k in range(1, 8) if split[i] and passage_distance(split[-k], split[i]) <= d.allowed(k, d.EDITS)}
    assert got == want and (10, 5) in got and (9, 5) not in got and all(d.allowed(k, d.EDITS) == 0 for k in range(6))


def test_blocks_by_characters(spark, monkeypatch):
    items = spark.createDataFrame([(k, f"item number {k} " + "of some words " * 4) for k in range(6)], "item_id int, text string")
    docs = spark.createDataFrame([(k, f"an item number {k} " + "of some words " * 4) for k in range(6)], "doc_id int, text string")
    want = sorted(map(tuple, d.find_passages(docs, items).collect()))
    monkeypatch.setattr(d, "MAX_CHARS", 100)
    assert len(list(d._blocks(items, "item_id", "text", 1000))) > 2
    assert sorted(map(tuple, d.find_passages(docs, items).collect())) == want
    assert d.remove_contaminated(docs, items).count() == 0


def test_one_very_long_item_among_many():
    """A long item costs its own words, not those of every item and text; its passages are found at the bound."""
    rng = np.random.default_rng(6)
    vocabulary = [f"v{k}" for k in range(3000)]
    long = [str(w) for w in rng.choice(vocabulary, 4000)]
    items = [(0, " ".join(long))] + [(k, " ".join(map(str, rng.choice(vocabulary, 12)))) for k in range(1, 3000)]
    made = d.Bench(items, d.EDITS, d.MIN_WORDS)
    assert made.pad <= 2 * d.PIECE + 1
    around = [str(w) for w in rng.choice(vocabulary, 30)]
    texts = [" ".join(around), " ".join(around + edited(long, 500, vocabulary, rng) + around), " ".join(long[:2500]), items[7][1], " ".join(long[1500:] + around), ""]
    found = made.find([numbers(t, made.number.get) for t in texts])
    assert {k for k in found if k[1] == 0} == {(1, 0)} and (3, 7) in found and found[1, 0] <= 500
