"""Sets of a text's shingles: sketches, prefix filters, and exact comparisons of pairs of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import cut, slices
from flowmill.llm.simhash import MAX_BROADCAST_KEYS, shingle_set, with_end

#: Bins of a sketch, 64 to a column.
SKETCH_BITS = 512
SKETCH = [f"s{k}" for k in range(SKETCH_BITS // 64)]

#: Sets of more shingles have a longer sketch beside: unrelated sets of some 1,600 differ in fewer of SKETCH_BITS bins than similar ones may.
LARGE = 1024

#: Words of sketches that are compared at once.
SKETCH_WORDS = 1 << 20

#: Buckets in which the frequencies of shingles are counted; they order the shingles, and don't change what is found.
BUCKETS = 1 << 20

#: Partners of a text that one task compares with it.
MAX_PARTNERS = 1000

#: Texts of one shingle that a task compares; where more share one, each pair of such parts is a task of its own.
MAX_TOKEN_ROWS = 50_000

#: Texts that a task remembers having seen (some 100 bytes each).
LATELY = 200_000


def sketch(own: np.ndarray, bins: int = SKETCH_BITS) -> np.ndarray:
    """The parities of how many of a set fall in each bin, as signed numbers of 64 bits."""
    bits = np.bincount((own % np.uint64(bins)).astype("i8"), minlength=bins).astype("u1") & 1
    return np.packbits(bits, bitorder="little").view("<i8")


def long_sketch(own: np.ndarray) -> np.ndarray:
    """A sketch of at least two bins a shingle, a power of two and not fewer than SKETCH_BITS."""
    return sketch(own, max(SKETCH_BITS, 1 << (2 * len(own) - 1).bit_length()))


def large_sketch(own: np.ndarray) -> bytes | None:
    """A sketch of a bin to one or two shingles, a power of two; none for sets of at most LARGE shingles."""
    return sketch(own, 1 << (len(own) - 1).bit_length() - 1).tobytes() if len(own) > LARGE else None


def large_apart(bins: pa.Array, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bins the sketches (:func:`large_sketch`) at the places ``x`` and ``y`` differ (the longer folded); 0 where one has none."""
    flat = np.frombuffer(bins.buffers()[2] or b"", "u8", bins.buffers()[2].size // 8 if bins.buffers()[2] else 0)
    offsets = np.frombuffer(bins.buffers()[1], "i4")[bins.offset : bins.offset + len(bins) + 1].astype("i8") // 8
    start, length = offsets[:-1], np.diff(offsets)
    out = np.zeros(len(x), "i8")
    some = np.flatnonzero((length[x] > 0) & (length[y] > 0))
    turned = length[x[some]] > length[y[some]]
    short, long = np.where(turned, y[some], x[some]), np.where(turned, x[some], y[some])
    lengths = length[short] << 32 | length[long]
    for both in np.unique(lengths).tolist():
        of, n, m = np.flatnonzero(lengths == both), both >> 32, both & 0xFFFFFFFF
        for part in np.split(of, range(step := max(1, SKETCH_WORDS // m), len(of), step)):
            a, b = (flat[start[at[part]][:, None] + np.arange(k)] for at, k in ((short, n), (long, m)))
            while b.shape[1] > n:
                b = b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2 :]
            out[some[part]] = np.bitwise_count(a ^ b).sum(axis=1, dtype="i8")
    return out


def apart(a: np.ndarray, b: np.ndarray) -> int:
    """In how many bins two sketches differ; the larger one is folded to the other's bins."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count((a ^ b).view("u8")).sum(dtype="i8"))


def nonempty_set(text: bytes, shingle: int) -> np.ndarray:
    own = shingle_set(text, shingle)
    return own if len(own) else np.zeros(1, "u8")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets, not both empty."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def texts_of(wanted: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``wanted`` (node and other columns) with utf8: the text of a row with that text hash. ``nodes``: node, id; ``texts``: id, text_hash, utf8."""
    others = [c for c in wanted.columns if c != "node"]
    keys = cut(wanted.join(nodes, "node").select(*others, F.col("node").alias("want_hash"), F.col("id").alias("want_id")))
    keys = F.broadcast(keys) if keys.count() <= MAX_BROADCAST_KEYS else keys
    found = texts.join(keys, (F.col("text_hash") == F.col("want_hash")) & F.col("id").eqNullSafe(F.col("want_id")))
    return found.select(*others, F.col("text_hash").alias("node"), "utf8")


def possible(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, *, shingle: int, similarity: float) -> DataFrame:
    """Of ``pairs`` (a, b: text hashes) those that may be similar by :func:`long_sketch`. The sketches, not the texts, go to the pairs."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [nonempty_set(t.as_py(), shingle) for t in batch.column(1)]
            columns = [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([long_sketch(x).tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "size", "bins"])

    drawn = texts_of(named, nodes, texts).select("node", "utf8").mapInArrow(draw, "node long, size long, bins binary")
    drawn = cut(drawn.groupBy("node").agg(F.first("size").alias("size"), F.first("bins").alias("bins")))  # a text may be there twice
    left, right = (drawn.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("bins").alias(f"bins_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "size_a", "size_b", "bins_a", "bins_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(2)) + np.asarray(batch.column(3))
            most = sizes - 2 * least_shared(sizes, similarity)
            sketches = zip(*[[np.frombuffer(x.as_buffer(), "<i8") for x in batch.column(k)] for k in (4, 5)], strict=True)
            keep = np.array([apart(x, y) for x, y in sketches], "i8") <= most
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(keep)).columns[:2], ["a", "b"])

    return cut(both.mapInArrow(check, "a long, b long"))


def compared(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, *, shingle: int, similarity: float) -> DataFrame:
    """Of ``pairs`` (a, b: text hashes) those whose texts are similar enough. ``nodes``: node, id; ``texts``: id, text_hash, utf8.

    Texts go to the pairs' end with more partners, each once a pair, in one shuffle; an end with very many partners is dealt out.
    """
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count()
    ends = pairs.join(degree.select(F.col("node").alias("a"), F.col("count").alias("of_a")), "a").join(degree.select(F.col("node").alias("b"), F.col("count").alias("of_b")), "b")
    turned = F.col("of_b") > F.col("of_a")
    dealt_to = F.pmod(F.xxhash64("a", "b"), F.ceil(F.greatest("of_a", "of_b") / MAX_PARTNERS)).cast("int")
    keyed = cut(ends.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("centre"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("node"), dealt_to.alias("part")))
    wanted = keyed.select("centre", "part", "node", F.lit(1).alias("partner")).unionAll(keyed.select("centre", "part", F.col("centre").alias("node"), F.lit(0).alias("partner")).distinct())
    sent = texts_of(wanted, nodes, texts).select("centre", "part", "partner", "node", "utf8")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, "u8")
        for batch in batches:
            found = []
            for key, partner, node, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if partner:
                    if jaccard(nonempty_set(text.as_py(), shingle), own) >= similarity:
                        found.append((key, node) if key < node else (node, key))
                elif key != last:
                    last, own = key, nonempty_set(text.as_py(), shingle)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    key = ["centre", "part"]
    return cut(sent.repartition(*key).sortWithinPartitions(*key, "partner").mapInArrow(check, "a long, b long").distinct())


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """The sums of the ``bucket, n`` rows of :func:`profiles`."""
    out = np.zeros(BUCKETS, "i8")
    for row in rows.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():  # at most BUCKETS rows
        out[row["bucket"]] = row["n"]
    return out


def least_shared(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """The least shingles that two sets share, which have these sizes together and are similar enough."""
    return np.ceil(similarity / (1 + similarity) * sizes - 1e-9).astype("i8")


def prefix(own: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """Of a set of shingles, the first ones by rising frequency: a similar set has one of these among its own first ones."""
    ordered = own[np.lexsort((own, counts[(own % np.uint64(len(counts))).astype("i8")]))]
    return ordered[: len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1]


def prefixes(texts: DataFrame, counts: np.ndarray, *, shingle: int, similarity: float) -> DataFrame:
    """``token, size, node``: the prefix of each text (``text_hash, utf8``), where it shares a token with another text of a size
    that may be similar. size has the set's size in its high half, and in its low half how many of the set come from this token on.
    """
    shared = texts.sparkSession.sparkContext.broadcast(counts)
    names = ["token", "size", "node"]

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lately: set[int] = set()  # of exact copies, a task sends one
        for batch in slices(batches):
            parts = [np.zeros((3, 0), "i8")]
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if node in lately:
                    continue
                if len(lately) >= LATELY:
                    lately.clear()
                lately.add(node)
                own = nonempty_set(text.as_py(), shingle)
                first = prefix(own, shared.value, similarity)
                parts.append(np.stack([first.view("i8"), (len(own) << 32) + len(own) - np.arange(len(first)), np.full(len(first), node)]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(parts, axis=1)], names)

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows, once each, whose neighbour by size has their token. One row is held from batch to batch."""
        rows, kept = np.zeros((0, 3), "i8"), False
        for batch in with_end(batches):
            if batch is not None:
                rows = np.concatenate([rows, np.stack([np.asarray(c) for c in batch.columns], axis=1)])
            if not len(rows):
                continue
            rows = rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])]
            size = rows[:, 1] >> 32
            near = (rows[1:, 0] == rows[:-1, 0]) & (least_shared(size[1:] + size[:-1], similarity) <= size[:-1])  # sizes rise
            keep = np.concatenate([[kept], near]) | np.concatenate([near, [False]])
            done = rows[keep] if batch is None else rows[:-1][keep[:-1]]
            rows, kept = rows[-1:], bool(keep[-1])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in done.T.copy()], names)

    schema = "token long, size long, node long"
    found = texts.select("text_hash", "utf8").mapInArrow(tokens, schema)
    return found.repartition("token").sortWithinPartitions(*names).mapInArrow(meeting, schema)


def dealt(shared: DataFrame, max_rows: int) -> DataFrame:
    """``shared`` with ``part, with_part``: 0, or where over ``max_rows`` rows have one token, a row once for each pair of parts."""
    hot = cut(shared.groupBy("token").count().where(F.col("count") > max_rows).select("token", F.ceil(F.col("count") / max_rows).cast("int").alias("parts")))
    if hot.isEmpty():
        return shared.select("*", F.lit(0).alias("part"), F.lit(0).alias("with_part"))
    own = F.pmod(F.xxhash64("node"), "parts").cast("int")
    several = shared.join(hot, "token", "left").select(*shared.columns, F.coalesce(own, F.lit(0)).alias("own"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("to"))
    return several.select(*shared.columns, F.least("own", "to").alias("part"), F.greatest("own", "to").alias("with_part"))


def of_several_groups(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``shared`` (:func:`prefixes`) whose token comes in texts of several of ``groups`` (node, root; others are alone)."""
    own = shared.join(groups, "node", "left").select("token", "size", "node", F.coalesce("root", "node").alias("group"))
    mixed = own.groupBy("token").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x != y").select("token")
    return own.join(mixed, "token").select("token", "size", "node")
