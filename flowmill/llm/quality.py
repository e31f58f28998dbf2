"""Quality classifier: a generalised additive model with pairwise interactions over features of the text.

Each feature has a lookup table over bins, each chosen pair of features a table over a grid of bins.  Cyclic boosting adds
to one table after the other, each time a shallow tree fitted to the logistic loss' gradients in that table's bins.  A score
is the sum of a document's table entries, through the logistic function.

The features are computed by Spark tasks over whole texts.  The model is fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import fresh

FEATURES = ("log_bytes", "letters", "upper", "digits", "spaces", "stops", "exclaims", "signs", "mean_word", "distinct_words", "repeated_next", "distinct_lines", "log_words_line", "entropy")

#: Bound of the sample that the model is fitted on: the labelled rows whose ids hash lowest.
MAX_LABELLED = 20_000


def _byte_classes() -> np.ndarray:
    """Which class each byte counts in: letters (also all bytes of letters beyond ASCII), upper, digits, spaces, stops, !, signs."""
    table = np.zeros((256, 7))
    for b in range(256):
        c = chr(b)
        if b >= 128 or c.isalpha():
            table[b, 0] = 1
            table[b, 1] = b < 128 and c.isupper()
        else:
            table[b, 2 if c.isdigit() else 3 if c.isspace() else 4 if c in ".,;:?'\"-()" else 5 if c == "!" else 6] = 1
    return table


_CLASSES = _byte_classes()


def features(text: bytes) -> list[float]:
    """The features of one UTF-8 text; an empty text has zeros, and distinct shares of 1."""
    words = text.split()
    if not words:
        return [0.0] * 9 + [1.0, 0.0, 1.0, 0.0, 0.0]
    counts = np.bincount(np.frombuffer(text, "u1"), minlength=256)
    size = len(text)
    letters, upper, digits, spaces, stops, exclaims, signs = counts @ _CLASSES
    shares = counts[counts > 0] / size
    lines = text.split(b"\n")
    return [
        float(np.log1p(size)), letters / size, upper / max(letters, 1), digits / size, spaces / size, stops / size, exclaims / size, signs / size,
        (size - spaces) / len(words), len(set(words)) / len(words), sum(map(operator.eq, words, words[1:])) / len(words),
        len(set(lines)) / len(lines), float(np.log1p(len(words) / len(lines))), float(-(shares * np.log2(shares)).sum()),
    ]


@dataclass
class Model:
    """Inner bin edges of each feature, tables, and for each pair its features, coarser edges and table."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edges, x[:, k], side="right")]
        coarse = {k: np.searchsorted(self.pair_edges[k], x[:, k], side="right") for pair in self.pairs for k in pair}
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Inner edges at quantiles, and around a value that many rows share."""
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, *, ridge: float = 1.0, least: float = 1.0) -> np.ndarray:
    """Leaf values over a grid of bins, from the sums of gradients and hessians in each: the best cut of any leaf first."""

    def best(box: tuple[slice, slice]) -> tuple[float, tuple[slice, slice], tuple[slice, slice]] | None:
        found = None
        for axis in (0, 1):
            gs, hs = g[box].sum(axis=1 - axis).cumsum(), h[box].sum(axis=1 - axis).cumsum()
            left_h, right_h = hs[:-1], hs[-1] - hs[:-1]
            if not len(left_h):
                continue
            gain = gs[:-1] ** 2 / (left_h + ridge) + (gs[-1] - gs[:-1]) ** 2 / (right_h + ridge) - gs[-1] ** 2 / (hs[-1] + ridge)
            gain = np.where((left_h >= least) & (right_h >= least), gain, -1)
            at = int(gain.argmax())
            if gain[at] > 1e-6 and (found is None or gain[at] > found[0]):
                start, stop = box[axis].start, box[axis].stop
                low, high = list(box), list(box)
                low[axis], high[axis] = slice(start, start + at + 1), slice(start + at + 1, stop)
                found = (float(gain[at]), tuple(low), tuple(high))
        return found

    boxes = [(slice(0, g.shape[0]), slice(0, g.shape[1]))]
    cuts = [best(boxes[0])]
    while len(boxes) < leaves and any(cuts):
        k = max((k for k, c in enumerate(cuts) if c), key=lambda k: cuts[k][0])
        _, low, high = cuts[k]
        boxes[k : k + 1], cuts[k : k + 1] = [low, high], [best(low), best(high)]
    out = np.zeros(g.shape)
    for box in boxes:
        out[box] = g[box].sum() / (h[box].sum() + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 32, rounds: int = 120, pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 60, leaves: int = 4, rate: float = 0.15) -> Model:
    """The model of feature rows ``x`` and labels ``y`` (0 or 1). Without rows, or with one label only, it is a constant."""
    many = x.shape[1]
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(share / (1 - share))), [np.zeros(0)] * many, [np.zeros(1)] * many)
    if len(np.unique(y)) < 2:
        return model
    model.edges = [_edges(x[:, k], bins) for k in range(many)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.pair_edges = [_edges(x[:, k], pair_bins) for k in range(many)]
    fine = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.pair_edges)]
    z = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return y - p, p * (1 - p)

    def sums(cell: np.ndarray, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in slopes())

    for _ in range(rounds):
        for k in range(many):
            step = rate * shallow_tree(*sums(fine[k], (len(model.tables[k]), 1)), leaves)[:, 0]
            model.tables[k] += step
            z += step[fine[k]]

    shapes = {(a, b): (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1) for a, b in combinations(range(many), 2)}
    cells = {p: coarse[p[0]] * shape[1] + coarse[p[1]] for p, shape in shapes.items()}

    def gain(pair: tuple[int, int]) -> float:
        g, h = sums(cells[pair], shapes[pair])
        tree = shallow_tree(g, h, leaves)
        return float((tree * g - tree**2 * h / 2).sum())

    model.pairs = sorted(sorted(shapes, key=gain, reverse=True)[:pairs])
    model.pair_tables = [np.zeros(shapes[p]) for p in model.pairs]
    for _ in range(pair_rounds):
        for table, pair in zip(model.pair_tables, model.pairs, strict=True):
            step = rate * shallow_tree(*sums(cells[pair], shapes[pair]), leaves)
            table += step
            z += step.ravel()[cells[pair]]
    return model


def featurize(docs: DataFrame, text_col: str = "text", *keep: str) -> DataFrame:
    """The columns ``keep`` and an array of features of every row. A null text counts as empty."""
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), *keep)
    kinds = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields[1:]]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([features(t.as_py()) for t in batch.column(0)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], values], [*[n for n, _ in kinds], "features"])

    return rows.mapInArrow(compute, ", ".join(f"`{n}` {t}" for n, t in [*kinds, ("features", "array<double>")]))


def learn(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from ``labels`` (id, label; a null in either is left out, a label over 0 is 1) and their texts in ``docs``.

    At most ``max_rows`` labels take part, those whose ids hash lowest, and as many rows of texts.
    """
    usable = labels.select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("label")).where("id is not null and label is not null")
    scale = 1 << 30
    ranked = usable.withColumn("rank", F.pmod(F.xxhash64("id"), F.lit(scale)))
    # Few rows pass, whatever the number of labels; of these the lowest ranks are taken.
    few = ranked.where(F.col("rank") < min(scale, int(scale * 2 * max_rows / max(1, usable.count())))).orderBy("rank", "id", "label").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id")
    rows = featurize(texts, "text", "rank", "id", "label").orderBy("rank", "id", "label", "features").limit(max_rows).select("label", "features").toArrow()
    x = np.array(rows.column("features").to_pylist(), "f8").reshape(-1, len(FEATURES))
    return fit(x, np.array(rows.column("label").to_pylist(), "f8"))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if not given) and, as column ``name``, the score of every row, from 0 to 1.

    ``name`` must not be among the columns kept.  Null and empty texts are scored by their features, too; repeated rows
    get equal scores.
    """
    keep = docs.columns if keep is None else keep
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias(fresh(docs, "utf8")), *[F.col(f"`{c}`") for c in keep])
    kinds = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields[1:]]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(0)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(model.score(x), pa.float64())], [*[n for n, _ in kinds], name])

    return rows.mapInArrow(compute, ", ".join(f"`{n}` {t}" for n, t in [*kinds, (name, "double")]))
