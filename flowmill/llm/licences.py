"""Licence scan: passages of whole lines compared with licence templates by Dice coefficient over word bigrams.

Texts and templates are normalised: lower case, words of letters and digits, copyright lines left out.  A passage is a run
of lines; its Dice coefficient with a template is twice the shared bigrams over both's bigrams, with repeats.  Of a
coefficient t or more follows a bound of the sizes, ``t / (2 - t)`` to ``(2 - t) / t`` times the template's, and with it a least
number of shared bigrams in the longest passage allowed; templates that fail these bounds are not compared.

Similar licences match the same words, so passages compete: the highest coefficient first, each keeps its lines, and passages that
overlap a kept one go.  So every licence in a text is found where it fits best, however near to others.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from flowmill.llm.licence_texts import TEMPLATES
from flowmill.llm.text import words

THRESHOLD = 0.8

#: Templates are sent along with every task, so together they may have so many characters.
MAX_TEMPLATE_CHARS = 16 << 20

#: Start lines of passages that are compared at once.
STARTS = 256

_COPYRIGHT = re.compile(r"\W*(?:copyright|\(c\)|©)(?!\w)")


def lines_of(text: str) -> Iterator[list[str]]:
    """The words of each line that has any and isn't a copyright line."""
    for line in text.lower().split("\n"):
        if not _COPYRIGHT.match(line) and (own := words(line)):
            yield own


class Templates:
    """Templates by their bigrams, as numbers of pairs of word numbers."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float) -> None:
        self.number: dict[str, int] = {}
        split = [(name, [self.number.setdefault(w, len(self.number) + 1) for line in lines_of(text) for w in line]) for name, text in templates]
        split = [(name, w) for name, w in split if len(w) > 1]
        self.names, self.threshold = [name for name, _ in split], threshold
        self.counts = [Counter(zip(w, w[1:])) for _, w in split]
        self.sizes = np.array([len(w) - 1 for _, w in split])
        least = threshold / (2 - threshold)
        self.low, self.high = np.ceil(self.sizes * least - 1e-9).astype("i8"), np.floor(self.sizes / least + 1e-9).astype("i8")
        # Dice >= t needs t (size + passage) / 2 shared bigrams, and no passage is smaller than the bound.
        self.shared = np.ceil(threshold * (self.sizes + self.low) / 2 - 1e-9).astype("i8")
        self.wide = len(self.number) + 1
        self.codes = np.unique(np.array([a * self.wide + b for c in self.counts for a, b in c], "i8"))
        #: How often each template has each bigram.
        self.most = np.array([[c.get((int(x // self.wide), int(x % self.wide)), 0) for x in self.codes] for c in self.counts], "i4")

    def scan(self, text: str) -> list[tuple[int, float, int]]:
        """(template, coefficient, line) of the passages that reach the threshold and outdo all they overlap; line is the
        number of the passage's first line among those compared."""
        get, lines, starts, size = self.number.get, [], [], 0
        for line in lines_of(text):
            starts.append(size)
            lines.append(np.fromiter((get(w, 0) for w in line), "i4", len(line)))
            size += len(line)
        if size < 2 or not self.names:
            return []
        flat = np.concatenate(lines).astype("i8")
        pairs = flat[:-1] * self.wide + flat[1:]
        at = np.minimum(np.searchsorted(self.codes, pairs), len(self.codes) - 1)
        hits = np.flatnonzero((flat[:-1] > 0) & (flat[1:] > 0) & (self.codes[at] == pairs))
        if len(hits) < self.shared.min():
            return []
        bounds = np.array([*starts, size])
        found = [(-dice, k, line, end) for k in range(len(self.names)) for dice, line, end in self.passages(k, hits, at[hits], bounds)]
        kept: list[tuple[int, int]] = []
        out = []
        for dice, k, line, end in sorted(found):
            place = bisect_left(kept, (line, end))
            if (place == 0 or kept[place - 1][1] <= line) and (place == len(kept) or kept[place][0] >= end):
                kept.insert(place, (line, end))
                out.append((k, -dice, line))
        return out

    def passages(self, k: int, hits: np.ndarray, codes: np.ndarray, bounds: np.ndarray) -> list[tuple[float, int, int]]:
        """(coefficient, first line, line behind) of the best passage from each line that reaches the threshold; of equal ones
        the shortest.  ``hits`` are the places of bigrams of any template, ``codes`` which ones.
        """
        least, low, high, most = int(self.shared[k]), int(self.low[k]), int(self.high[k]), self.most[k]
        own = most[codes] > 0
        hits, codes = hits[own], codes[own]
        if len(hits) < least:
            return []
        dense = hits[: len(hits) - least + 1][hits[least - 1 :] - hits[: len(hits) - least + 1] < high]
        first_lines = np.unique(np.searchsorted(bounds, dense, side="right") - 1)
        # A bigram that the template has n times counts in a passage unless n of its kind come before it there.
        order = np.argsort(codes, kind="stable")
        before = np.arange(len(hits)) - most[codes[order]]
        same = (before >= 0) & (codes[order][np.maximum(before, 0)] == codes[order])
        earlier = np.full(bounds[-1] + high + 1, bounds[-1])  # of the n-th before it; places of no bigram are never counted
        earlier[hits[order]] = np.where(same, hits[order][np.maximum(before, 0)], -1)
        is_bound = np.zeros(bounds[-1] + high + 2, bool)
        is_bound[bounds] = True
        sizes = np.arange(1, high + 1)
        out = []
        for part in range(0, len(first_lines), STARTS):
            lines = first_lines[part : part + STARTS]
            start = bounds[lines][:, None]
            shared = np.cumsum(earlier[start + sizes - 1] < start, axis=1)
            dice = np.where(is_bound[start + sizes + 1] & (sizes >= low), 2 * shared / (sizes + self.sizes[k]), 0.0)
            best = dice.argmax(axis=1)
            for line, n, value in zip(lines, best, dice[np.arange(len(lines)), best], strict=True):
                if value >= self.threshold - 1e-12:
                    out.append((float(value), int(line), int(np.searchsorted(bounds, bounds[line] + n + 2))))
        return out


_TEMPLATES: dict[tuple, Templates] = {}


def _templates(templates: tuple[tuple[str, str], ...], threshold: float) -> Templates:
    if (templates, threshold) not in _TEMPLATES:
        _TEMPLATES.clear()
        _TEMPLATES[templates, threshold] = Templates(list(templates), threshold)
    return _TEMPLATES[templates, threshold]


def scan_licences(docs: DataFrame, templates: list[tuple[str, str]] | None = None, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, licence, dice, line``: of each document, the best passage of each licence found; no row for one without any.

    Of passages that overlap, the one of the highest coefficient (then first in the list, then of the first line) counts.  Null texts
    have no lines; repeated rows give repeated results; other columns are not read.  Whole texts are compared, in time that grows
    with their length; the numbers of a text's words are held in memory.
    """
    given = tuple(TEMPLATES if templates is None else templates)
    if sum(len(t) for _, t in given) > MAX_TEMPLATE_CHARS:
        raise ValueError(f"templates of over {MAX_TEMPLATE_CHARS} characters can't go along with every task")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    id_type, arrow_id = rows.schema["id"].dataType.simpleString(), to_arrow_type(rows.schema["id"].dataType)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _templates(given, threshold)
        for batch in batches:
            found = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                best: dict[str, tuple[float, int]] = {}
                for k, dice, line in own.scan(text.as_py()):
                    best[own.names[k]] = max(best.get(own.names[k], (0.0, 0)), (dice, -line))
                found += [(doc_id, name, dice, -line) for name, (dice, line) in sorted(best.items())]
            columns = [pa.array([x[k] for x in found], t) for k, t in enumerate((arrow_id, pa.string(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "licence", "dice", "line"])

    return rows.mapInArrow(scan, f"`{id_col}` {id_type}, licence string, dice double, line long")


def read_templates(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(file name without its ending, text) of each text file in a folder: licences whole, as long as they are."""
    files = spark.read.text(f"{folder}/*", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value")
    if (files.agg(F.sum(F.length("value"))).first()[0] or 0) > MAX_TEMPLATE_CHARS:
        raise ValueError(f"templates of over {MAX_TEMPLATE_CHARS} characters can't go along with every task")
    return sorted((r["name"].removesuffix(".txt"), r["value"]) for r in files.collect())
