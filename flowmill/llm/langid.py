"""Language identification with hyperdimensional profiles.

Each letter, and white space, has a random vector of +1 and -1.  A trigram's vector binds its letters' vectors by product,
each permuted (rotated) by its place.  A document bundles its trigrams' vectors (their sum, with repeats); a language's
prototype bundles its documents.  A document gets the language whose prototype has the highest cosine with it.

Letters are taken in lower case; runs of anything else count as one white space, which also bounds the text.  Trigrams
have a letter in the middle, so every text with a letter has some.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM, SEED, SCALE = 1024, 20_011, 1 << 16

#: Prototypes are collected and sent to all tasks: languages * DIM numbers. A language column with more values than this
#: isn't one, and raises an error.
MAX_LANGUAGES = 2_000

#: Bounds of a block's memory: characters, documents (at most 512, see _KEY), trigrams bound at once.
BLOCK_CHARS, BLOCK_DOCS, CHUNK_GRAMS = 1 << 21, 256, 4096

_LETTER_BITS = 18  # letters are numbered by code point; there are about 140,000
_MASK = (1 << _LETTER_BITS) - 1
_KEY = 3 * _LETTER_BITS  # above these bits of a key stands the document's place in the block


class Letters:
    """Numbers of letters (0: white space) and their vectors, made when first needed."""

    def __init__(self) -> None:
        is_letter = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        self.number = np.where(is_letter, np.cumsum(is_letter), 0).astype("i8")
        self.point = np.concatenate([[0], np.flatnonzero(is_letter)])
        self.vectors: dict[int, np.ndarray] = {}

    def vector(self, number: int) -> np.ndarray:
        if (found := self.vectors.get(number)) is None:
            if len(self.vectors) >= 20_000:
                self.vectors.clear()
            draw = np.random.Generator(np.random.PCG64([SEED, int(self.point[number])]))
            found = self.vectors[number] = (draw.integers(0, 2, DIM, dtype="i1") * 2 - 1).astype("f4")
        return found


_LETTERS: list[Letters] = []


def letters() -> Letters:
    """This process's letters; workers keep them from task to task."""
    if not _LETTERS:
        _LETTERS.append(Letters())
    return _LETTERS[0]


def bind(grams: np.ndarray) -> np.ndarray:
    """The vectors of trigram keys: rotate the first letter's twice, the second's once, and multiply."""
    out = None
    for place, shift in enumerate((2, 1, 0)):
        numbers, which = np.unique(grams >> (shift * _LETTER_BITS) & _MASK, return_inverse=True)
        table = np.stack([np.roll(letters().vector(int(n)), shift) for n in numbers])
        out = table[which] if place == 0 else np.multiply(out, table[which], out=out)
    return out


def trigrams(texts: list[tuple[int, str, bool, bool]]) -> np.ndarray:
    """Keys (place, trigram) of lower-case pieces of text. A piece is its document's place, its characters, and whether
    the first and the last of these only give context, as they belong to the pieces beside it.
    """
    joined = " " + " ".join(t for _, t, _, _ in texts) + " "
    codes = letters().number[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
    sizes = np.array([len(t) + 1 for _, t, _, _ in texts])
    place = np.concatenate([[texts[0][0]], np.repeat([p for p, *_ in texts], sizes)])
    middle = codes > 0
    ends = np.cumsum(sizes)
    middle[[e - s + 1 for e, s, t in zip(ends, sizes, texts, strict=True) if t[2]]] = False
    middle[[e - 1 for e, t in zip(ends, texts, strict=True) if t[3]]] = False
    kept = np.flatnonzero((codes > 0) | (np.concatenate([[1], codes[:-1]]) > 0))
    codes, middle, place = codes[kept], middle[kept], place[kept]
    at = np.flatnonzero(middle[1:-1])
    return place[at + 1] << _KEY | codes[at] << 2 * _LETTER_BITS | codes[at + 1] << _LETTER_BITS | codes[at + 2]


def bundle(keys: np.ndarray, places: int) -> np.ndarray:
    """The bundled vector of each place."""
    keys, counts = np.unique(keys, return_counts=True)
    grams, which = np.unique(keys & (1 << _KEY) - 1, return_inverse=True)
    where = keys >> _KEY
    out = np.zeros((places, DIM), "f4")
    for start in range(0, len(grams), CHUNK_GRAMS):
        part = slice(None) if len(grams) <= CHUNK_GRAMS else (which >= start) & (which < start + CHUNK_GRAMS)
        chunk = grams[start : start + CHUNK_GRAMS]
        table = np.zeros((places, len(chunk)), "f4")
        table[where[part], which[part] - start] = counts[part]
        out += table @ bind(chunk)
    return out


def blocks(texts: Iterable[tuple[int, str]]) -> Iterator[list[tuple[int, str, bool, bool]]]:
    """Pieces of (place, text), cut and gathered so that a block has at most BLOCK_CHARS characters, or one piece more."""
    block, chars = [], 0
    for place, text in texts:
        text = text.lower()
        for start in range(0, len(text), BLOCK_CHARS):
            end = min(start + BLOCK_CHARS, len(text))
            piece = text[max(0, start - 1) : end + 1]
            block.append((place, piece, start > 0, end < len(text)))
            chars += len(piece)
            if chars >= BLOCK_CHARS:
                yield block
                block, chars = [], 0
    if block:
        yield block


def _bundles(texts: list[tuple[int, str]], places: int) -> np.ndarray:
    total = np.zeros((places, DIM), "f8")
    for block in blocks(texts):
        if len(keys := trigrams(block)):
            total += bundle(keys, places)
    return total


def learn(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages in order, their prototypes at length 1) from all rows of ``labelled`` with text and language.

    Every document counts alike, however long: its vector is brought to length SCALE and rounded.  Each task adds up what it
    reads, one vector a language; those are added up by language and dimension.  The sums are whole numbers, so their
    order doesn't matter.
    """

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(start, BLOCK_DOCS)
                vectors = _bundles([(k, t.as_py()) for k, t in enumerate(part.column(0))], part.num_rows)
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors = np.rint(vectors * (SCALE / np.maximum(norms, 1))).astype("i8")
                langs = np.array(part.column(1).to_pylist(), dtype=object)
                for lang in set(langs):
                    sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0)
        for lang, vector in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * DIM, "dim": np.arange(DIM, dtype="i4"), "x": vector})

    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    sums = rows.mapInArrow(profile, "lang string, dim int, x long").groupBy("lang", "dim").agg(F.sum("x").alias("x"))
    vectors = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("v")).select("lang", "v.x").limit(MAX_LANGUAGES + 1).collect()
    if len(vectors) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    known = sorted((r.lang, np.array(r.x, "f8")) for r in vectors if any(r.x))
    if not known:
        return [], np.zeros((0, DIM), "f4")
    return [x for x, _ in known], np.stack([v / np.linalg.norm(v) for _, v in known]).astype("f4")


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score`` of every row. score: the cosine with the winning prototype, 0 where that is negative.

    Texts that are null or have no letter, and all texts if nothing was learned, get ``und`` and 0.  Equal cosines go to the
    language first in order.  Repeated rows get a row each; other columns are not read.
    """
    names, prototypes = model
    out = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    id_type = out.schema[id_col].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(start, BLOCK_DOCS)
                texts = [(k, t.as_py()) for k, t in enumerate(part.column(1)) if t.is_valid]
                vectors = _bundles(texts, part.num_rows)
                norms = np.linalg.norm(vectors, axis=1)
                found = (norms > 0) & bool(names)
                cosines = vectors @ prototypes.T / np.maximum(norms, 1)[:, None] if names else np.zeros((part.num_rows, 1))
                best = cosines.argmax(axis=1)
                langs = [names[b] if ok else "und" for b, ok in zip(best, found, strict=True)]
                scores = np.where(found, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    return out.mapInArrow(predict, f"`{id_col}` {id_type}, lang_pred string, score double")
