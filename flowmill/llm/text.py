"""Words of a text as numbers, for operators that compare passages, and well mixed bits of numbers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np

WORD = re.compile(r"[^\W_]+")
PIECE_CHARS = 1 << 20


def words(text: str) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return WORD.findall(text.lower())


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of about PIECE_CHARS characters, none of which ends inside a word."""
    at = 0
    while at < len(text):
        end = at + PIECE_CHARS
        while end < len(text) and not text[end - 1].isspace():
            end += 1
        yield text[at:end]
        at = end


def numbers(text: str, get: Callable[[str, int], int]) -> np.ndarray:
    """``get(word, 0)`` of each word; only the numbers of a long text are ever held whole."""
    found = [np.fromiter((get(w, 0) for w in own), "i4", len(own)) for own in map(words, pieces(text))]
    return np.concatenate(found) if found else np.zeros(0, "i4")


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: well mixed bits of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
