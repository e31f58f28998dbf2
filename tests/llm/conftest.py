"""Documents that every operator must take: nulls, empty and long texts, repeats, extra columns with clashing names."""

import pytest

EDGES = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, None), (4, "one", "en", "a"), (5, "12 34 --- !!", "de", "b"), (6, "the cat sat on the mat and the dog lay by the door " * 4, "en", "a"),
    (6, "the cat sat on the mat and the dog lay by the door " * 4, "en", "a"), (7, "der hund und die katze liegen vor der tür und schlafen " * 4, "de", "b"), (None, "no id at all but some text here", "en", None),
    (8, "word " * 20000, "en", "b"), (9, "x" * 50000, None, "b"), (10, "Ünïcödé ẞtraße 日本語 🙂 a\u0301", "de", "a"), (11, "\x00\x1f control <|im_end|> \\n \\ <| <\\| |>", "en", "a"),
]


@pytest.fixture(scope="session")
def edges(spark):
    rows = [(*r, len(r[1] or ""), 0.5, 7, "mine", 3) for r in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, rank int, features string, target int")
