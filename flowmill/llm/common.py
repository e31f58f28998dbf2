"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.storage import cut, shared_dir

__all__ = ["WORD", "cut", "fresh", "held_out", "shared_dir", "slices", "table"]

#: The white space of the word rule ``[^\x20\x09-\x0D]+``, which all word counts here share.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name starting with ``base`` that ``df`` does not have (names compare without case)."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """True for the rows that no model may learn from: crc32 of the id as text is divisible by ``folds``.

    A null id is held out, too: nothing is learned from rows that can't be told apart.
    """
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(True))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows, for work whose results are much larger than a row."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
