"""Numbered CSV parts of exact size under one committed writer: ``base.csv``, ``base_1.csv``, ``base_2.csv`` and so on.

A Spark data source: each task writes the part it holds to a file of its own attempt beside the parts, and only when all tasks are done
does the driver give the files their names.  A failed attempt, or a failed job, leaves no part; a job that runs again can't mix with
what is there, for existing parts are an error.  Files go through ``pyarrow.fs`` (local or mounted, S3, GCS, HDFS).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from flowmill.sources.sinks import split_parts

FORMAT = "numbered_csv"


def _fs(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


@dataclass
class Written(WriterCommitMessage):
    """The parts that a task wrote: (number, file)."""

    parts: list[tuple[int, str]]


class PartsWriter(DataSourceArrowWriter):
    """Rows come with their part's number in the column ``__part``, those of a part together and in order."""

    def __init__(self, path: str, base: str, run: str) -> None:
        self.path, self.base, self.run = path, base, run

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = _fs(self.path)
        parts: list[tuple[int, str]] = []
        writer = sink = None
        for batch in iterator:
            place = batch.schema.get_field_index("__part")
            number, rows = batch.column(place).to_pylist(), batch.drop_columns(["__part"])
            cuts = [0, *[k for k in range(1, len(number)) if number[k] != number[k - 1]], len(number)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if not parts or parts[-1][0] != number[a]:
                    if writer:
                        writer.close(), sink.close()
                    parts.append((number[a], f"{path}/_parts-{self.run}/{uuid.uuid4().hex}.csv"))
                    fs.create_dir(parts[-1][1].rpartition("/")[0])
                    sink = fs.open_output_stream(parts[-1][1])
                    writer = pyarrow.csv.CSVWriter(sink, rows.schema, write_options=pyarrow.csv.WriteOptions(quoting_style="needed"))
                writer.write_batch(rows.slice(a, b - a))
        if writer:
            writer.close(), sink.close()
        return Written(parts)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = _fs(self.path)
        found = sorted(x for m in messages if m is not None for x in m.parts)
        if len({n for n, _ in found}) < len(found):
            raise ValueError("a part came from several tasks")
        for n, file in found:
            fs.move(file, f"{path}/{self.base}{f'_{n}' if n else ''}.csv")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = _fs(self.path)
        if fs.get_file_info(f"{path}/_parts-{self.run}").type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(f"{path}/_parts-{self.run}")


class NumberedParts(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> PartsWriter:
        return PartsWriter(self.options["path"], self.options["base"], self.options["run"])


def write_numbered(df: DataFrame, path: str, rows: int, order: list[str], *, base: str = "base") -> None:
    """``df`` in ``order`` (unique) as parts of exactly ``rows`` rows (the last one shorter), each with the header. Existing parts of this
    base are an error; without rows nothing is written. NULL and empty text are both empty cells.
    """
    fs, place = _fs(path)
    fs.create_dir(place)
    known = re.compile(rf"{re.escape(base)}(_\d+)?\.csv")
    if any(known.fullmatch(f.base_name) for f in fs.get_file_info(pyarrow.fs.FileSelector(place))):
        raise ValueError(f"{path} already has parts of {base}")
    spark = df.sparkSession
    spark.dataSource.register(NumberedParts)
    numbered = split_parts(df, rows, order, name="__part")
    parts = numbered.agg(F.max("__part")).first()[0]
    if parts is None:
        return
    dealt = numbered.repartitionById(int(parts) + 1, F.col("__part").cast("int")).sortWithinPartitions("__part", *order)
    dealt.write.format(FORMAT).mode("append").options(path=path, base=base, run=uuid.uuid4().hex).save()
