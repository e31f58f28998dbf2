"""Live flows: scoring and label counts on streams. Batch and stream share the operators' expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from flowmill.operators.models import Trained, score_live


def read_captures(spark: SparkSession, path: str, schema: T.StructType | str, *, format: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """Files of a folder as they come, each once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(format).load(path)


def score_stream(stream: DataFrame, trained: Trained, path: str, checkpoint: str, *, keep: list[str], **options) -> StreamingQuery:
    """Scores of every row, appended as Parquet, exactly once."""
    scored = score_live(trained, stream, keep=keep, **options)
    return scored.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, label: str, *, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """``start, label, n_rows`` by time window; rows later than ``late`` are left out, and state stays bounded."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, window), F.col(label).alias("label"))
    return grouped.agg(F.count("*").alias("n_rows")).select(F.col("window.start").alias("start"), "label", "n_rows")


def distinct_stream(stream: DataFrame, key: list[str], time: str, *, late: str = "10 minutes") -> DataFrame:
    """The first of the rows with equal key within the watermark's delay."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)
