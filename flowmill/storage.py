"""The folder that driver and executors share, and tables cut from their lineage there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a temporary folder is made and set, in local mode only: on a cluster a
    machine's own folder would lose data, so that is an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="flowmill-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        given = f"file://{path}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(given)
    return given


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: a lost executor costs no recomputation of what came before.

    It is written as Parquet, so later plans know its true size.  (A checkpoint keeps the estimate it was planned with; joins multiply
    estimates, and after some rounds of joins the planner computes with numbers of millions of digits.)  What Parquet can't
    hold, columns without a type or of names that differ in case only, is checkpointed.
    """
    folder = shared_dir(df.sparkSession).rstrip("/")
    names = [n.lower() for n in df.columns]
    if not names or len(set(names)) < len(names) or "void" in df.schema.simpleString() or "interval" in df.schema.simpleString():
        return df.checkpoint(eager=True)
    path = f"{folder}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` marked for a broadcast if it has at most ``most`` rows, else as it is, for Spark to join by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
