"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see.

    A local session that names none (as in tests) gets a folder of this machine; on a cluster that is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quern-checkpoint-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quern-{uuid.uuid4().hex}"


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame, computed and written below spark.checkpoint.dir; its lineage ends there."""
    if frame.sparkSession.sparkContext.getCheckpointDir() is None:
        shared_dir(frame.sparkSession)
    return frame.checkpoint()


def materialize(frame: DataFrame, path: str) -> DataFrame:
    """Write a frame as Parquet and read it back: later steps survive lost executors."""
    frame.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Within it, what is computed hands Python workers at most ``rows`` rows at once: for steps over texts and sets."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """Column names close to ``names`` that ``frame`` does not have yet."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(frame: DataFrame, column: str = "text") -> Column:
    return F.coalesce(frame[column].cast("string"), F.lit(""))
