"""Readers and writers for files: typed CSV, JSON lines, chunked and resumable output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV under a fixed schema; lines that do not fit it are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("enforceSchema", True).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, required: Sequence[str]) -> DataFrame:
    """JSON lines without the malformed ones and those that lack a required key."""
    rows = spark.read.schema(f"{schema}, _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.where(F.col("_broken").isNull()).drop("_broken").dropna(subset=list(required))


def project(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Those of ``columns`` that exist."""
    return rows.select(*[c for c in columns if c in rows.columns])


def require(rows: DataFrame, columns: set[str]) -> DataFrame:
    """The rows, if all columns are there."""
    if missing := columns - set(rows.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    return rows


def stride(rows: DataFrame, key: str, first: int = 0, step: int = 1, last: int | None = None) -> DataFrame:
    """Every ``step``-th row by number from ``first`` to ``last``."""
    kept = rows.where((F.col(key) >= first) & ((F.col(key) - first) % step == 0))
    return kept if last is None else kept.where(F.col(key) <= last)


def write_chunks(rows: DataFrame, path: str, size: int) -> None:
    """Files of at most ``size`` rows."""
    rows.write.option("maxRecordsPerFile", size).parquet(path)


def append_missing(rows: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the files at ``path`` lack; running it again changes nothing."""
    spark = rows.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        rows = rows.join(spark.read.schema(rows.schema).parquet(path).select(key), key, "left_anti")
    rows.write.mode("append").parquet(path)


def replace_keys(rows: DataFrame, path: str, key: str) -> None:
    """Write one partition a key, replacing those of the keys at hand alone."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).json(path)
