"""SparkSession builder for tests, benchmarks and interactive use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(cores: int | None = None, app: str = "quern") -> SparkSession:
    """A local session; on a cluster, bring your own session instead.

    UTC and adaptive execution are what the operators assume of any session.
    """
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUERN_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
