"""Structured Streaming jobs over event tables, run to the end of their input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.sources.files import append_missing
from quern.sources.scratch import scratch


def as_stream(rows: DataFrame, files: int = 4, per_trigger: int = 1) -> DataFrame:
    """The rows as a file stream of several micro-batches."""
    path = scratch(rows.sparkSession)
    rows.repartition(files).write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def run(stream: DataFrame, mode: str, each) -> None:
    """Processes what is there and stops; ``each`` gets every micro-batch and its number."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(stream.sparkSession)).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def span(events: DataFrame) -> str:
    """The time between the first and the last event, rounded up: with that delay no row can be late."""
    first, last = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    return f"{0 if first is None else (last - first) // 1_000_000 + 1} seconds"


def window_counts(events: DataFrame, delay: str | None = None, width: str = "1 day") -> DataFrame:
    """Event-time tumbling windows with a watermark: (start, event_type, n, total).

    Timestamps without a zone can not carry a watermark, so they are cast. The delay is the span of
    the events if none is given, so that all rows count, whatever their order. Every micro-batch sends the windows it
    changed; the last state of each window is the result.
    """
    spark, path = events.sparkSession, scratch(events.sparkSession)
    zoned = events.withColumn("ts", F.col("ts").cast("timestamp"))
    counts = as_stream(zoned).withWatermark("ts", delay or span(zoned)).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    flat = counts.select(F.col("w.start").alias("start"), "event_type", "n", "total")
    run(flat, "update", lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(path))
    done = spark.read.schema("start timestamp, event_type string, n bigint, total double, batch bigint").parquet(path)
    last = done.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("v"))
    return last.select("start", "event_type", "v.n", "v.total")


def deduplicate(events: DataFrame, keys: list[str]) -> DataFrame:
    """The stream without repeated keys; a run over the same input again appends nothing."""
    spark, path = events.sparkSession, scratch(events.sparkSession)
    stream = as_stream(events)
    run(stream.dropDuplicates(keys).select(*keys), "append", lambda batch, number: append_missing(batch, path, keys[0]))
    return spark.read.schema(events.select(*keys).schema).parquet(path)


ORDERED = "key bigint, seq bigint, position bigint"


def reorder(events: DataFrame, key: str, seq: str) -> DataFrame:
    """Rows of each key leave in the order of their sequence numbers, which count from 0: (key, seq, position).

    A row that comes early waits in the key's state until all before it have left.
    """
    spark, path = events.sparkSession, scratch(events.sparkSession)

    def release(key_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected, waiting = state.get if state.exists else (0, [])
        held = {*waiting, *(int(s) for b in batches for s in b["seq"])}
        out = []
        while expected in held:
            held.discard(expected)
            out.append(expected)
            expected += 1
        state.update((expected, sorted(held)))
        yield pd.DataFrame({"key": [key_[0]] * len(out), "seq": out, "position": out})

    stream = as_stream(events.select(F.col(key).cast("bigint").alias("key"), F.col(seq).cast("bigint").alias("seq")))
    ordered = stream.groupBy("key").applyInPandasWithState(release, ORDERED, "expected bigint, waiting array<bigint>", "append", GroupStateTimeout.NoTimeout)
    run(ordered, "append", lambda batch, number: batch.write.mode("append").parquet(path))
    return spark.read.schema(ORDERED).parquet(path)


