from pyspark.sql import functions as F

from quern.streaming import jobs


def test_window_counts_of_a_long_span_lose_nothing(spark):
    """More days than any fixed delay, and every file covers them all."""
    events = spark.range(800).select((F.timestamp_seconds(1_700_000_000 + (F.col("id") * 37 % 400) * 86_400)).cast("timestamp_ntz").alias("ts"),
                                     F.lit("view").alias("event_type"), F.lit(1.0).alias("value"))
    found = jobs.window_counts(events).collect()
    assert len(found) == 400 and {(r.n, r.total) for r in found} == {(2, 2.0)}
    assert jobs.window_counts(events.where("false")).count() == 0
