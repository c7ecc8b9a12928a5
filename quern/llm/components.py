"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import checkpointed


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return row[0], row[1]


def stars(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) edges of long nodes -> (node, root): every node with edges but the roots, root being the smallest node of its component.

    Alternates the large-star and small-star steps, which keep components and shorten paths until each component
    is one star; that takes a number of rounds logarithmic in the longest path. A step sends as many rows as there
    are edges, whatever a node's degree. Least neighbours are aggregated with a map-side combine and written before
    they are joined, so the edges of a node of very many are a join's skewed side straight from an exchange, which
    adaptive execution splits. Every step is checkpointed. No edges give no rows.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = _mark(now)
    for _ in range(rounds):
        if mark[0] == 0:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        large = checkpointed(large)
        # Each (a, b) of the large step has b < a.
        least = checkpointed(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        now = checkpointed(small)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
