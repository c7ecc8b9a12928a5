"""Retrieval metrics over ranked candidate lists.

Input rows are (query, rank, relevant) for the ranked candidates; R_q is the number of relevant items of a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def query_metrics(ranked: DataFrame, relevant: DataFrame, k: int, query: str = "q_id") -> DataFrame:
    """Per query: precision, both average precisions, recall, hit, reciprocal rank and nDCG at k.

    ap_min_rq_k divides by min(R_q, k), ap_hits_found by the hits among the k (0 without any).
    ``relevant`` has (query, r_q). Ranked rows beyond k are ignored.
    """
    order = Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rel = F.col("relevant").cast("int")
    rows = ranked.where(F.col("rank") <= k).withColumn("precision", F.sum(rel).over(order) / F.col("rank"))
    sums = rows.groupBy(query).agg(
        F.sum(rel).alias("hits"), F.sum(F.when(F.col("relevant"), F.col("precision")).otherwise(0.0)).alias("ap"),
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"), F.sum(rel / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.count("*").alias("depth"),
    ).join(relevant, query)
    r_q = F.col("r_q")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(r_q, F.lit(k))).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return sums.select(
        query, "r_q",
        (F.col("hits") / F.col("depth")).alias("precision"),
        F.when(r_q > 0, F.col("ap") / F.least(r_q, F.lit(k))).alias("ap_min_rq_k"),
        F.when(F.col("hits") > 0, F.col("ap") / F.col("hits")).otherwise(0.0).alias("ap_hits_found"),
        F.when(r_q > 0, F.col("hits") / r_q).alias("recall"),
        (F.col("hits") > 0).cast("double").alias("hit"),
        (1.0 / F.col("first")).alias("rr"),
        F.when(r_q > 0, F.col("dcg") / ideal).alias("ndcg"),
    )


def averaged(metrics: DataFrame, *by: str, digits: int = 6) -> DataFrame:
    """Means over queries, by group; nulls (queries a metric is undefined for) are left out."""
    names = ("precision", "ap_min_rq_k", "ap_hits_found", "recall", "hit", "rr", "ndcg")
    return metrics.groupBy(*by).agg(F.count("*").alias("n"), *[F.round(F.avg(n), digits).alias(n) for n in names])


def curve(scored: DataFrame, by: str, score: str, positive: Column) -> DataFrame:
    """(by, score, precision, recall, fpr) at each distinct score of a class, from the highest down."""
    counts = scored.groupBy(by, score).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    down = Window.partitionBy(by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(by)
    tp, fp = F.sum("p").over(down), F.sum("n").over(down)
    return counts.select(by, score, (tp / (tp + fp)).alias("precision"), (tp / F.nullif(F.sum("p").over(every), F.lit(0))).alias("recall"), (fp / F.nullif(F.sum("n").over(every), F.lit(0))).alias("fpr"))
