"""Statistics of label frequency distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vocabulary_profile(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """Counts, entropy (base 2), normalised entropy, perplexity and Gini of ``label`` per group.

    One aggregation to (group, label), then one pass over the far smaller count table.
    """
    counts = rows.groupBy(*by, label).agg(F.count("*").alias("n"))
    group = Window.partitionBy(*by)
    ranked = counts.select(
        *by, "n",
        F.sum("n").over(group).cast("double").alias("total"),
        F.count("*").over(group).alias("uniq"),
        F.row_number().over(group.orderBy("n", label)).alias("i"),
    )
    share = F.col("n") / F.col("total")
    out = ranked.groupBy(*by).agg(
        F.max("total").cast("bigint").alias("n_rows"),
        F.max("uniq").alias("n_labels"),
        F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).cast("bigint").alias("n_singletons"),
        (-F.sum(share * F.log2(share))).alias("_h"),
        (2 * F.sum(F.col("i") * F.col("n")) / (F.max("uniq") * F.max("total"))
         - (F.max("uniq") + F.lit(1.0)) / F.max("uniq")).alias("_g"),
    )
    return out.select(
        *by, "n_rows", "n_labels", "n_singletons",
        F.round("_h", 6).alias("entropy"),
        F.round(F.when(F.col("n_labels") > 1, F.col("_h") / F.log2("n_labels")).otherwise(F.lit(0.0)), 6).alias("entropy_norm"),
        F.round(F.pow(F.lit(2.0), F.col("_h")), 4).alias("perplexity"),
        F.round("_g", 6).alias("gini"),
    )


def shares(counts: DataFrame, by: list[str]) -> DataFrame:
    """Adds each count's share ``p`` of its group."""
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def lorenz(counts: DataFrame, by: list[str], label: str) -> DataFrame:
    """Cumulative share of labels and of uses, from the rarest label up."""
    order = Window.partitionBy(*by).orderBy("n", label)
    rows = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(*by)
    return counts.select(
        *by, label,
        (F.row_number().over(order) / F.count("*").over(every)).alias("label_share"),
        (F.sum("n").over(rows) / F.sum("n").over(every)).alias("use_share"),
    )


def power_law(counts: DataFrame, by: list[str], label: str) -> DataFrame:
    """Exponent of frequency over rank: minus the slope of ln(n) on ln(rank)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), label))
    ranked = counts.select(*by, F.ln(F.col("n").cast("double")).alias("y"), F.ln(rank.cast("double")).alias("x"))
    return ranked.groupBy(*by).agg((-F.regr_slope("y", "x")).alias("exponent"))


def imbalance(counts: DataFrame, by: list[str], label: str) -> DataFrame:
    """Largest to smallest ratio, mean, median, rare labels (under 1 % of the largest), and how many labels make 80 % of uses."""
    every = Window.partitionBy(*by)
    down = every.orderBy(F.desc("n"), label)
    ranked = counts.select(
        *by, "n", F.max("n").over(every).alias("top"), F.row_number().over(down).alias("i"),
        (F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.sum("n").over(every)).alias("cum"),
        F.count("*").over(every).alias("k"),
    )
    head = F.greatest(F.lit(20), F.ceil(F.col("k") * 0.1))
    return ranked.groupBy(*by).agg(
        (F.max("n") / F.min("n")).alias("ratio"), F.avg("n").alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"),
        F.count_if(F.col("n") < 0.01 * F.col("top")).alias("n_rare"),
        F.min(F.when(F.col("cum") >= 0.8, F.col("i"))).cast("bigint").alias("labels_for_80"),
        F.max(F.when(F.col("i") <= head, F.col("cum"))).alias("head_coverage"),
    )


def cooccurrence(items: DataFrame, key: str, label: str, top: int) -> DataFrame:
    """Pairs of the ``top`` most frequent labels: how often together, Jaccard and phi.

    ``items`` has distinct (key, label). Restricting to the most frequent labels is the operator's parameter: it
    bounds the pairs of a row by top * (top - 1) / 2.
    """
    counts = items.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(top)
    held = items.join(F.broadcast(counts), label)
    rows = held.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("label"), "n"))).alias("v"))
    first = rows.select(F.posexplode("v").alias("i", "a"), "v")
    pairs = first.select("a", F.explode(F.slice("v", F.col("i") + 2, F.size("v"))).alias("b"))
    found = pairs.groupBy(F.col("a.label").alias("a"), F.col("b.label").alias("b")).agg(F.count("*").alias("tp"), F.first("a.n").alias("na"), F.first("b.n").alias("nb"))
    total = items.select(key).distinct().agg(F.count("*").alias("total"))
    tp, na, nb, n = F.col("tp").cast("double"), F.col("na").cast("double"), F.col("nb").cast("double"), total.scalar().cast("double")
    return found.select("a", "b", "tp", (tp / (na + nb - tp)).alias("jaccard"), ((tp * n - na * nb) / F.sqrt(na * nb * (n - na) * (n - nb))).alias("phi"))


def tiers(counts: DataFrame, label: str, head_share: float = 0.8, rare_share: float = 0.2) -> DataFrame:
    """Head: the labels that make ``head_share`` of uses, and the one that crosses it. Rare: at most the ``rare_share`` percentile."""
    cut = counts.agg(F.percentile("n", F.lit(rare_share)).alias("q")).scalar()
    down = Window.orderBy(F.desc("n"), label)
    cum = F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)) / F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return counts.select(label, "n", (F.coalesce(cum, F.lit(0.0)) <= head_share).alias("head"), (F.col("n") <= cut).alias("rare"))
