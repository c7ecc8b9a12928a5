"""Choosing and comparing label names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_core(labels: DataFrame, cluster: str, label: str) -> DataFrame:
    """(cluster, n, core, hypernym, head) over a cluster's distinct labels.

    The core is the words that at least max(2, half) of the labels have, in the order of the label with the most words;
    null without any. The hypernym is the core, unless that is just the longest label. The head is the most frequent
    last word. Ties go by the alphabet.
    """
    distinct = labels.select(cluster, F.lower(label).alias("l")).distinct().withColumn("t", F.filter(F.split("l", r"\s+"), lambda w: w != ""))
    per_word = distinct.select(cluster, F.explode(F.array_distinct("t")).alias("w")).groupBy(cluster, "w").agg(F.count("*").alias("k"))
    per_head = distinct.select(cluster, F.element_at("t", -1).alias("h")).groupBy(cluster, "h").agg(F.count("*").alias("k"))
    heads = per_head.groupBy(cluster).agg(F.min(F.struct(-F.col("k"), "h"))["h"].alias("head"))
    sizes = distinct.groupBy(cluster).agg(F.count("*").alias("n"), F.min(F.struct(-F.size("t"), "l", "t"))["t"].alias("anchor"), F.min(F.struct(-F.length("l"), "l"))["l"].alias("longest"))
    shared = per_word.join(sizes.select(cluster, "n"), cluster).where(F.col("k") >= F.greatest(F.lit(2), F.ceil(F.col("n") / 2))).groupBy(cluster).agg(F.collect_list("w").alias("shared"))
    joined = sizes.join(heads, cluster).join(shared, cluster, "left")
    core = F.array_join(F.filter("anchor", lambda w: F.array_contains("shared", w)), " ")
    core = joined.withColumn("core", F.when(F.col("shared").isNotNull() & (core != ""), core))
    return core.select(cluster, "n", "core", F.when(F.col("core") != F.col("longest"), F.col("core")).alias("hypernym"), "head")


def plain_words(label: str):
    """Array of a label's words, lower-cased and without punctuation at their ends."""
    stripped = F.transform(F.split(F.lower(label), r"\s+"), lambda w: F.regexp_replace(w, r"[.,;:!?]+$", ""))
    return F.filter(stripped, lambda w: w != "")


def containment(labels: DataFrame, cluster: str, label: str) -> DataFrame:
    """(cluster, label, share): in what share of the other labels of its cluster all words of a label occur.

    A label meets only the labels that have its rarest word of the cluster, and those are compared whole. A label
    without words has share 0.
    """
    words = labels.select(cluster, label).distinct().withColumn("_t", F.array_distinct(plain_words(label)))
    each = words.select(cluster, label, "_t", F.explode("_t").alias("w"))
    per_word = each.groupBy(cluster, "w").agg(F.count("*").alias("_n"))
    rarest = each.join(per_word, [cluster, "w"]).groupBy(cluster, label).agg(F.min(F.struct("_n", "w"))["w"].alias("w"), F.first("_t").alias("_own"))
    other = each.select(cluster, "w", F.col(label).alias("_other"), "_t")
    hits = rarest.join(other, [cluster, "w"]).where((F.col(label) != F.col("_other")) & (F.size(F.array_except("_own", "_t")) == 0))
    whole = hits.groupBy(cluster, label).agg(F.count("*").alias("k"))
    counts = words.groupBy(cluster).agg(F.count("*").alias("n"))
    joined = words.select(cluster, label).join(whole, [cluster, label], "left").join(counts, cluster)
    return joined.select(cluster, label, F.when(F.col("n") > 1, F.coalesce("k", F.lit(0)) / (F.col("n") - 1)).otherwise(F.lit(0.0)).alias("share"))


def bleu(pairs: DataFrame, keys: Sequence[str], candidate: str, reference: str, order: int) -> DataFrame:
    """Corpus BLEU of token arrays with runs of one to ``order`` tokens; 0 if the runs of any size share nothing."""

    def runs(column: str) -> DataFrame:
        sized = [_runs(column, g) for g in range(1, order + 1)]
        return pairs.select(*keys, F.explode(F.concat(*sized)).alias("r")).groupBy(*keys, "r").agg(F.count("*").alias("n"))

    ours, theirs = runs(candidate), runs(reference).withColumnRenamed("n", "m")
    hits = ours.join(theirs, [*keys, "r"], "left").groupBy("r.g").agg(F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("hit"), F.sum("n").alias("total"))
    c, r = (pairs.agg(F.sum(F.size(x))).scalar() for x in (candidate, reference))
    brevity = F.when(c > r, 1.0).otherwise(F.exp(1 - r / c))
    means = hits.agg(F.avg(F.ln(F.nullif(F.col("hit"), F.lit(0)) / F.col("total"))).alias("mean"), F.count_if(F.col("hit") > 0).alias("sizes"))
    return means.select(F.when(F.col("sizes") < order, 0.0).otherwise(F.round(F.exp("mean") * brevity, 6)).alias("bleu"))


def _runs(column: str, g: int):
    """Array of (g, run) of all runs of ``g`` tokens."""
    kind = "array<struct<g:int,x:string>>"

    def run(i):
        return F.struct(F.lit(g).alias("g"), F.array_join(F.slice(F.col(column), i, g), " ").alias("x"))

    return F.when(F.size(column) >= g, F.transform(F.sequence(F.lit(1), F.size(column) - (g - 1)), run)).otherwise(F.array().cast(kind))
