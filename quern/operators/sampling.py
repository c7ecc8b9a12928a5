"""Deterministic splits and samplers: rows are ordered by a hash of their id, never by a random number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: str, salt: str) -> Column:
    """A pseudo-random order of rows that is the same on every run and engine."""
    return F.md5(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")))


def stratified_split(rows: DataFrame, key: str, stratum: str, share: float, salt: str = "split") -> DataFrame:
    """Adds split: ``val`` for round(n * share) rows of each stratum. Strata of one row are dropped."""
    w = Window.partitionBy(stratum)
    ranked = rows.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy(draw(key, salt), key)))
    return ranked.where("_n > 1").withColumn("split", F.when(F.col("_i") <= F.round(F.col("_n") * share), "val").otherwise("train")).drop("_n", "_i")


def multilabel_split(items: DataFrame, key: str, label: str, share: float, least: int, salt: str = "multi") -> DataFrame:
    """(key, stratum, split) of rows with several labels (one item a label), stratified by each row's rarest label.

    Labels with fewer than ceil(least / share) rows go first, then rows without labels.
    """
    import math

    counts = items.groupBy(label).agg(F.count("*").alias("_f")).where(F.col("_f") >= math.ceil(least / share))
    rare = items.join(counts, label).groupBy(key).agg(F.min_by(label, F.struct("_f", label)).alias("stratum"))
    return stratified_split(rare, key, "stratum", share, salt)


def tier_sample(rows: DataFrame, key: str, label: str, head: int, tail: int, size: int, salt: str = "tier") -> DataFrame:
    """``size`` rows of each tier of their label's frequency: over ``head``, under ``tail``, between."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_f"))
    tier = F.when(F.col("_f") > head, "head").when(F.col("_f") < tail, "tail").otherwise("torso")
    tiered = rows.join(counts, label).withColumn("tier", tier).drop("_f")
    i = F.row_number().over(Window.partitionBy("tier").orderBy(draw(key, salt), key))
    return tiered.withColumn("_i", i).where(F.col("_i") <= size).drop("_i")


def long_tail(rows: DataFrame, key: str, rank: str, top: int, factor: float, least: int) -> DataFrame:
    """Keeps the first max(least, top * factor ** rank) rows of each class, by key."""
    keep = F.greatest(F.lit(least), F.floor(F.lit(float(top)) * F.pow(F.lit(factor), F.col(rank))))
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy(rank).orderBy(key))).where(F.col("_i") <= keep).drop("_i")


def sample(rows: DataFrame, key: str, n: int, salt: str = "sample") -> DataFrame:
    """``n`` rows in pseudo-random order."""
    return rows.orderBy(draw(key, salt), key).limit(n)
