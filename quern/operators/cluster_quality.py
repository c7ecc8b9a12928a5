"""Quality of clusters of named vectors: cohesion, diameter, silhouette, names and a composite score.

Means over pairs come from sums of unit vectors, so no pair is formed for them. Extremes over pairs need every pair:
they are taken tile by tile, and only one number a tile is sent on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import naming
from quern.operators import vectors as vec

#: Weights of a name's signals, the gain in frequency that may overrule the nearest name, and limits of flags.
NAME_WEIGHTS = {"similarity": 0.30, "frequency": 0.15, "head": 0.20, "containment": 0.25, "brevity": 0.10}
LEAST_GAIN = 3.0
LOW_COHESION, POOR_CANONICAL, LARGE_DIAMETER = 0.5, 0.6, 0.8
#: Weights of the composite score; they are divided by their sum.
SCORE_WEIGHTS = {
    "cohesion": 0.20, "separation": 0.10, "dunn": 0.10, "silhouette": 0.10, "size_balance": 0.05, "no_outliers": 0.05,
    "representativeness": 0.20, "generality": 0.10, "uniqueness": 0.05, "centroid_method": 0.05, "frequency": 0.10,
}
#: Members of a cluster, in name order, whose mean representativeness a canonical name is held against.
BASELINE = 10


def extremes(points: DataFrame, by: str, row_id: str, vector: str, tile: int = 1024) -> DataFrame:
    """(by, least, most): the lowest and highest cosine between two different rows of a group; null for singletons.

    Rows are dealt to tiles of about ``tile`` rows; each pair of tiles of a group is one matrix product in its own task.
    """
    tiles = points.groupBy(by).agg(F.ceil(F.count("*") / tile).alias("_tiles"))
    dealt = points.select(by, F.col(row_id).alias("_id"), F.col(vector).alias("_v")).join(tiles, by)
    dealt = dealt.withColumn("_t", F.pmod(F.xxhash64("_id"), F.col("_tiles")))
    pair = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_tiles") - 1), lambda j: F.struct(F.least("_t", j).alias("i"), F.greatest("_t", j).alias("j")))
    sent = dealt.select(by, "_t", "_v", F.explode(pair).alias("_p")).select(by, "_t", "_v", "_p.i", "_p.j")

    def product(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = rows["i"].iloc[0], rows["j"].iloc[0]
        left = vec._units(rows["_v"][rows["_t"] == i].tolist(), len(rows["_v"].iloc[0]))
        right = vec._units(rows["_v"][rows["_t"] == j].tolist(), left.shape[1])
        sim = left @ right.T
        if i == j:
            sim = sim[~np.eye(len(sim), dtype=bool)]
        found = (float(sim.min()), float(sim.max())) if sim.size else (None, None)
        return pd.DataFrame({by: rows[by].iloc[:1], "least": [found[0]], "most": [found[1]]})

    kind = points.schema[by].dataType.simpleString()
    per_tile = sent.groupBy(by, "i", "j").applyInPandas(lambda rows: product(rows), f"{by} {kind}, least double, most double")
    return per_tile.groupBy(by).agg(F.min("least").alias("least"), F.max("most").alias("most"))


def representativeness(points: DataFrame, by: str, vector: str) -> DataFrame:
    """The points with ``rep``, a row's mean cosine to all rows of its group, itself included."""
    units = points.withColumn("_u", vec.normalised(vector))
    means = vec.centroids(units, by, "_u").withColumnRenamed("centroid", "_mean")
    return units.join(means, by).withColumn("rep", vec.dot("_u", "_mean")).drop("_u", "_mean")


def silhouettes(points: DataFrame, by: str, row_id: str, vector: str, block_bytes: int = vec.BLOCK_BYTES) -> DataFrame:
    """(row_id, silhouette) under cosine distance; ``by`` and ``row_id`` are longs; singletons have 0.

    A row's mean distance to a group is one less its product with the group's mean unit vector, so rows meet one row
    a group, in blocks of groups of a checked size, and never each other.
    """
    units = points.select(F.col(by).cast("bigint").alias(by), F.col(row_id).cast("bigint").alias(row_id), vec.normalised(vector).alias("_u"))
    sizes = units.groupBy(by).agg(F.count("*").alias("n"))
    means = vec.centroids(units, by, "_u").join(sizes, by).withColumn("length", vec.norm("centroid"))
    found = None
    for ids, matrix, (n, length) in vec._blocks(means, by, "centroid", ["n", "length"], block_bytes):
        shared = points.sparkSession.sparkContext.broadcast((ids, matrix * length[:, None], n))

        def distances(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            groups, mean, size = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                u = np.array(batch.column(2).to_pylist(), dtype=np.float64).reshape(batch.num_rows, mean.shape[1])
                far = 1 - u @ mean.T
                own = batch.column(0).to_numpy()[:, None] == groups[None, :]
                inner = np.where(own, far * size / np.maximum(size - 1, 1), np.inf).min(axis=1, initial=np.inf)
                lone = (own & (size == 1)).any(axis=1)
                other = np.where(own, np.inf, far).min(axis=1, initial=np.inf)
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.where(lone, -1.0, np.maximum(inner, 0))), pa.array(other)], names=[row_id, "a", "b"])

        part = units.mapInArrow(distances, f"{row_id} bigint, a double, b double")
        found = part if found is None else found.unionByName(part)
    # Blocks without the row's own group, or with no other one, hold infinity there.
    best = found.groupBy(row_id).agg(F.min("a").alias("a"), F.min("b").alias("b"))
    return best.select(row_id, F.when((F.col("a") < 0) | (F.greatest("a", "b") <= 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("silhouette"))


def canonical_names(points: DataFrame, by: str, name: str, weight: str, vector: str) -> DataFrame:
    """(by, canonical, score, overruled): each cluster's name by five signals, from one row a (cluster, name).

    Similarity to the centroid, log frequency, how common the last word is among last words, in what share of names all
    its words occur, and brevity. Another name than the nearest one is taken only if it is at least LEAST_GAIN times as
    frequent. Ties go by the alphabet; similarities and scores are compared at nine digits.
    """
    rows = points.select(by, name, F.col(weight).cast("double").alias("f"), vector).withColumn("t", naming.plain_words(name))
    rows = rows.withColumn("head", F.try_element_at("t", F.lit(-1)))
    share = naming.containment(points, by, name)
    per_cluster = rows.groupBy(by).agg(F.count("*").alias("n"), F.max("f").alias("top"), F.max(F.size("t")).alias("longest"))
    heads = rows.groupBy(by, "head").agg(F.count("*").alias("k"))
    joined = rows.join(vec.centroids(rows, by, vector), by).join(per_cluster, by).join(share, [by, name])
    joined = joined.alias("r").join(heads.alias("h"), (F.col(f"r.{by}") == F.col(f"h.{by}")) & F.col("r.head").eqNullSafe(F.col("h.head")))
    n = F.col("n")
    signals = {
        "similarity": F.coalesce(vec.cosine(vector, "centroid"), F.lit(0.0)),
        "frequency": F.when(F.col("top") > 0, F.log1p("f") / F.log1p("top")).otherwise(0.0),
        "head": F.col("k") / n,
        "containment": (F.col("share") * (n - 1) + 1) / n,
        "brevity": 1 - (F.size("t") - 1) / F.greatest("longest", F.lit(1)),
    }
    total = sum((NAME_WEIGHTS[s] * c for s, c in signals.items()), F.lit(0.0))
    scored = joined.select(F.col(f"r.{by}").alias(by), F.col(name), "f", F.round(total, 9).alias("score"), F.round(signals["similarity"], 9).alias("sim"))
    first = lambda c: F.min(F.struct((-F.col(c)).alias("o"), name, "f", "score"))
    best = scored.groupBy(by).agg(first("score").alias("b"), first("sim").alias("p"))
    overruled = (F.col(f"b.{name}") != F.col(f"p.{name}")) & (F.col("b.f") / F.greatest("p.f", F.lit(1.0)) >= LEAST_GAIN)
    chosen = F.when(overruled, F.col("b")).otherwise(F.col("p"))
    return best.select(by, chosen[name].alias("canonical"), chosen["score"].alias("score"), overruled.alias("overruled"))


def profile(points: DataFrame, canonical: DataFrame, by: str, name: str, weight: str, vector: str) -> DataFrame:
    """(by, size, canonical, intra, diameter, representativeness, entropy, coverage, flags) of each cluster.

    ``points`` has one row a (cluster, name), ``canonical`` one a cluster. Singletons have intra 1 and diameter 0.
    """
    rep = representativeness(points, by, vector).join(canonical.select(by, F.col("canonical").alias(name)), [by, name]).select(by, F.col(name).alias("canonical"), "rep")
    wide = extremes(points, by, name, vector).select(by, F.greatest(F.lit(0.0), 1 - F.coalesce("least", F.lit(1.0))).alias("diameter"))
    total = F.sum(F.col(weight).cast("double"))
    spread = points.groupBy(by).agg(total.alias("coverage"), F.sum(F.when(F.col(weight) > 0, F.col(weight) * F.ln(F.col(weight))).otherwise(0.0)).alias("logs"))
    spread = spread.select(by, F.col("coverage").cast("bigint").alias("coverage"), F.when(F.col("coverage") > 0, F.ln("coverage") - F.col("logs") / F.col("coverage")).otherwise(0.0).alias("entropy"))
    joined = vec.cohesion(points, by, vector).join(wide, by).join(spread, by).join(rep, by, "left").withColumn("representativeness", F.coalesce("rep", F.lit(0.0)))
    flags = F.concat_ws("|", F.when(F.col("intra") < LOW_COHESION, "LOW_COHESION"), F.when(F.col("representativeness") < POOR_CANONICAL, "POOR_CANONICAL"),
                        F.when(F.col("diameter") > LARGE_DIAMETER, "LARGE_DIAMETER"), F.when(F.col("size") == 1, "SINGLETON"))
    return joined.select(by, "size", "canonical", "intra", "diameter", "representativeness", "entropy", "coverage", F.when(flags == "", "OK").otherwise(flags).alias("flags"))


def _gini(sizes: DataFrame) -> DataFrame:
    """One row (gini) of the column ``size``, from the counts of its distinct values."""
    counts = sizes.groupBy("size").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("ranks", F.col("c") * before + F.col("c") * (F.col("c") + 1) / 2)
    n, total = F.sum("c"), F.sum(F.col("size") * F.col("c"))
    return ranked.agg((2 * F.sum(F.col("ranks") * F.col("size")) / (n * total) - (n + 1) / n).alias("gini"))


def validation(points: DataFrame, canonical: DataFrame, by: str, name: str, weight: str, vector: str) -> DataFrame:
    """One row: the sub-scores of SCORE_WEIGHTS and their weighted mean ``overall``, of two or more clusters with long ids.

    ``points`` has one row a (cluster, name), ``canonical`` one a cluster.
    """
    shapes = profile(points, canonical, by, name, weight, vector)
    many = F.col("size") > 1
    basic = shapes.agg(
        F.avg(F.when(many, F.col("intra"))).alias("cohesion"), F.max("diameter").alias("diameter"), F.avg("representativeness").alias("representativeness"),
        (1 - F.count_if(many & (F.col("intra") < LOW_COHESION)) / F.count("*")).alias("no_outliers"), (F.countDistinct("canonical") / F.count("*")).alias("uniqueness"))
    middle = vec.centroids(points, by, vector).withColumn("_all", F.lit(0))
    apart = vec.cohesion(middle, "_all", "centroid").select((1 - F.col("intra")).alias("separation"))
    nearest = extremes(middle, "_all", by, "centroid").select((1 - F.col("most")).alias("nearest"))
    row = F.xxhash64(by, name)
    shape = silhouettes(points.withColumn("_row", row), by, "_row", vector).agg(((F.avg("silhouette") + 1) / 2).alias("silhouette"))

    rep = representativeness(points, by, vector).join(canonical.select(by, "canonical"), by)
    place = F.row_number().over(Window.partitionBy(by).orderBy(name))
    own = F.col(name) == F.col("canonical")
    words = F.size(naming.plain_words(name))
    per = rep.withColumn("_i", place).withColumn("_words", words).groupBy(by).agg(
        F.count("*").alias("n"), F.max(F.when(own, F.col("rep"))).alias("current"), F.avg(F.when(F.col("_i") <= BASELINE, F.col("rep"))).alias("base"),
        F.max(F.when(own, F.col("_words"))).alias("long"), F.avg("_words").alias("mean_long"), F.max(F.when(own, F.col(weight))).alias("f"), F.max(weight).alias("top"))
    gain = F.when(F.col("n") > 1, F.when(F.col("base") > 0, (F.col("current") - F.col("base")) / F.col("base")).otherwise(0.0))
    named = per.agg(
        F.avg(F.greatest(F.lit(0.0), 1 - (F.col("long") - F.col("mean_long")) / (F.col("mean_long") + 1e-10))).alias("generality"),
        F.least(F.coalesce(F.avg(gain), F.lit(0.0)) / 0.2, F.lit(1.0)).alias("centroid_method"), F.avg(F.when(F.col("top") > 0, F.col("f") / F.col("top")).otherwise(1.0)).alias("frequency"))

    one = F.lit(1).alias("_one")
    joined = basic.select("*", one)
    for other in (apart, nearest, shape, named, _gini(shapes.select("size"))):  # one row each
        joined = joined.join(other.select("*", one), "_one")
    joined = joined.withColumn("dunn", F.least(F.col("nearest") / (F.col("diameter") + 1e-10) / 0.5, F.lit(1.0))).withColumn("size_balance", 1 - F.least("gini", F.lit(1.0)))
    overall = sum((F.col(s) * w for s, w in SCORE_WEIGHTS.items()), F.lit(0.0)) / sum(SCORE_WEIGHTS.values())
    return joined.select(*SCORE_WEIGHTS, overall.alias("overall"))
