"""The supervision audit: conflict regimes, concept scores, sample weights and frontier analysis.

Model outputs (entailment, similarities) are columns. Undefined measures stay null, never 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the regime rule and the score formulas.
HARD_ORPHANS, SOFT_GAP, ALPHA, PENALTY, LAMBDA = 0.60, 0.25, 0.05, 0.8, 1.0


def regime(valid: Column, n_left: Column, n_right: Column, orphan_ratio: Column, gap: Column) -> Column:
    """The first rule that holds, in the order of the audit."""
    return (
        F.when(~valid, "INVALID_JSON").when((n_left == 0) | (n_right == 0), "MISSING_MODALITY").when(orphan_ratio >= HARD_ORPHANS, "HARD_CONFLICT")
        .when(gap.isNull(), "HARD_CONFLICT").when(F.abs(gap) >= SOFT_GAP, "SOFT_CONFLICT").otherwise("AGREEMENT")
    )


def orphan_ratio(n_left: Column, n_right: Column, n_matched: Column) -> Column:
    """Share of concepts of either side without a partner; null if there is no concept."""
    both = n_left + n_right
    return F.when(both > 0, (both - 2 * n_matched) / both)


def asymmetry(pairs: DataFrame, sample: str, left: str, right: str, score: str) -> DataFrame:
    """(sample, left_to_right, right_to_left, gap): mean of the best score of each concept, both ways, to 4 digits."""
    best = lambda side, name: pairs.groupBy(sample, side).agg(F.max(score).alias("m")).groupBy(sample).agg(F.round(F.avg("m"), 4).alias(name))
    both = best(left, "left_to_right").join(best(right, "right_to_left"), sample, "full_outer")
    return both.withColumn("gap", F.round(F.col("left_to_right") - F.col("right_to_left"), 4))


def coverage_score(freq: Column, top: Column) -> Column:
    return F.round(1 - F.ln(1.0 + freq) / F.ln(1.0 + top), 4)


def density_score(freq: Column, local: Column) -> Column:
    return F.round((1 - F.exp(-ALPHA * freq)) * local, 4)


def weights(regime_: Column, gap: Column, mean_grounding: Column) -> tuple[Column, Column]:
    """(positive, negative) weight of a sample by its regime."""
    positive = (
        F.when(regime_ == "AGREEMENT", 1.0).when(regime_ == "SOFT_CONFLICT", F.greatest(F.lit(0.5), 1 - LAMBDA * F.abs(gap)))
        .when(regime_ == "HARD_CONFLICT", 0.30).when(regime_ == "MISSING_MODALITY", 0.5).otherwise(0.0)
    )
    negative = F.when(regime_ == "HARD_CONFLICT", F.greatest(F.lit(0.0), 1 - F.coalesce(mean_grounding, F.lit(1.0)))).otherwise(0.0)
    return F.round(positive, 4), F.round(negative, 4)


def resolved_weight(regime_: Column, raw: Column, skipped: list[str], floor: float = 0.05) -> Column:
    """Skipped regimes weigh 0, missing weights the floor, all others stay within [floor, 1]."""
    return F.when(regime_.isin(skipped), F.lit(0.0)).otherwise(F.greatest(F.lit(floor), F.least(F.lit(1.0), F.coalesce(raw, F.lit(floor)))))


def normalise(rows: DataFrame, by: str, column: str) -> DataFrame:
    """Min-max, z-score and L2 forms within groups; degenerate groups get 0.5, 0.5 and 0."""
    w = Window.partitionBy(by)
    low, high, mean, sd = F.min(column).over(w), F.max(column).over(w), F.avg(column).over(w), F.stddev_pop(column).over(w)
    size = F.sqrt(F.sum(F.col(column) * F.col(column)).over(w))
    return rows.select(
        "*", F.when(high > low, (F.col(column) - low) / (high - low)).otherwise(0.5).alias("minmax"),
        F.when(sd > 0, (F.col(column) - mean) / sd).otherwise(0.5).alias("z"), F.when(size > 0, F.col(column) / size).otherwise(0.0).alias("l2"))


def sweep(rows: DataFrame, score: str, steps: int) -> DataFrame:
    """(tau, n, mean): rows of at least each of ``steps`` + 1 thresholds in [0, 1], and their mean score.

    Rows are counted by the highest threshold they pass; the thresholds are then cumulated over steps + 1 rows.
    """
    at = F.greatest(F.lit(0), F.least(F.lit(steps), F.floor(F.col(score) * steps))).cast("int")
    counts = rows.groupBy(at.alias("at")).agg(F.count("*").alias("k"), F.sum(score).alias("s"))
    grid = rows.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("at")).join(counts, "at", "left")
    up = Window.orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n, s = F.coalesce(F.sum("k").over(up), F.lit(0)), F.sum("s").over(up)
    return grid.select((F.col("at") / steps).alias("tau"), n.alias("n"), F.when(n > 0, s / n).alias("mean"))


def knee(points: DataFrame, x: str, y: str) -> DataFrame:
    """The point farthest from the chord of a curve, both axes scaled to [0, 1]; ties go to the smaller x."""
    w = Window.orderBy(x).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    scaled = lambda c: (F.col(c) - F.min(c).over(w)) / F.nullif(F.max(c).over(w) - F.min(c).over(w), F.lit(0.0))
    unit = points.select("*", scaled(x).alias("_x"), scaled(y).alias("_y"))
    x0, x1, y0, y1 = (f(c).over(w) for c in ("_x", "_y") for f in (F.first, F.last))
    off = F.abs((y1 - y0) * F.col("_x") - (x1 - x0) * F.col("_y") + x1 * y0 - y1 * x0)
    return unit.withColumn("distance", F.round(off, 9)).drop("_x", "_y").orderBy(F.desc("distance"), x).limit(1)
