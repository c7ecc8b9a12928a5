"""Window operators over ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(by: Sequence[str], column: str) -> Column:
    """Rank from the largest down, ties sharing their mean rank."""
    ties = Window.partitionBy(*by, column)
    return F.rank().over(Window.partitionBy(*by).orderBy(F.desc(column))) + (F.count("*").over(ties) - 1) / 2


def centred_mean(column: str, by: Sequence[str], order: Sequence[str], size: int, least: int = 3) -> Column:
    """Mean of the ``size`` rows around each row, an even window leaning back; null with fewer than ``least``."""
    rows = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(size // 2), (size - 1) // 2)
    return F.when(F.count(column).over(rows) >= least, F.avg(column).over(rows))


def trailing(by: Sequence[str], order: Sequence[str], size: int):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(-(size - 1), 0)


def ratio(a: Column, b: Column) -> Column:
    """a / b as IEEE division, for b of 0 and up: 0 / 0 is NaN and a / 0 infinite, which ANSI mode makes an error."""
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def ema(rows: DataFrame, by: str, order: str, column: str, size: int) -> DataFrame:
    """Exponential moving average of each key's values in order, seeded by the first: (by, order, ema).

    A recursion, so each key's values are folded in one array; keys are independent.
    """
    alpha = 2.0 / (size + 1)
    lists = rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).cast("double").alias("x")))).alias("v"))
    item = "array<struct<o:" + rows.schema[order].dataType.simpleString() + ",e:double>>"

    def step(done: Column, now: Column) -> Column:
        before = F.try_element_at(done, F.lit(-1))["e"]
        value = F.when(F.size(done) == 0, now["x"]).otherwise(alpha * now["x"] + (1 - alpha) * before)
        return F.concat(done, F.array(F.struct(now["o"].alias("o"), value.alias("e"))))

    folded = lists.select(by, F.explode(F.aggregate("v", F.array().cast(item), step)).alias("r"))
    return folded.select(by, F.col("r.o").alias(order), F.col("r.e").alias("ema"))


def patience(column: str, by: Sequence[str], order: Sequence[str], least_gain: float) -> tuple[Column, Column]:
    """(best so far, rows since it last improved by ``least_gain``), smaller values being better."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.min(column).over(before)
    return best, best.isNull() | (F.col(column) < best - least_gain)
