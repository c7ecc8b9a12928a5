"""Relational operators: keyed upserts, lookups, coverage, gates and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row a key: the first in a total order (dropDuplicates would keep an arbitrary one)."""
    ranked = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_nth = 1").drop("_nth")


def upsert(rows: DataFrame, key: str, order: str, filled: Column) -> DataFrame:
    """One row a key: the first that is ``filled``, else the first."""
    return keep_first(rows, [key], [F.when(filled, 0).otherwise(1), order])


def lookup(rows: DataFrame, column: str, mapping: DataFrame, keep_unmatched: bool = True) -> DataFrame:
    """Replace ``column`` by its value in ``mapping`` (key, value); unmatched rows stay as they are or go.

    The join strategy is left to the optimizer, which broadcasts a mapping only below its size threshold.
    """
    joined = rows.join(mapping.select(F.col("key").alias(column), F.col("value").alias("_to")), column, "left" if keep_unmatched else "inner")
    return joined.withColumn(column, F.coalesce("_to", column)).drop("_to")


def lookup_default(rows: DataFrame, key: str, table: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Left join on ``key``; columns missing for a row come from ``defaults``."""
    joined = rows.join(table, key, "left")
    return joined.select(*[F.coalesce(c, defaults[c]).alias(c) if c in defaults else F.col(c) for c in joined.columns])


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many keys match, and how many are on one side alone."""
    both = left.select(key).distinct().withColumn("_l", F.lit(1)).join(right.select(key).distinct().withColumn("_r", F.lit(1)), key, "full_outer")
    return both.agg(
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("n_both"),
        F.count_if(F.col("_r").isNull()).alias("n_left_only"),
        F.count_if(F.col("_l").isNull()).alias("n_right_only"),
    )


def first_not_null(column: str, order: str) -> Column:
    """The first non-null value of a group in the order of another column."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col(order)))


def gate(*tests: tuple[Column, str], passed: str = "keep") -> Column:
    """The reason of the first test that holds, else ``passed``."""
    chain = F.lit(passed)
    for test, reason in reversed(tests):
        chain = F.when(test, F.lit(reason)).otherwise(chain)
    return chain


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, value: str, tie: str) -> DataFrame:
    """Each left row with the latest right ``value`` at or before its time, by key; null if there is none.

    Both sides are united and sorted once by key and time; the last non-null value is carried forward.
    """
    a = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1))
    b = right.select(*by, time, F.col(value).alias("_v"), F.lit(None).cast("bigint").alias(tie), F.lit(0).alias("_side"))
    order = Window.partitionBy(*by).orderBy(time, "_side", tie)
    carried = a.unionByName(b, allowMissingColumns=True).withColumn("_v", F.last("_v", ignorenulls=True).over(order))
    return carried.where("_side = 1").drop("_side").withColumnRenamed("_v", value)
