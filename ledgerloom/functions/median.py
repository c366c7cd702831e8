"""Exact medians of whole numbers from counts per value, as one-row tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Values of one block; a block is one window, and the blocks' sums are another.
BLOCK = 1 << 16


def value_counts(df: DataFrame, value: Column) -> DataFrame:
    """(v, n): how often each whole number occurs; nulls are left out."""
    return df.select(value.cast("bigint").alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))


def double_median(counts: DataFrame) -> DataFrame:
    """One row (n, med2): number of values and twice their median (null without values)."""
    blocked = counts.withColumn("b", F.floor(F.col("v") / F.lit(BLOCK)))
    sums = blocked.groupBy("b").agg(F.sum("n").alias("s"))
    before = sums.select("b", F.coalesce(F.sum("s").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
                         F.sum("s").over(W.partitionBy(F.lit(0))).alias("total"))
    upto = F.sum("n").over(W.partitionBy("b").orderBy("v")) + F.col("before")
    ranked = blocked.join(before, "b").select("v", "n", "total", upto.alias("upto"))
    lower, upper = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("v")))
    return ranked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (at(lower) + at(upper)).alias("med2"))
