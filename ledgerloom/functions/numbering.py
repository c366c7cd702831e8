"""Running numbers without a single-task window."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 100_000


def running_number(
    df: DataFrame, order: str, within: str | None = None, name: str = "number", block: int = BLOCK,
) -> DataFrame:
    """1, 2, 3, ... by (order, within) over the whole table; `order` is a whole number.

    Rows are numbered inside blocks of `order` (each block is one bounded window) and shifted
    by the row counts of the earlier blocks, so the only global window is over block counts.
    """
    keyed = df.withColumn("_block", F.floor(F.col(order) / F.lit(block)))
    counts = keyed.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(
        "_block",
        F.coalesce(F.sum("_n").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before"),
    )
    keys = [order] + ([within] if within else [])
    inside = keyed.withColumn("_rn", F.row_number().over(W.partitionBy("_block").orderBy(*keys)))
    return inside.join(before, "_block").withColumn(
        name, F.col("_before") + F.col("_rn")).drop("_block", "_rn", "_before")


def previous_value(
    df: DataFrame, keys: list[str], order: str, value: str, name: str = "previous",
    first: str = "is_first", block: int = BLOCK,
) -> DataFrame:
    """The value of the row before, per key, where one key may hold any share of the rows.

    Windows run inside (key, block of `order`); the row that opens a block takes the last value
    of the key's previous block, found on one row per key and block.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / F.lit(block)))
    inside = W.partitionBy(*keys, "_block").orderBy(order)
    lasts = blocked.groupBy(*keys, "_block").agg(F.max_by(value, order).alias("_last"))
    carried = lasts.withColumns({
        "_carried": F.lag("_last").over(W.partitionBy(*keys).orderBy("_block")),
        "_opens": F.row_number().over(W.partitionBy(*keys).orderBy("_block")) == 1,
    }).drop("_last")
    rows = blocked.withColumns({
        "_rn": F.row_number().over(inside), "_lag": F.lag(value).over(inside)})
    return rows.join(carried, [*keys, "_block"]).withColumns({
        name: F.when(F.col("_rn") == 1, F.col("_carried")).otherwise(F.col("_lag")),
        first: (F.col("_rn") == 1) & F.col("_opens"),
    }).drop("_block", "_rn", "_lag", "_carried", "_opens")
