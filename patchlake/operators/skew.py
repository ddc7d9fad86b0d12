"""Numbering of groups of any size, in two steps."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchlake.functions.frames import null_safe_join


def with_running_start(
    df: DataFrame, group: list[str], order: str, amount: str, out: str, block: int = 65536
) -> DataFrame:
    """Add the sum of `amount` over the rows of the group that come before this one.

    `order` is a whole number, unique in its group. Rows are summed by blocks of it first, so a window
    holds one block of rows, or one narrow row per block, and never a whole group.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    totals = blocked.groupBy(*group, "_block").agg(F.sum(amount).alias("_total"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*group, "_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("_start") + F.coalesce(F.sum(amount).over(inside), F.lit(0))
    return null_safe_join(blocked, starts, [*group, "_block"]).withColumn(out, upto.cast("long")).drop("_block", "_start")


def with_position(df: DataFrame, group: list[str], order: str, out: str) -> DataFrame:
    """Number the rows of each group from 0 by `order`, a whole number unique in its group."""
    return with_running_start(df.withColumn("_one", F.lit(1).cast("long")), group, order, "_one", out).drop("_one")
