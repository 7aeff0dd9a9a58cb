"""Numbers of rows within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fableguard.sources.shared import written


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """df with the number, from 1, of each row among those of its keys by order, which should tell rows apart.

    Two passes: ranges of (keys, order) are written and counted, and numbered apart; a range's rows of a group move up by what
    the ranges before it hold. So one group that holds all rows is the work of many tasks, and a group's offsets
    are as many as its ranges.
    """
    dealt = written(df.repartitionByRange(*keys, *order).withColumn("range_", F.spark_partition_id()), "ranges")
    held = dealt.groupBy(*keys, "range_").agg(F.count("*").alias("held_"))
    before = Window.partitionBy(*keys).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    moved = held.withColumn("before_", F.sum("held_").over(before)).where("before_ > 0").drop("held_")
    same: Column = F.lit(True)
    rows, up = dealt.alias("a"), moved.alias("b")
    for k in [*keys, "range_"]:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    local = F.row_number().over(Window.partitionBy(*keys, "range_").orderBy(*order)).cast("long")
    rows = dealt.withColumn("local_", local).alias("a")
    out = rows.join(up, same, "left")
    return out.select(*(F.col(f"a.{c}") for c in df.columns), (F.col("a.local_") + F.coalesce("b.before_", F.lit(0))).alias(name))
