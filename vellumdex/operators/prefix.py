"""Running totals over all rows without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumdex.session import written


def running_total(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Add `name`, the sum of `value` over the rows before each in the order of `order`; 0 for the first.

    Rows are range-partitioned by `order` and written, which fixes the ranges; one total a range is summed up in
    a window of as many rows as there are ranges; inside a range a window adds the rest. `order` should tell
    rows apart, else rows that tie get their totals in any order.
    """
    ranged = df.withColumn("_value", value).repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    bases = bases.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_base") + F.coalesce(F.sum("_value").over(inside), F.lit(0))
    # one row a range: at most as many as there are shuffle partitions
    return ranged.join(F.broadcast(bases), "_range").withColumn(name, total.cast("bigint")).drop("_range", "_base", "_value")
