"""Row numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import cut


def numbered(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Adds name: the row's place by the order columns.

    Rows are sorted by ranges and written; each range then starts at the number of rows in the ranges before it. What one task
    sees of the whole table is a count for each range.
    """
    d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    d = cut(d, "numbered")
    base = d.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select("_p", "_first", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + start).alias("_start"))
    return d.join(base, "_p").withColumn(name, (F.col("_start") + F.col("_i") - F.col("_first")).cast("long")).drop("_p", "_i", "_start", "_first")
