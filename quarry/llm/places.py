"""Places of rows within their key, for keys that may hold any share of the table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import cut


def placed(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with _place (from 0 by the order columns, within rows of an equal key; nulls first) and _n (rows of the key).

    Ranges of the sorted table go to tasks, not keys, so a key with most rows is numbered by many tasks. What is summed
    over a key is a count for each range. df is read twice (for the ranges, then for the rows), so it should be a written table.
    """
    d = df.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    d = cut(d.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "placed")
    ranges = d.groupBy("_range", *key).agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    of = Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))
    before = of.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("_range").alias("_of"), *[F.col(k).alias(f"_of_{k}") for k in key], "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"), F.sum("_rows").over(of).alias("_n"))
    held = reduce(lambda c, k: c & F.col(k).eqNullSafe(F.col(f"_of_{k}")), key, F.col("_range") == F.col("_of"))
    return d.join(ranges, held).select(*df.columns, (F.col("_start") + F.col("_at") - F.col("_first")).alias("_place"), "_n")
