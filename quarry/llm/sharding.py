"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters whole records uniformly into memory-sized buckets by a seeded hash. Pass two runs a seeded
Fisher-Yates shuffle (Spark's ``shuffle``) inside each bucket and writes its records, all columns of them. The
written buckets in order are one global random order; dealing it out round robin gives every shard the same
number of records, at most one apart, and a gapless slot. Sizes and checksums are those of the written texts.

Defined cases: null or empty text has 0 bytes and checksum 0; a null id is an ordinary value; identical rows
are counted before the scatter and dealt out as separate records, so copies, hot keys and hot sources spread
over all buckets; an empty table gives an empty result; other columns travel with their record whatever their
names, but a map among them is refused, as it has no order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.numbering import numbered
from quarry.session import cut

RECORD_BYTES = 16


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(RECORD_BYTES)


def text_crc32(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def deal(docs: DataFrame, n_shards: int, seed: int, bucket_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """Whole records (_record) with _copy (1 for the first of identical ones), shard and slot, from the buckets that pass two wrote.

    bucket_bytes bounds what pass two holds of a bucket; the number of buckets follows the input's size.
    """
    spark = docs.sparkSession
    keys = ["_id", "_size", "_crc"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_record"), F.col(id_col).alias("_id"), text_size(F.col(text_col)).alias("_size"), text_crc32(F.col(text_col)).alias("_crc"))
    counted = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "shard-records")
    total = counted.agg(F.sum(F.col("_size") * F.col("_n"))).first()[0] or 0
    buckets = max(math.ceil(total / bucket_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    several = cut(counted.where("_n > 1").select(*[F.col(c).alias(f"{c}_several") for c in keys]), "shard-several")
    scattered = rows.withColumn("_copy", F.lit(1))
    if not several.isEmpty():
        same = lambda to: F.col("_id").eqNullSafe(F.col(f"_id{to}")) & (F.col("_size") == F.col(f"_size{to}")) & (F.col("_crc") == F.col(f"_crc{to}"))
        # Equal records take their copy numbers from ranges that also split within a key, so that many copies are many tasks.
        copies = rows.join(several, same("_several"), "left_semi").withColumn("_salt", F.monotonically_increasing_id())
        copies = cut(numbered(copies, [*keys, "_salt"], "_at"), "shard-copies")
        first = copies.groupBy(*[F.col(c).alias(f"{c}_first") for c in keys]).agg(F.min("_at").alias("_first"))
        copies = copies.join(first, same("_first")).select("_record", *keys, (F.col("_at") - F.col("_first") + 1).cast("int").alias("_copy"))
        scattered = scattered.join(several, same("_several"), "left_anti").unionByName(copies)
    scattered = scattered.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), *keys, "_copy"), F.lit(buckets)))
    held = (
        scattered.repartition(min(buckets, 20_000), "_bucket")
        .groupBy("_bucket")
        .agg(F.sort_array(F.collect_list(F.struct(*keys, "_copy", "_record"))).alias("_held"))
        .sortWithinPartitions("_bucket")
    )
    shuffled = held.select("_bucket", F.shuffle("_held", F.lit(seed)).alias("_held")).select("_bucket", F.posexplode("_held").alias("_pos", "_r"))
    written = cut(shuffled.select("_bucket", "_pos", "_r._copy", "_r._record"), "shard-buckets")
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = written.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_start"))
    at = F.col("_start") + F.col("_pos")
    return written.join(F.broadcast(starts), "_bucket").select("_record", "_copy", F.pmod(at, F.lit(n_shards)).cast("int").alias("shard"), F.floor(at / F.lit(n_shards)).cast("long").alias("slot"))


def _plan(dealt: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col("_record")[text_col]
    return dealt.select(F.col("_record")[id_col].alias("id"), text_size(text).alias("size"), text_crc32(text).alias("text_crc32"), F.col("_copy").alias("copy"), "shard", "slot")


def plan_shards(docs: DataFrame, n_shards: int = 40, seed: int = 7, bucket_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each record as it was written: id, size, text_crc32, copy, shard, slot."""
    return _plan(deal(docs, n_shards, seed, bucket_bytes, id_col, text_col), id_col, text_col)


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, seed: int = 7, bucket_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes whole records to path/shard=N in slot order and returns the plan that was followed."""
    dealt = deal(docs, n_shards, seed, bucket_bytes, id_col, text_col)
    dealt.select("shard", "slot", F.col("_record").alias("record")).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return _plan(dealt, id_col, text_col)
