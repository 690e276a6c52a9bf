import numpy as np
from pyspark.sql import functions as F

from quarry.llm import blocks as B


def test_parts_spread_over_buckets(spark):
    rows = spark.range(-50, 5000).select(F.col("id").cast("int").alias("v"), F.hash(F.col("id").cast("int")).alias("h")).toPandas()
    assert (B.bucket_hash(rows.v.to_numpy()) == rows.h.to_numpy()).all()
    parts = [B.part_of(t, 7) for t in range(30)]
    assert len(set(parts)) == 30 and (B.bucket_hash(np.array(parts)) % 7 == np.arange(30) % 7).all()


def test_blocks_hold_every_row_and_leave_no_table(spark, odd_docs, no_docs):
    before = {t.name for t in spark.catalog.listTables()}
    table, size = B.write_blocks(odd_docs, block_bytes=2000)
    assert sum(len(r["ids"]) for r in table.collect()) == odd_docs.count()
    assert size == sum(len((r["text"] or "").encode()) for r in odd_docs.collect())
    assert {t.name for t in spark.catalog.listTables()} == before and B.write_blocks(no_docs)[1] == 0
    told = table.select("block_id", F.lit(1).alias("x"))
    got = B.with_answers(table, told.union(told), ["x"], "answers").collect()
    assert len(got) == table.count() and all(len(r["answers"]) == 2 for r in got)
