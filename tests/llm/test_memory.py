"""What a task holds of the texts that it reads."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.llm import blocks as B


def _peak(f, *a):
    tracemalloc.start()
    try:
        out = f(*a)
        return tracemalloc.get_traced_memory()[1] / 1e6, out
    finally:
        tracemalloc.stop()


def test_a_part_holds_so_many_bytes_however_much_a_task_reads(spark, monkeypatch):
    monkeypatch.setattr(B, "BUCKET_BYTES", 20_000)
    d = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab cd "), 100).alias("text"), (F.col("id") % 10 == 0).alias("out"))
    table, size = B.write_blocks(d, block_bytes=5000)
    rows = table.select("part", "block_id", "ids", F.aggregate("texts", F.lit(0), lambda s, x: s + F.length(x)).alias("n")).collect()
    by = {p: sum(r["n"] for r in rows if r["part"] == p) for p in {r["part"] for r in rows}}
    assert size == sum(by.values()) == 240_000 and max(by.values()) <= 20_000 and len(by) == 13
    assert len({r["block_id"] for r in rows}) == len(rows) and all(r["block_id"] >> 32 == r["part"] for r in rows)
    assert sorted(i for r in rows for i in r["ids"]) == list(range(400))
    assert len(set(B.bucket_hash(np.array(list(by))) % B.bucket_count(spark, size))) > 5


def test_blocks_are_filled_over_the_edges_of_batches(spark):
    d = spark.range(0, 1000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("word " * 10).alias("text"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        held = B.write_blocks(d, block_bytes=20_000, apart=F.col("doc_id") % 10 == 0)[0].select("ids").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(len(r["ids"]) for r in held) == [100, 100, 400, 400]
    assert all(len({i % 10 == 0 for i in r["ids"]}) == 1 for r in held)


def test_words_are_hashed_from_some_bytes_at_a_time():
    texts = pa.array([f"w{i} some words of text {i % 50} and more " * 100 for i in range(1000)])
    data, offsets = B.text_bytes(texts)
    B.word_hashes(data, offsets)
    mb, (h, doc) = _peak(B.word_hashes, data, offsets)
    assert len(data) > 3_500_000 and mb < 70
    short = [B.word_hashes(*B.text_bytes(texts.slice(k, 1)))[0] for k in (0, 499, 999)]
    assert all((h[doc == k] == x).all() for k, x in zip((0, 499, 999), short, strict=True))
    long = pa.array(["a " + "b" * (2 * B.HASHED) + " a"])
    one = B.word_hashes(*B.text_bytes(long))[0]
    assert one[0] == one[2] != one[1]
