"""Queries opN_<name> for the driver, each over its whole table, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import ann, chat, fim, merkle, near_dedup, ngram_lm, packing, piece_sampling, quality, sharding, substring, toxicity, url_filter
from quarry.llm.url_filter import LOWER, UPPER
from quarry.session import cut, ready

PAGE_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(key, n: int):
    return F.pmod(F.crc32(key.cast("string")), F.lit(n))


def op1_toxicity_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn=lambda key: _fold(key, 4) != 2)
    d = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return d.select("doc_id", (_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op2_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.encode(table(spark, sf_dir, "documents"), k=3, digest=True).withColumnRenamed("id", "doc_id")


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)
    return d.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op6_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), PAGE_RULES).withColumnRenamed("id", "page_id")


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cascade(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ngram_lm.score(table(spark, sf_dir, "documents"), learn=lambda key: _fold(key, 5) != 1)
    return d.select(F.col("id").alias("doc_id"), (_fold(F.col("id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sharding.plan_shards(table(spark, sf_dir, "documents"), n_shards=40)
    return d.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_prefix_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = substring.dedup(table(spark, sf_dir, "documents"))
    return d.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_merkle_coordinate_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(_fold(F.col("doc_id"), 3) == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    p = merkle.proofs(merkle.build(table(spark, sf_dir, "documents"), other={"text": tampered}))
    p = p.withColumn("folded_root", merkle.fold(F.coalesce("other", "leaf"), F.col("steps")))
    return p.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = cut(chat.formatted(chat.paths(chat.threads(rows))), "chats")
    return chat.read_back(out).withColumnRenamed("conv", "conv_id").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op13_parallel_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fim.transform(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return d.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity_string_kernel, op2_histogram_packing, op3_gumbel_segmentations, op4_order_minhash, op5_learned_partitions, op6_url_vocabulary, op7_quality_cascade, op8_deleted_interpolation, op9_external_shuffle, op10_prefix_suffix_trees, op11_merkle_coordinate_proofs, op12_reply_trees, op13_parallel_automaton)}


def oracle_sql() -> dict[str, str]:
    from quarry.llm.sql import ORACLES

    return dict(ORACLES)
