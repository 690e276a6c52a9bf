"""A training corpus from the table documents: toxicity, quality rules, near-duplicates, repeated passages, packing.

Each stage takes what its predecessor wrote, all of it. Stages one to three drop rows, stage four cuts passages that an
earlier document holds out of texts (a document that loses all words stays, empty), and stage five packs what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import near_dedup, packing, quality, substring, toxicity
from quarry.session import cut, ready

TOXIC_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score TOXIC_FROM or more; learns from labels of three quarters of the ids."""
    ready(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, learn=lambda key: F.pmod(F.crc32(key.cast("string")), F.lit(4)) != 2)
    return toxicity.reject(docs, model, TOXIC_FROM)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rule or the cascade rejects."""
    return quality.reject(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class."""
    ready(spark)
    return near_dedup.reject(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words in 13-word windows that a document with a smaller id holds; n_chars follows the text."""
    ready(spark)
    out = substring.dedup(docs, whole_rows=True)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset."""
    ready(spark)
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("near-duplicates", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("best-fit packing", pack_sequences),
]

#: Training, alignment and tokenising have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name.replace(" ", "-"))
    return docs
