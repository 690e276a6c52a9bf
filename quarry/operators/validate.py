"""Quality gate for chunk tables: sizes, duplicate ids, missing fields, empty texts and numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REQUIRED = ("chunk_id", "page_id", "title", "section", "text", "word_count", "chunk_number", "total_chunks")


def checked(chunks: DataFrame) -> DataFrame:
    """Chunk rows with what they should be numbered and how many their page has."""
    page = Window.partitionBy("page_id")
    return chunks.withColumn("_n", F.row_number().over(page.orderBy("chunk_number"))).withColumn("_total", F.count(F.lit(1)).over(page))


def validate(chunks: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """One row: counts, word statistics, number of each kind of error, and PASS or FAIL."""
    d = checked(chunks)
    copies = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_ids"))
    missing = None
    for c in required:
        bad = F.col(c).isNull().cast("int")
        missing = bad if missing is None else missing + bad
    empty = F.btrim(F.coalesce("text", F.lit(""))) == ""
    wrong = ~(F.col("chunk_number").eqNullSafe(F.col("_n")) & F.col("total_chunks").eqNullSafe(F.col("_total")))
    one = d.agg(
        F.count(F.lit(1)).alias("chunks"), F.count_distinct("page_id").alias("pages"), F.round(F.avg("word_count"), 2).alias("avg_words"), F.min("word_count").alias("min_words"), F.max("word_count").alias("max_words"),
        F.coalesce(F.sum(missing), F.lit(0)).alias("missing_fields"), F.count_if(empty).alias("empty_texts"), F.count_if(wrong).alias("numbering_errors"),
    ).join(copies)
    clean = (F.col("duplicate_ids") + F.col("missing_fields") + F.col("empty_texts") + F.col("numbering_errors")) == 0
    return one.withColumn("result", F.when(clean, F.lit("PASS")).otherwise(F.lit("FAIL")))
