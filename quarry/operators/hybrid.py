"""Fusion of dense and sparse candidates: min-max for each question and side, weighted sum, cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key(chunk_id: Column, vector_id: Column) -> Column:
    """What a candidate is known by: its chunk id, else its vector id."""
    return F.coalesce(F.nullif(chunk_id, F.lit("")), vector_id.cast("string"))


def candidate_k(top_k: int) -> int:
    return max(3 * top_k, 30)


def minmax(value: Column, by: str = "qid") -> Column:
    """Within each question; a range of nothing gives 1 for positive values, else 0."""
    w = Window.partitionBy(by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    flat = F.when(value > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(high - low <= 1e-9, flat).otherwise((value - low) / (high - low))


def fuse(dense: DataFrame, sparse: DataFrame, alpha: float = 0.5, top: int | None = None) -> DataFrame:
    """dense: qid, id, score, dense_rank; sparse: qid, id, bm25_score, sparse_rank.

    A side that lacks a document counts 0. Ties go to the better dense rank, then to the better sparse rank.
    """
    d = dense.select("qid", "id", F.col("score").alias("cosine_score"), "dense_rank", minmax(F.col("score")).alias("nd"))
    s = sparse.select("qid", "id", "bm25_score", "sparse_rank", minmax(F.col("bm25_score")).alias("ns"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    both = d.join(s, ["qid", "id"], "full_outer").select(
        "qid", "id", "dense_rank", "sparse_rank", zero("cosine_score").alias("cosine_score"), zero("bm25_score").alias("bm25_score"),
        (alpha * zero("nd") + (1 - alpha) * zero("ns")).alias("hybrid_score"),
    )
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("hybrid_score", 9)), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"))
    out = both.withColumn("rank", F.row_number().over(order))
    return out if top is None else out.where(F.col("rank") <= top)
