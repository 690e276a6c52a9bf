"""Re-ranking by metadata with an explained score, and retrieval on top of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import dense, hybrid, sparse
from quarry.session import cut

# What each signal can add to the base score.
BOOSTS = {"title": 0.15, "section": 0.20, "heading": 0.25, "breadcrumb": 0.05, "keyword": 0.20, "exact_phrase": 0.35, "child_page": 0.20, "owner": 0.15}


def breakdown(base: Column, question: Column) -> Column:
    """struct of the base score and eight boosts, from a chunk's columns and the question."""
    wanted = X.token_set(question)
    path = F.array_join(F.col("heading_path"), " ")
    parts = {
        "title": X.match_score(wanted, F.col("title")),
        "section": X.match_score(wanted, F.col("section")),
        "heading": X.match_score(wanted, path),
        "breadcrumb": X.match_score(wanted, F.col("breadcrumb")),
        "keyword": X.keyword_overlap(wanted, F.col("text")),
        "exact_phrase": X.phrase_score(question, F.col("text")),
        "child_page": X.phrase_score(question, F.col("child_page")),
        "owner": X.match_score(wanted, F.col("owner")),
    }
    return F.struct(base.cast("double").alias("embedding"), *[(F.lit(BOOSTS[k]) * v).alias(k) for k, v in parts.items()])


def rerank(candidates: DataFrame) -> DataFrame:
    """Adds score_breakdown, embedding_score (the score that came in), score (their sum) and the new rank."""
    d = candidates.withColumn("score_breakdown", breakdown(F.col("score"), F.col("question"))).withColumn("embedding_score", F.col("score"))
    total = F.col("score_breakdown.embedding")
    for k in BOOSTS:
        total = total + F.col(f"score_breakdown.{k}")
    d = d.withColumn("score", total)
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "rank")))


def candidates(chunks: DataFrame, questions: DataFrame, index: sparse.SparseIndex | None = None, top_k: int = 20, alpha: float = 0.5, use_hybrid: bool = True, vectors: dense.DenseIndex | None = None) -> DataFrame:
    """Chunk rows with qid, question, score, rank. chunks: vector_id, embedding and the metadata; questions: qid, question, embedding. Indexes are built where none is given."""
    if use_hybrid:
        k = hybrid.candidate_k(top_k)
        index = index or sparse.build(chunks, "vector_id", X.page_text(*[F.col(c) for c in ("title", "section", "heading_path", "breadcrumb", "text")]))
        both = hybrid.fuse(dense.search(vectors or chunks, questions, k, "vector_id"), sparse.search(index, questions, k), alpha, k)
        found = both.withColumn("score", F.col("hybrid_score"))
    else:
        found = dense.search(vectors or chunks, questions, top_k, "vector_id").select("qid", "id", F.col("score").alias("cosine_score"), "score", F.col("dense_rank").alias("rank"))
    # Written, since then its size is known: a table of candidates that is small goes to the chunks, whose texts stay where they are read.
    found, meta = cut(found.join(questions.select("qid", "question"), "qid"), "candidates"), chunks.drop("embedding")
    return found.join(meta, found["id"] == meta["vector_id"]).drop("id")


def select(ranked: DataFrame, min_score: float = 0.20) -> DataFrame:
    """Best row of each chunk id, scores of at least min_score, the cosine put back as embedding score; by score."""
    once = Window.partitionBy("qid", "chunk_id").orderBy("rank")
    d = ranked.where("chunk_id is not null").withColumn("_n", F.row_number().over(once)).where((F.col("_n") == 1) & (F.col("score") >= min_score)).drop("_n")
    if "cosine_score" in d.columns:
        d = d.withColumn("embedding_score", F.col("cosine_score")).withColumn("score_breakdown", F.col("score_breakdown").withField("embedding", F.col("cosine_score")))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "rank")))


def retrieve(chunks: DataFrame, questions: DataFrame, index: sparse.SparseIndex | None = None, top_k: int = 20, min_score: float = 0.20, alpha: float = 0.5, use_hybrid: bool = True, vectors: dense.DenseIndex | None = None) -> DataFrame:
    """Ranked chunks for every question in one job. A failing sparse side raises; there is no silent change of strategy."""
    return select(rerank(candidates(chunks, questions, index, top_k, alpha, use_hybrid, vectors)), min_score)


def retrieve_one(*args, **kwargs) -> DataFrame:
    return retrieve(*args, **kwargs).where("rank = 1")
