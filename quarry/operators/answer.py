"""Citations, contexts, prompts and answers for retrieved chunks, one row for each question at the end."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import text as X

HIGH, MEDIUM = 0.55, 0.40
CONTEXT_K = 5
# Texts of answers and prompts.
NOT_FOUND = "I could not find anything relevant to this question in the Confluence documentation."
DISABLED = "LLM generation is disabled (no OpenAI key configured). The most relevant sources are shown below."
FAILED = "Answer generation failed; showing retrieved sources only. "
# What a failed call is called, by the class of its exception; {…} is the exception's own value.
ERRORS = {
    "AuthenticationError": "Invalid OpenAI API Key.", "RateLimitError": "OpenAI rate limit exceeded.", "APIConnectionError": "Unable to connect to OpenAI.",
    "APIStatusError": "OpenAI Error: {status_code}",
}
RULE = "=" * 52
INSTRUCTIONS = (
    "\nYou are a Confluence Documentation Assistant.\n\nAnswer ONLY using the supplied documentation.\n\nRules:\n- Do not invent information.\n"
    "- If the answer is not present in the documentation, clearly say so.\n- Keep the answer concise and accurate.\n- Mention the source numbers you used.\n"
)


def citations(ranked: DataFrame, most: int | None = None) -> DataFrame:
    """One row for each source, index from 1, both scores to four places."""
    d = ranked if most is None else ranked.where(F.col("rank") <= most)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in d.columns else F.lit(0.0)
    similarity = F.coalesce(F.col("embedding_score"), F.col("score")) if "embedding_score" in d.columns else F.col("score")
    names = [c for c in ("chunk_id", "page_id", "title", "child_page", "parent_page", "section", "breadcrumb", "heading_path", "owner", "status", "last_reviewed", "score_breakdown", "source_url") if c in d.columns]
    return d.select(
        "qid", F.col("rank").alias("index"), *names, F.round(similarity, 4).alias("similarity"), F.round("score", 4).alias("rerank_score"),
        F.round(zero("bm25_score"), 4).alias("bm25_score"), F.round(zero("hybrid_score"), 4).alias("hybrid_score"), X.snippet(F.col("text")).alias("snippet"),
    )


def _in_order(parts: Column, by: Column, glue: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(by.alias("k"), parts.alias("v"))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), glue)


def format_inline(cited: DataFrame) -> DataFrame:
    """qid and its sources, a line each."""
    line = F.format_string("[%d] %s § %s (sim=%.2f)", F.col("index"), F.coalesce("title", F.lit("")), F.coalesce(F.nullif("section", F.lit("")), F.lit("—")), F.col("similarity"))
    return cited.groupBy("qid").agg(_in_order(line, F.col("index"), "\n").alias("sources"))


def source_block() -> Column:
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat(F.lit("\nSOURCE "), F.col("rank").cast("string"), F.lit("\n\nTitle:\n"), some("title"), F.lit("\n\nSection:\n"), some("section"), F.lit("\n\nChunk ID:\n"), some("chunk_id"), F.lit("\n\nContent:\n"), some("text"), F.lit("\n"))


def contexts(ranked: DataFrame, context_k: int = CONTEXT_K) -> DataFrame:
    """qid and the numbered blocks of its best sources; at most context_k rows are gathered for a question."""
    return ranked.where(F.col("rank") <= context_k).groupBy("qid").agg(_in_order(source_block(), F.col("rank"), "\n").alias("context"))


def prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit(f"{INSTRUCTIONS}\n{RULE}\n\nQUESTION\n\n"), question, F.lit(f"\n\n{RULE}\n\nDOCUMENTATION\n\n"), context, F.lit(f"\n\n{RULE}\n\nProvide your response in this format:\n\nAnswer:\n\nSources Used:\n"))


def confidence(similarity: Column, high: float = HIGH, medium: float = MEDIUM) -> Column:
    return F.when(similarity >= high, F.lit("HIGH")).when(similarity >= medium, F.lit("MEDIUM")).otherwise(F.lit("LOW"))


def answer_metrics(ranked: DataFrame, context_k: int = CONTEXT_K) -> DataFrame:
    """chunks_retrieved, chunks_used, top_similarity, avg_similarity, unique_pages and confidence for each question that found something."""
    used, similarity = F.col("rank") <= context_k, F.round("embedding_score", 4)
    d = ranked.groupBy("qid").agg(
        F.count(F.lit(1)).alias("chunks_retrieved"), F.count_if(used).alias("chunks_used"), F.round(F.max(F.when(used, similarity)), 4).alias("top_similarity"),
        F.round(F.avg(F.when(used, similarity)), 4).alias("avg_similarity"), F.count_distinct(F.when(used, F.col("page_id"))).alias("unique_pages"),
    )
    return d.withColumn("confidence", confidence(F.col("top_similarity")))


def score_summary(ranked: DataFrame, score: str = "score") -> DataFrame:
    """Largest, smallest, mean, median and sample deviation of each question's scores, different pages, parents and children, and a coarse confidence."""
    s = F.col(score)
    d = ranked.groupBy("qid").agg(F.max(s).alias("max_score"), F.min(s).alias("min_score"), F.avg(s).alias("avg_score"), F.median(s).alias("median_score"), F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("stdev_score"), F.count_distinct("page_id").alias("unique_pages"), *[F.count_distinct(c).alias(n) for c, n in (("parent_page", "unique_parents"), ("child_page", "unique_children")) if c in ranked.columns])
    return d.withColumn("confidence", confidence(F.col("max_score"), 0.85, 0.65))


Generator = Callable[[str], str]


def error_text(e: Exception) -> str:
    """The text of a failed call, by the nearest of its classes that has one, else the exception's own."""
    named = next((ERRORS[c.__name__] for c in type(e).__mro__ if c.__name__ in ERRORS), None)
    return str(e) if named is None else named.format(status_code=getattr(e, "status_code", ""))


def generate(prompts: DataFrame, generator: Generator | None) -> DataFrame:
    """Adds generated, error and generation_time_ms. generator: prompt to answer, called on the executors; None leaves the first two null."""
    if generator is None:
        return prompts.withColumns({"generated": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), "generation_time_ms": F.lit(0.0)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done, failed, took = [], [], []
            for p in b["prompt"]:
                began = time.perf_counter()
                try:
                    done.append(None if p is None else generator(p))
                    failed.append(None)
                except Exception as e:  # noqa: BLE001  one failing call is that row's error
                    done.append(None)
                    failed.append(error_text(e))
                took.append(0.0 if p is None else round((time.perf_counter() - began) * 1000, 2))
            yield b.assign(generated=done, error=failed, generation_time_ms=took)

    kind = T.StructType([*prompts.schema.fields, T.StructField("generated", T.StringType()), T.StructField("error", T.StringType()), T.StructField("generation_time_ms", T.DoubleType())])
    return prompts.mapInPandas(run, kind)


def answer(questions: DataFrame, ranked: DataFrame, generator: Generator | None = None, context_k: int = CONTEXT_K, retrieval_time_ms: float = 0.0) -> DataFrame:
    """One row for each question: answer, answer_generated, error, confidence, citations, metrics.

    retrieval_time_ms: what the retrieval of all questions took, if it was measured.
    """
    cited = citations(ranked, context_k)
    nested = cited.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("index", *[c for c in cited.columns if c not in ("qid", "index")]))).alias("citations"))
    d = questions.select("qid", "question").join(contexts(ranked, context_k), "qid", "left").withColumn("prompt", prompt(F.col("question"), F.col("context")))
    d = generate(d.select("qid", "question", "prompt"), generator).join(nested, "qid", "left").join(answer_metrics(ranked, context_k), "qid", "left")
    text = F.when(F.col("prompt").isNull(), F.lit(NOT_FOUND)).when(F.col("generated").isNotNull(), F.col("generated")).when(F.col("error").isNotNull(), F.concat(F.lit(FAILED + "("), F.col("error"), F.lit(")"))).otherwise(F.lit(DISABLED))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return d.select(
        "qid", "question", text.alias("answer"), F.col("generated").isNotNull().alias("answer_generated"), "error", F.coalesce("confidence", F.lit("LOW")).alias("confidence"), "citations",
        F.struct(
            *[zero(c).alias(c) for c in ("chunks_retrieved", "chunks_used", "top_similarity", "avg_similarity", "unique_pages")],
            F.lit(retrieval_time_ms).alias("retrieval_time_ms"), "generation_time_ms", F.round(F.lit(retrieval_time_ms) + F.col("generation_time_ms"), 2).alias("total_time_ms"),
        ).alias("metrics"),
    )
