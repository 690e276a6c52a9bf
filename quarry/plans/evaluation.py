"""Evaluation of a collection from end to end: question sets, results, comparisons and asks, kept as JSON below its root."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import catalog, embedding, evaluate, golden, rerank, synthetic
from quarry.plans.pipeline import Ingestion
from quarry.session import cut
from quarry.sources import hierarchy, snapshots

QUESTIONS = "id string, question string, relevant_page_ids array<string>, answer_keywords array<string>, tag string"
HISTORY = "ts timestamp, ask_id long, question string, confidence string, answer_generated boolean, top_similarity double, unique_pages long, retrieved_pages array<string>, retrieved_titles array<string>"
HISTORY_MOST = 200


def compared(chunks: DataFrame, questions: DataFrame, embedder: embedding.Embedder = embedding.hashing_embedder, index=None, alpha: float = 0.5, top_k: int = 20, min_score: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Dense and hybrid results of each question. questions: qid, question, relevant_page_ids, answer_keywords."""
    asked = embedding.embed(questions, embedder, F.col("question")).select("qid", "question", "embedding")
    return tuple(evaluate.evaluate(cut(rerank.retrieve(chunks, asked, index, top_k, min_score, alpha, hybrid), "ranked"), questions) for hybrid in (False, True))


def benchmark(spark: SparkSession, services: int = 40, alpha: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Dense and hybrid results on the synthetic corpus."""
    chunks = cut(embedding.embed(synthetic.chunks(spark, services)), "benchmark")
    return compared(chunks, synthetic.questions(spark, services), alpha=alpha)


@dataclass
class Evaluation:
    """Tables golden, candidates, results, summary, comparison and history of the collection that job ingests."""

    job: Ingestion

    def path(self, name: str) -> str:
        return f"{self.job.root.rstrip('/')}/evaluation/{self.job.collection}/{name}"

    def questions(self, name: str = "golden") -> DataFrame:
        """A question set; none if it was never saved."""
        return hierarchy.read_json(self.job.spark, self.path(name), QUESTIONS)

    def save(self, questions: DataFrame, name: str) -> None:
        hierarchy.write_json(questions.select("id", "question", "relevant_page_ids", "answer_keywords", "tag"), self.path(name))

    def bootstrap(self, per_page: int = 2, generator: Callable[[str], str] | None = None) -> DataFrame:
        """Drafts questions, from titles and sections or by a generator, and saves them as candidates."""
        chunks = self.job.table("indexed")
        self.save(golden.llm_bootstrap(chunks, generator, per_page) if generator else golden.auto_bootstrap(chunks, per_page), "candidates")
        return self.questions("candidates")

    def approve(self, chosen: DataFrame | None = None) -> int:
        """Merges the chosen candidates (all of them by default) into the golden set; how many it lacked."""
        new = (self.questions("candidates") if chosen is None else chosen).withColumn("pos", F.col("id"))
        before = 0

        def merged(have: DataFrame) -> DataFrame:
            nonlocal before
            before = have.count()
            return golden.merge(have, new).select(have.columns)

        snapshots.Table(self.job.spark, self.path("golden"), QUESTIONS).update(merged)
        return self.questions().count() - before

    def _asked(self) -> DataFrame:
        return self.questions().withColumn("qid", F.xxhash64("id", "question", "relevant_page_ids"))

    def evaluate(self, top_k: int = 20, min_score: float = 0.20, use_hybrid: bool = True) -> DataFrame:
        """Writes results (a row for each question with its best pages) and summary (means); returns the summary."""
        began, q = time.perf_counter(), cut(self._asked(), "questions")
        asked = embedding.embed(q, self.job.embedder, F.col("question")).select("qid", "question", "embedding")
        ranked = cut(rerank.retrieve(self.job.table("indexed"), asked, self.job.sparse_index() if use_hybrid else None, top_k, min_score, use_hybrid=use_hybrid, vectors=self.job.dense_index()), "ranked")
        per = cut(evaluate.evaluate(ranked, q), "per")
        best = evaluate.pages_in_order(ranked).where("rank <= 5").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "page_id"))), lambda r: r["page_id"]).alias("retrieved_top5"))
        hierarchy.write_json(q.select("qid", "id", "question", "relevant_page_ids").join(best, "qid", "left").join(per, "qid"), self.path("results"))
        summary = evaluate.aggregate(per).withColumn("eval_time_s", F.lit(round(time.perf_counter() - began, 3)))
        hierarchy.write_json(summary, self.path("summary"))
        return summary

    def compare(self, alpha: float = 0.5, top_k: int = 20, min_score: float = 0.0) -> DataFrame:
        """Writes and returns metric, dense, hybrid, delta over the golden set."""
        dense, hybrid = compared(self.job.table("indexed"), cut(self._asked(), "questions"), self.job.embedder, self.job.sparse_index(), alpha, top_k, min_score)
        hierarchy.write_json(evaluate.compare(dense, hybrid), self.path("comparison"))
        return hierarchy.read_json(self.job.spark, self.path("comparison"), "metric string, dense double, hybrid double, delta double")

    def log(self, answers: DataFrame) -> DataFrame:
        """Puts answers on top of the history; returns it."""
        return self.keep(as_history(answers))

    def keep(self, asks: DataFrame) -> DataFrame:
        """The history with these rows; it keeps its newest. Rows that others add meanwhile stay."""
        snapshots.Table(self.job.spark, self.path("history"), HISTORY).update(lambda have: catalog.history_top(have.unionByName(asks), HISTORY_MOST))
        return self.history()

    def history(self) -> DataFrame:
        return hierarchy.read_json(self.job.spark, self.path("history"), HISTORY)


def as_history(answers: DataFrame) -> DataFrame:
    """A row of the ask history for each answer."""
    cited = lambda c: F.transform(F.coalesce("citations", F.array()), lambda x: x[c])
    return answers.select(F.current_timestamp().alias("ts"), F.col("qid").alias("ask_id"), "question", "confidence", "answer_generated", F.col("metrics.top_similarity").cast("double").alias("top_similarity"), F.col("metrics.unique_pages").cast("long").alias("unique_pages"), cited("page_id").alias("retrieved_pages"), cited("title").alias("retrieved_titles"))

