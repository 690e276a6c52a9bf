"""Ranked-retrieval metrics for whole question sets in one job, and the comparison of two retrievers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K_VALUES = (1, 3, 5)
CONTEXT_CHUNKS = 5
# The metrics of a report and of a comparison, in order.
REPORTED = ("precision_at_3", "precision_at_5", "recall_at_3", "recall_at_5", "hit_at_1", "hit_at_3", "hit_at_5", "mrr", "map", "context_sufficiency")
COMPARED = ("precision_at_3", "precision_at_5", "recall_at_5", "hit_at_1", "hit_at_3", "mrr", "map", "context_sufficiency")


def pages_in_order(ranked: DataFrame) -> DataFrame:
    """qid, page_id, rank: each page once, at the place of its best chunk."""
    best = ranked.groupBy("qid", "page_id").agg(F.min("rank").alias("first"))
    return best.select("qid", "page_id", F.row_number().over(Window.partitionBy("qid").orderBy("first")).alias("rank"))


def per_question(pages: DataFrame, relevant: DataFrame, questions: DataFrame, ks: tuple[int, ...] = K_VALUES) -> DataFrame:
    """precision, recall and hit at each k, mrr and map of every question. relevant: qid, page_id.

    Precision divides by what was returned if that is fewer than k; without relevant or returned pages everything is 0.
    """
    right = relevant.select("qid", "page_id").distinct()
    wanted = right.groupBy("qid").agg(F.count(F.lit(1)).alias("n_relevant"))
    d = pages.join(right.withColumn("hit", F.lit(1)), ["qid", "page_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    so_far = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("hits", F.sum("hit").over(so_far))
    top = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0))
    agg = [top(k).alias(f"_top{k}") for k in ks] + [F.count(F.lit(1)).alias("_n"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("_first"), F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank"))).alias("_ap")]
    d = questions.select("qid").join(d.groupBy("qid").agg(*agg), "qid", "left").join(wanted, "qid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    cols = []
    for k in ks:
        cols += [zero(F.col(f"_top{k}") / F.least(F.lit(k), F.col("_n"))).alias(f"precision_at_{k}"), zero(F.col(f"_top{k}") / F.col("n_relevant")).alias(f"recall_at_{k}"), zero(F.when(F.col(f"_top{k}") > 0, 1.0)).alias(f"hit_at_{k}")]
    return d.select("qid", *cols, zero(1 / F.col("_first")).alias("mrr"), zero(F.col("_ap") / F.col("n_relevant")).alias("map"))


def sufficiency(blob: Column, keywords: Column) -> Column:
    """Share of the keywords that stand in the context, whatever their case; 0 without keywords."""
    low = F.lower(F.coalesce(blob, F.lit("")))
    found = F.size(F.filter(keywords, lambda k: F.contains(low, F.lower(k))))
    return F.when(F.size(keywords) > 0, found / F.size(keywords)).otherwise(F.lit(0.0))


def context_sufficiency(ranked: DataFrame, questions: DataFrame, chunks: int = CONTEXT_CHUNKS) -> DataFrame:
    """qid, context_sufficiency over the texts of the best chunks. questions: qid, answer_keywords."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "text")))
    blob = ranked.where(F.col("rank") <= chunks).groupBy("qid").agg(F.array_join(F.transform(rows, lambda r: F.coalesce(r["text"], F.lit(""))), " \n ").alias("blob"))
    return questions.join(blob, "qid", "left").select("qid", sufficiency(F.col("blob"), F.col("answer_keywords")).alias("context_sufficiency"))


def holding(texts: DataFrame, passages: DataFrame, width: int = 5) -> DataFrame:
    """qid, page_id of every text that holds the whole passage. texts: page_id, text; passages: qid, passage.

    A text that holds a passage holds the words inside it, all but the first and last, so both sides meet on the passage's
    first run of that many inner words; contains() then decides. Passages with fewer inner words are compared with every text.
    """
    words = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"\s+"), lambda w: w != "")
    p = passages.where("passage is not null").withColumn("_w", words("passage"))
    # Words are hashed once; a run is known by its words' hashes.
    long = p.where(F.size("_w") >= width + 2).withColumn("_key", F.xxhash64(F.transform(F.slice("_w", 2, width), lambda w: F.xxhash64(w))))
    short = p.where((F.size("_w") < width + 2) & (F.col("passage") != ""))
    each = texts.select("page_id", "text", F.transform(words("text"), lambda w: F.xxhash64(w)).alias("_w")).withColumn("_n", F.size("_w"))
    runs = F.when(F.col("_n") >= width, F.transform(F.sequence(F.lit(1), F.col("_n") - (width - 1)), lambda i: F.xxhash64(F.slice("_w", i, width)))).otherwise(F.array().cast("array<bigint>"))
    keyed = each.select("page_id", F.explode(F.array_distinct(runs)).alias("_key"))
    pairs = keyed.join(long.select("qid", "_key"), "_key").select("page_id", "qid").distinct()
    found = pairs.join(texts, "page_id").join(long.select("qid", "passage"), "qid").where(F.contains("text", F.col("passage"))).select("qid", "page_id")
    if not short.isEmpty():
        found = found.unionByName(texts.join(short, F.contains("text", F.col("passage"))).select("qid", "page_id"))
    return found


def evaluate(ranked: DataFrame, questions: DataFrame, ks: tuple[int, ...] = K_VALUES) -> DataFrame:
    """Every metric for every question. questions: qid, relevant_page_ids, answer_keywords; ids need not be unique, qid is."""
    relevant = questions.select("qid", F.explode("relevant_page_ids").alias("page_id"))
    return per_question(pages_in_order(ranked), relevant, questions, ks).join(context_sufficiency(ranked, questions), "qid")


def metric_names(ks: tuple[int, ...] = K_VALUES) -> list[str]:
    return [f"{m}_at_{k}" for k in ks for m in ("precision", "recall", "hit")] + ["mrr", "map"]


def aggregate(per: DataFrame) -> DataFrame:
    """One row: the number of questions and the mean of each metric to four places."""
    names = [c for c in per.columns if c != "qid"]
    return per.agg(F.count(F.lit(1)).alias("num_questions"), *[F.round(F.avg(c), 4).alias(c) for c in names])


def long_form(aggregated: DataFrame) -> DataFrame:
    names = [c for c in aggregated.columns if c != "num_questions"]
    return aggregated.unpivot([], names, "metric", "value")


def compare(dense: DataFrame, hybrid: DataFrame) -> DataFrame:
    """metric, dense, hybrid, delta of two per-question results."""
    d, h = (long_form(aggregate(x)) for x in (dense, hybrid))
    both = d.withColumnRenamed("value", "dense").join(h.withColumnRenamed("value", "hybrid"), "metric", "full_outer")
    return both.select("metric", "dense", "hybrid", F.round(F.col("hybrid") - F.col("dense"), 4).alias("delta"))


def compare_questions(dense: DataFrame, hybrid: DataFrame, names: tuple[str, ...] = ("hit_at_1", "mrr")) -> DataFrame:
    """The chosen metrics of both sides for each question of the second; absent in the first: null."""
    a = dense.select("qid", *[F.col(n).alias(f"dense_{n}") for n in names])
    return hybrid.select("qid", *[F.col(n).alias(f"hybrid_{n}") for n in names]).join(a, "qid", "left")


def by_k(aggregated: DataFrame, ks: tuple[int, ...] = K_VALUES) -> DataFrame:
    """k, precision, recall, hit: the aggregate with a row for each k."""
    rows = [aggregated.select(F.lit(k).alias("k"), *[F.col(f"{m}_at_{k}").alias(m) for m in ("precision", "recall", "hit")]) for k in ks]
    return reduce(DataFrame.unionByName, rows)


def report(aggregated: DataFrame, seconds: float | None = None) -> str:
    """The aggregate as lines, for a console: headline metrics in a fixed order, those that are there."""
    row = aggregated.first().asDict()
    lines = ["=" * 60, "RETRIEVAL EVALUATION", "=" * 60, f"Questions evaluated : {row['num_questions']}"]
    lines += [f"Eval time           : {seconds}s"] if seconds is not None else []
    return "\n".join([*lines, "-" * 60, *(f"{_label(m).upper():14s}: {row[m]:.4f}" for m in REPORTED if row.get(m) is not None), "=" * 60])


def comparison_report(compared: DataFrame, alpha: float, questions: int) -> str:
    """The comparison as lines, with an arrow for each metric that moved."""
    rows = {r["metric"]: r for r in compared.collect()}  # one row for each metric
    value = lambda m, side: rows[m][side] or 0.0
    arrow = lambda d: "  ▲" if d > 1e-6 else "  ▼" if d < -1e-6 else "   "
    lines = ["=" * 64, f"DENSE vs HYBRID  (alpha={alpha}, {questions} questions)", "=" * 64, f"{'metric':22s} {'dense':>8s} {'hybrid':>8s} {'delta':>8s}", "-" * 64]
    for m in (m for m in COMPARED if m in rows):
        moved = value(m, "hybrid") - value(m, "dense")
        lines.append(f"{_label(m, 'ap').lower():22s} {value(m, 'dense'):8.3f} {value(m, 'hybrid'):8.3f} {moved:+8.3f}{arrow(moved)}")
    return "\n".join([*lines, "=" * 64])


def _label(metric: str, mean_precision: str = "MAP") -> str:
    if metric == "map":
        return mean_precision
    return "CTX_SUFF@5" if metric == "context_sufficiency" and mean_precision == "MAP" else "context_sufficiency@5" if metric == "context_sufficiency" else metric.replace("_at_", "@")
