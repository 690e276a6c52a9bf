"""Golden question sets: drafts from titles and sections, drafts from a text generator, and merges without duplicates."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators.numbering import numbered


# Fixed value: what a generator is asked for; {…} are the page's own values.
REQUEST = (
    "From the documentation page titled '{title}', write {n} natural questions a user might ask, each answerable ONLY from this page. "
    'Return STRICT JSON: a list of objects with keys "question" and "answer_keywords" (2-4 short keywords). Page content:\n{text}'
)


def unfenced(reply: str) -> str:
    """A reply without the lines that open and close a code fence."""
    lines = [x.removeprefix("```json").removeprefix("```").removesuffix("```") for x in reply.strip().split("\n")]
    return "\n".join(lines).strip()


def keywords(text: Column, k: int = 4) -> Column:
    """The first k different words of three characters or more that aren't stop words, as first written."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))
    good = F.filter(found, lambda t: (F.length(t) >= 3) & ~F.array_contains(F.array(*[F.lit(w) for w in X.STOP_WORDS]), F.lower(t)))
    first = F.aggregate(good, F.array().cast("array<string>"), lambda seen, t: F.when(F.array_contains(F.transform(seen, F.lower), F.lower(t)), seen).otherwise(F.array_append(seen, t)))
    return F.slice(first, 1, k)


def pages(chunks: DataFrame, most_chars: int = 4000) -> DataFrame:
    """page_id, title and the first most_chars characters of each page's text, chunks in order of vector_id, one a line.

    Every chunk takes a character at least, its line end, so no more than most_chars + 1 of them matter, however many a page
    has. They are found in salted parts of each page first, so that a page of very many chunks isn't sorted in one task; only what
    is within the limit is gathered into a row.
    """
    order = Window.partitionBy("page_id").orderBy("vector_id")
    d = chunks.select("page_id", "vector_id", "title", F.substring(F.coalesce("text", F.lit("")), 1, most_chars).alias("text"), F.pmod(F.xxhash64("vector_id"), F.lit(64)).alias("salt"))
    d = d.withColumn("place", F.row_number().over(Window.partitionBy("page_id", "salt").orderBy("vector_id"))).where(F.col("place") <= most_chars + 1)
    d = d.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most_chars + 1)
    before = F.coalesce(F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("before", before).where(F.col("before") <= most_chars)
    rows = F.array_sort(F.collect_list(F.struct("place", "text")))
    text = F.substring(F.array_join(F.transform(rows, lambda r: r["text"]), "\n"), 1, most_chars)
    return d.groupBy("page_id").agg(F.min("vector_id").alias("first"), F.min_by("title", "place").alias("title"), text.alias("text"))


def auto_bootstrap(chunks: DataFrame, per_page: int = 2) -> DataFrame:
    """id, question, relevant_page_ids, answer_keywords, tag: one question about each page and one for each of its first sections.

    Sections named document or overview are passed over. Pages come in order of their first chunk.
    """
    whole = chunks.groupBy("page_id").agg(F.min("vector_id").alias("first"), F.min_by("title", "vector_id").alias("title"))
    whole = whole.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "page_id"))
    section = F.btrim(F.coalesce("section", F.lit("")))
    parts = chunks.select("page_id", "vector_id", section.alias("section")).where(~F.lower("section").isin("", "document", "overview"))
    parts = parts.groupBy("page_id", "section").agg(F.min("vector_id").alias("at"))
    parts = parts.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("at"))).where(F.col("n") <= max(0, per_page - 1))
    about = whole.select("page_id", "first", F.lit(0).alias("n"), F.format_string("What information does the '%s' page provide?", "title").alias("question"), keywords(F.col("title")).alias("answer_keywords"))
    some = parts.join(whole, "page_id").select("page_id", "first", "n", F.format_string("What does the '%s' section of '%s' cover?", "section", "title").alias("question"), keywords(F.concat_ws(" ", "section", "title")).alias("answer_keywords"))
    d = numbered(about.unionByName(some), ["first", "n"], "number", 1)
    return d.select(F.format_string("auto%03d", "number").alias("id"), "question", F.array("page_id").alias("relevant_page_ids"), "answer_keywords", F.lit("auto").alias("tag"))


def llm_bootstrap(chunks: DataFrame, generator: Callable[[str], str] | None, per_page: int = 2, most_chars: int = 4000) -> DataFrame:
    """Questions that a generator writes about each page as a JSON list; a page with a bad reply gives none."""
    spark = chunks.sparkSession
    kind = "page_id string, items array<struct<question:string,answer_keywords:array<string>>>"

    def ask(batches):
        import pandas as pd

        for b in batches:
            out = []
            for title, text in zip(b["title"], b["text"], strict=True):
                try:
                    items = json.loads(unfenced(generator(REQUEST.format(title=title, n=per_page, text=text))))
                    out.append([{"question": str(i.get("question", "")).strip(), "answer_keywords": [str(k) for k in i.get("answer_keywords", [])]} for i in items[:per_page]])
                except Exception:  # noqa: BLE001  a page without a usable reply has no questions
                    out.append([])
            yield pd.DataFrame({"page_id": b["page_id"].astype(str), "items": out})

    if generator is None:
        return spark.createDataFrame([], "id string, question string, relevant_page_ids array<string>, answer_keywords array<string>, tag string")
    d = pages(chunks, most_chars)
    got = d.mapInPandas(ask, kind).join(d.select("page_id", "first"), "page_id").select("page_id", "first", F.posexplode("items").alias("n", "item")).where("item.question <> ''")
    return numbered(got, ["first", "n"], "number", 1).select(F.format_string("llm%03d", "number").alias("id"), "item.question", F.array("page_id").alias("relevant_page_ids"), "item.answer_keywords", F.lit("llm").alias("tag"))


def question_key(question: Column, page_ids: Column) -> list[Column]:
    return [F.lower(F.btrim(question)).alias("_q"), F.array_sort(page_ids).alias("_p")]


def approve(golden: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of new that golden lacks, by trimmed lower-case question and sorted pages; blank questions never enter.

    new needs a column pos for its order; of equal rows the first enters.
    """
    key = question_key(F.col("question"), F.col("relevant_page_ids"))
    have = golden.select(*key)
    d = new.select("*", *key).where("_q <> ''").join(have, ["_q", "_p"], "left_anti")
    first = F.row_number().over(Window.partitionBy("_q", "_p").orderBy("pos"))
    return d.withColumn("_n", first).where("_n = 1").drop("_q", "_p", "_n")


def merge(golden: DataFrame, new: DataFrame) -> DataFrame:
    return golden.unionByName(approve(golden, new).drop("pos"), allowMissingColumns=True)


def from_ask(golden: DataFrame, asked: DataFrame) -> DataFrame:
    """Feedback rows (pos, question, page_id) that golden lacks, as questions askNNN: the same question about a page it already names is one."""
    have = golden.select(F.lower(F.btrim("question")).alias("_q"), F.explode("relevant_page_ids").alias("page_id"))
    d = asked.withColumn("_q", F.lower(F.btrim("question"))).where("_q <> ''").join(have, ["_q", "page_id"], "left_anti")
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("_q", "page_id").orderBy("pos"))).where("_n = 1")
    start = golden.agg(F.count(F.lit(1)).alias("start"))
    number = F.col("number") + F.col("start")
    return numbered(d, ["pos"], "number", 1).join(start).select(F.format_string("ask%03d", number).alias("id"), "question", F.array("page_id").alias("relevant_page_ids"), keywords(F.col("question")).alias("answer_keywords"), F.lit("from_ask").alias("tag"))
