"""Each operator on the driver's tables. Documents serve as chunks, embeddings as their vectors, benchmark passages as questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import answer, catalog, dense, documents, embedding, evaluate, golden, hybrid, rerank, sparse, synthetic, validate
from quarry.plans import evaluation, pipeline, segments
from quarry.session import cut, ready, scratch_path
from quarry.sources import hierarchy, snapshots, wiki

ONE_QUESTION = "the thin edges of another winter"
FIELDS_TABLE = "<table><tr><th>Field</th><th>Value</th></tr><tr><td>Owner</td><td><b>Docs Team</b></td></tr><tr><td>Status</td><td><code>LIVE</code></td></tr><tr><td>Last-Reviewed</td><td>2026-01-0%d</td></tr><tr><td>run_book_url</td><td><a href='http://x/%d'>wiki</a></td></tr></table>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("vector_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("page_id"), F.col("source").alias("title"), F.col("lang").alias("section"), F.array("lang", "source").alias("heading_path"),
        F.concat(F.lit("Corpus > "), "source").alias("breadcrumb"), F.lit("Corpus").alias("parent_page"), F.col("source").alias("child_page"), F.concat("lang", F.lit(" team")).alias("owner"), F.lit("LIVE").alias("status"), "text",
    )


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; one without a stored vector has none and is found by its words."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vector_id"), "embedding")
    return chunks(spark, sf_dir).join(v, "vector_id", "left")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage asks, the whole of it; one without a stored vector asks by its words."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"), "text")
    return b.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), "embedding"), "qid", "left")


def page_text() -> Column:
    return X.page_text(*[F.col(c) for c in ("title", "section", "heading_path", "breadcrumb", "text")])


def bm25_index(spark: SparkSession, sf_dir: str) -> sparse.SparseIndex:
    return sparse.build(chunks(spark, sf_dir), "vector_id", page_text())


def tokenize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.word_count(F.col("text")).alias("words"), F.length("text").alias("chars"))


def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.snippet(F.col("text")).alias("snippet"))


def html_strip_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.tidy_markdown(X.drop_hidden_tags(F.col("html"))).alias("stripped"))


def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.clean_pages(table(spark, sf_dir, "pages")).select("page_id", "markdown", "error")


def normalize_field_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part")
    cell = F.concat(F.lit(" `"), "p_name", F.lit("`<br/>[x](y) [z]() ![i]() `` __"), "p_type", F.lit("__  "), "p_brand")
    return d.select("p_partkey", X.field_name(F.concat(F.lit("**"), "p_name", F.lit("** - "), "p_type")).alias("field"), X.cell_text(cell).alias("cell"))


def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_index(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spark.createDataFrame([(0, ONE_QUESTION)], "qid long, question string")
    return sparse.search(bm25_index(spark, sf_dir), q, 20).select("id", F.round("bm25_score", 6).alias("score"), F.col("sparse_rank").alias("rank"))


def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.search(bm25_index(spark, sf_dir), questions(spark, sf_dir), 30).select("qid", "id", F.round("bm25_score", 6).alias("score"), F.col("sparse_rank").alias("rank"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 7").select("embedding").first()[0]
    return dense.search_one(e, list(q)).select("id", F.round("score", 6).alias("score"))


def dense_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    d = dense.search(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding"))
    return d.select("qid", "id", F.round("score", 6).alias("score"), F.col("dense_rank").alias("rank"))


def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem")
    return d.select("l_orderkey", "l_linenumber", F.round(hybrid.minmax(F.col("l_extendedprice"), "l_orderkey"), 6).alias("norm"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    c, q = vector_chunks(spark, sf_dir), questions(spark, sf_dir)
    return c, q, cut(dense.search(c, q, 60, "vector_id"), "dense-side"), cut(sparse.search(bm25_index(spark, sf_dir), q, 60), "sparse-side")


def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, d, s = _sides(spark, sf_dir)
    return hybrid.fuse(d, s, 0.5, 60).select("qid", "id", F.round("cosine_score", 6).alias("cosine_score"), F.round("bm25_score", 6).alias("bm25_score"), F.round("hybrid_score", 6).alias("hybrid_score"), "rank")


def _search(spark: SparkSession, sf_dir: str) -> dict:
    """What retrieval takes. Texts and vectors come apart, so that no text is moved to its vector."""
    return {"chunks": chunks(spark, sf_dir), "questions": questions(spark, sf_dir).select("qid", "question", "embedding"), "index": bm25_index(spark, sf_dir), "vectors": dense.build(vector_chunks(spark, sf_dir), "vector_id")}


def _reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.rerank(rerank.candidates(**_search(spark, sf_dir)))


def rerank_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.round(f"score_breakdown.{k}", 6).alias(f"s_{k}") for k in ("embedding", *rerank.BOOSTS)]
    return _reranked(spark, sf_dir).select("qid", F.col("vector_id").alias("id"), *parts, F.round("score", 6).alias("score"), "rank")


def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.retrieve(**_search(spark, sf_dir), min_score=0.4)


def retrieve_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieved(spark, sf_dir).select("qid", "chunk_id", F.round("score", 6).alias("score"), F.round("embedding_score", 6).alias("embedding_score"), "rank")


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.citations(retrieved(spark, sf_dir), 5).select("qid", "index", "chunk_id", "page_id", "section", "similarity", "rerank_score", "bm25_score", "hybrid_score", "snippet")


def context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.contexts(retrieved(spark, sf_dir)).select("qid", F.md5("context").alias("context_md5"), F.length("context").alias("chars"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.answer(questions(spark, sf_dir), cut(retrieved(spark, sf_dir), "ranked")).select("qid", "answer", "answer_generated", "confidence", F.size(F.coalesce("citations", F.array())).alias("n_citations"))


def answer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.answer_metrics(retrieved(spark, sf_dir))


def confidence_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem")
    return d.select("l_orderkey", "l_linenumber", answer.confidence(F.col("l_discount") * 8).alias("confidence"))


def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = answer.score_summary(retrieved(spark, sf_dir))
    return d.select("qid", *[F.round(c, 5).alias(c) for c in ("max_score", "min_score", "avg_score", "median_score", "stdev_score")], "unique_pages", "unique_parents", "unique_children", "confidence")


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = catalog.diagnostics(retrieved(spark, sf_dir))
    return d.select("qid", "chunks", "pages", F.round("avg_similarity", 6).alias("avg_similarity"), F.round("min_similarity", 6).alias("min_similarity"), "bm25_matches")


def _eval(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ranked pages, relevant pages and questions of every twentieth vector against all: pages of equal labels are relevant."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding", "label")
    page = (F.col("id") % 100).cast("string").alias("page_id")
    ranked = dense.search(e, q, 40).where("id <> qid").select("qid", page, F.col("dense_rank").alias("rank"))
    # A label's pages with their numbers of rows, not its rows; a question's own row doesn't make its page relevant.
    held = e.groupBy("label", (F.col("vec_id") % 100).cast("string").alias("page_id")).agg(F.count(F.lit(1)).alias("n"))
    near = held.join(q.select("qid", "label"), "label").where(F.col("n") > (F.col("page_id") == (F.col("qid") % 100).cast("string")).cast("int"))
    return evaluate.pages_in_order(ranked), near.select("qid", "page_id"), q.select("qid")


def dedup_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _eval(spark, sf_dir)[0]


def precision_recall_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = evaluate.per_question(*_eval(spark, sf_dir))
    return d.select("qid", *[F.round(c, 6).alias(c) for c in evaluate.metric_names() if "_at_" in c])


def mrr_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.per_question(*_eval(spark, sf_dir)).select("qid", F.round("mrr", 6).alias("mrr"), F.round("map", 6).alias("map"))


def eval_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.aggregate(evaluate.per_question(*_eval(spark, sf_dir)))


def context_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir).select("qid", golden.keywords(F.col("question")).alias("answer_keywords"))
    return evaluate.context_sufficiency(retrieved(spark, sf_dir), q).select("qid", F.round("context_sufficiency", 6).alias("context_sufficiency"))


def compare_dense_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, q, d, s = _sides(spark, sf_dir)
    relevant = cut(evaluate.holding(c.select(F.col("vector_id").cast("string").alias("page_id"), "text"), q.select("qid", F.col("text").alias("passage"))), "relevant")
    pages = lambda x, r: x.select("qid", F.col("id").cast("string").alias("page_id"), F.col(r).alias("rank"))
    per = [evaluate.per_question(p, relevant, q.select("qid")) for p in (pages(d.where("dense_rank <= 20"), "dense_rank"), pages(hybrid.fuse(d, s, 0.5, 60), "rank"))]
    return evaluate.compare(*per)


def auto_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.auto_bootstrap(chunks(spark, sf_dir), 3).select("id", "question", F.array_join("relevant_page_ids", ",").alias("pages"), F.array_join("answer_keywords", ",").alias("keywords"), "tag")


def golden_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    row = turns.select(F.struct("conv_id", "turn").alias("pos"), F.concat("text", F.lit("  ")).alias("question"), F.array(F.lit("b"), (F.col("conv_id") % 7).cast("string")).alias("relevant_page_ids"))
    have = turns.where("conv_id % 3 = 0").select("text", "conv_id").select(F.concat(F.lit("  "), "text").alias("question"), F.array((F.col("conv_id") % 7).cast("string"), F.lit("b")).alias("relevant_page_ids"))
    return golden.approve(have, row).select("pos.conv_id", "pos.turn")


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("page_id"), "text")
    return documents.chunk_pages(d, "text")


def chunk_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "conversations")
    c = d.select(
        F.concat("conv_id", F.lit("_"), F.col("turn") % 6).alias("chunk_id"), F.col("conv_id").cast("string").alias("page_id"), F.col("role").alias("title"), F.col("role").alias("section"), "text", X.word_count(F.col("text")).alias("word_count"),
        (F.col("turn") + 1).alias("chunk_number"), F.when(F.col("conv_id") % 10 != 0, F.max("turn").over(_by("conv_id")) + 1).alias("total_chunks"),
    )
    return validate.validate(c)


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def md_line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text")
    listed = d.select("page_id", F.concat(F.lit("| a |\n"), F.replace("text", F.lit(", "), F.lit("\n- "))).alias("text"))
    return documents.line_spans(listed, lambda s: documents.is_table_line(s) | documents.is_list_line(s), "text")


def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.page_summary(chunks(spark, sf_dir))


def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.corpus_counts(chunks(spark, sf_dir))


def page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("page_id"), F.col("r_name").alias("title"), F.lit("root").alias("parent_id"), F.col("r_regionkey").alias("ord"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("page_id"), F.col("n_name").alias("title"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_nationkey").alias("ord"))
    root = spark.createDataFrame([("root", "World", None, 0)], "page_id string, title string, parent_id string, ord int")
    return hierarchy.page_tree(root.unionByName(r).unionByName(n)).select("page_id", "title", "parent_id", "level", "path")


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    api, title, key = "https://wiki.example/w/api.php", F.col("p_name"), F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", wiki.page_url_column("https://wiki.example/w/", api, title, key).alias("url"), wiki.page_url_column("", api, title, key).alias("api_url"))


def field_value_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("page_id"), F.concat(F.format_string(FIELDS_TABLE, F.col("page_id") % 7, F.col("page_id")), F.coalesce("html", F.lit(""))).alias("html"))
    m = documents.with_metadata(documents.clean_pages(d))
    return m.select("page_id", "title", "breadcrumb", "owner", "status", "last_reviewed", F.col("custom_fields")["runbookurl"].alias("runbook"), F.size("headings").alias("n_headings"), "word_count", "character_count")


def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("vector_id", F.md5(embedding.embedding_text(["parent_page", "child_page", "title", "breadcrumb", "section", "owner", "status", "text"])).alias("text_md5"))


def embed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = embedding.embed(chunks(spark, sf_dir))
    return d.select("vector_id", F.size("embedding").alias("dims"), F.round(F.sqrt(dense.inner_product(F.col("embedding"), F.col("embedding"))), 4).alias("norm"))


def ask_history_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select(F.col("event_id").alias("ask_id"), "ts", "event_type", "user_id")
    return catalog.history_top(d).select("ask_id", "event_type", "user_id")


def collection_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    names = nation.select(F.col("n_name").alias("name")).unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))).withColumn("title", F.lit("x"))
    held = lambda t, key: table(spark, sf_dir, t).join(nation, F.col(key) == F.col("n_nationkey")).select(F.col("n_name").alias("name"))
    return catalog.listed(names, held("customer", "c_nationkey"), held("supplier", "s_nationkey")).select("name", "has_index", "has_golden")


def tree_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.tree_lines(page_tree(spark, sf_dir))


def api_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = lambda n: F.when(F.col("p_size") % 3 != n, F.concat("p_brand", F.lit(f" {n}"))).otherwise(F.lit(""))
    page = F.struct(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.struct(F.col("p_size").alias("number"), F.lit("2026-01-01").alias("when")).alias("version"), F.struct(F.col("p_brand").alias("key"), F.col("p_type").alias("name")).alias("space"),
        F.struct(F.lit("2025-01-01").alias("createdDate"), F.struct(some(0).alias("displayName"), some(1).alias("publicName"), F.lit("id").alias("accountId")).alias("createdBy")).alias("history"),
        F.array(F.struct(F.lit("1").alias("id"), F.col("p_brand").alias("title")), F.struct(F.lit("2").alias("id"), F.col("p_type").alias("title"))).alias("ancestors"),
    )
    d = table(spark, sf_dir, "part").select("p_partkey", page.alias("page"))
    known = documents.from_api(F.col("page"), "https://wiki.example/")
    path = F.array_join(F.array_append(known["ancestor_titles"], known["title"]), " > ")
    return d.select("p_partkey", path.alias("breadcrumb"), F.array_join(known["ancestor_ids"], ",").alias("ancestor_ids"), *[known[c].alias(c) for c in ("title", "space_key", "space_name", "version", "updated_at", "created_at", "created_by", "source_url")])


def vector_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("page_id"), F.col("doc_id").alias("chunk_number"))
    return documents.with_vector_id(d).select("doc_id", "vector_id")


def candidate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.when(F.col("n_chars") % 2 == 0, F.col("source")).when(F.col("n_chars") % 3 == 0, F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", hybrid.key(some, F.col("doc_id")).alias("key"))


def inline_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.format_inline(answer.citations(retrieved(spark, sf_dir), 5))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = questions(spark, sf_dir).select("qid", "question").join(answer.contexts(retrieved(spark, sf_dir)), "qid")
    return d.select("qid", F.md5(answer.prompt(F.col("question"), F.col("context"))).alias("prompt_md5"))


def golden_from_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns asked about pages, added to a golden set of all assistant turns."""
    d = table(spark, sf_dir, "conversations")
    have = d.where("role = 'assistant'").select(F.col("text").alias("question"), F.array((F.col("conv_id") % 7).cast("string"), F.lit("x")).alias("relevant_page_ids"))
    asked = d.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.col("text").alias("question"), (F.col("conv_id") % 7).cast("string").alias("page_id"))
    return golden.from_ask(have, asked).select("id", "question", F.array_join("relevant_page_ids", ",").alias("pages"), F.array_join("answer_keywords", ",").alias("keywords"), "tag")


def eval_by_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.by_k(eval_aggregate(spark, sf_dir))


def registry_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation is registered; one entry takes another's place and one goes."""
    d = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lower("n_name").alias("title"), F.lit("mediawiki").alias("source"), F.lit("").alias("description"), F.create_map(F.lit("wiki_page_limit"), F.col("n_regionkey").cast("string")).alias("config"))
    kept = snapshots.Table(spark, scratch_path(spark, "registry"), catalog.SCHEMA)
    kept.replace(d)
    kept.update(lambda r: catalog.register(r, "NEW", "new", "confluence", token_env="T"))
    kept.update(lambda r: catalog.register(r, "CANADA", "again", "mediawiki", wiki_page_limit=9))
    kept.update(lambda r: catalog.remove(r, "BRAZIL"))
    return kept.read().select("name", "title", "source", F.col("config")["wiki_page_limit"].alias("page_limit"), F.col("config")["token_env"].alias("token_env"))


def _job(spark: SparkSession, name: str) -> pipeline.Ingestion:
    return pipeline.Ingestion(spark, scratch_path(spark, name), "kb")


def raw_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of two collections written below one root, one of them twice; the other is whole."""
    job, d = _job(spark, "raw"), table(spark, sf_dir, "pages")
    other = pipeline.Ingestion(spark, job.root, "other")
    for j, pages in ((job, d), (other, d), (other, d.where("page_id < 0"))):
        j._write(pages, "raw")
    return job.table("raw").select("page_id", "url", F.md5("html").alias("html_md5"))


def ingested_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through cleaning, metadata, chunks, vectors and the index; what the written index says of each page."""
    job, d = _job(spark, "kb"), table(spark, sf_dir, "pages")
    job._write(d.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.concat(F.lit("Page "), "page_id").alias("title")), "raw")
    list(job.run(["clean", "metadata", "chunk", "embed", "index"]))
    per = job.table("indexed").groupBy("page_id").agg(F.count(F.lit(1)).alias("chunks"), F.min("vector_id").alias("first_vector"))
    terms = job.sparse_index().postings.join(job.table("indexed").select(F.col("vector_id").alias("id"), "page_id"), "id").groupBy("page_id").agg(F.sum("tf").alias("tokens"))
    return per.join(terms, "page_id", "left")


def index_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse index of all documents, written and read back."""
    job = _job(spark, "index")
    job._write(vector_chunks(spark, sf_dir), "indexed")
    job.index()
    return job.sparse_index().terms.select("term", "df", F.round("idf", 6).alias("idf"))


def golden_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates from all documents saved, approved twice and read back as the golden set."""
    job = _job(spark, "golden")
    job._write(chunks(spark, sf_dir), "indexed")
    e = evaluation.Evaluation(job)
    e.bootstrap(3)
    e.approve()
    e.approve()
    return e.questions().select("id", "question", F.array_join("relevant_page_ids", ",").alias("pages"), F.array_join("answer_keywords", ",").alias("keywords"), "tag")


def history_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All user turns logged as asks, in two parts; the history keeps its newest 200."""
    e = evaluation.Evaluation(_job(spark, "history"))
    t = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ask_id"), F.col("text").alias("question"))
    rows = t.select(F.timestamp_seconds("ask_id").alias("ts"), "ask_id", "question", F.lit("LOW").alias("confidence"), F.lit(False).alias("answer_generated"), F.lit(0.0).alias("top_similarity"), F.lit(0).cast("long").alias("unique_pages"), *[F.array().cast("array<string>").alias(c) for c in ("retrieved_pages", "retrieved_titles")])
    for part in (0, 1):
        e.keep(rows.where(F.col("ask_id") % 2 == part))
    return e.history().select("ask_id", "question")


def results_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation's means, written as JSON and read back."""
    path, d = scratch_path(spark, "results"), eval_aggregate(spark, sf_dir)
    hierarchy.write_json(d, path)
    return hierarchy.read_json(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema.fields))


def sidecar_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a source knows of each page, joined to its cleaned page from the written table."""
    job, d = _job(spark, "sidecar"), table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    job._write(d.select("page_id", "url", F.concat(F.lit("T "), "page_id").alias("title")), "sidecar")
    return documents.join_sidecar(documents.clean_pages(d).select("page_id", F.length("html").alias("chars")), job.table("sidecar")).select("page_id", "url", "title", "chars")


def _reindexed(spark: SparkSession, sf_dir: str) -> segments.SegmentedIndex:
    """An index of all documents, each a page, of which two in five changed, a fifth went and a fifth became empty since."""
    index = segments.SegmentedIndex(spark, scratch_path(spark, "segments"))
    d = chunks(spark, sf_dir).withColumn("page_id", F.col("chunk_id")).withColumn("chunk_number", F.lit(1))
    of = lambda *some: (F.col("vector_id") % 5).isin(*some)
    index.apply(d, d.select("page_id"))
    index.apply(d.where(of(1)).withColumn("text", F.concat(F.lit("renewed once "), "text")), d.where(of(1, 2)).select("page_id"))
    index.apply(d.where(of(1, 4)).withColumn("text", F.concat(F.lit("renewed twice again "), "text")), d.where(of(3)).select("page_id"))
    return index


def reindexed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the segments, which are those of an index built anew."""
    return _reindexed(spark, sf_dir).index().terms.select("term", "df", F.round("idf", 6).alias("idf"))


def reindexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage asked of the segments and, after compaction, of the one that is left."""
    index, asked = _reindexed(spark, sf_dir), questions(spark, sf_dir)
    best = lambda: sparse.search(index.index(), asked, 30).groupBy("qid", F.round("bm25_score", 6).alias("score")).agg(F.count(F.lit(1)).alias("documents"))
    before = cut(best().withColumn("compacted", F.lit(False)), "before-compaction")
    index.compact()
    return before.unionByName(best().withColumn("compacted", F.lit(True)))


def synthetic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.chunks(ready(spark), 40).select("chunk_id", "page_id", "title", "section", "owner", "status", F.md5("text").alias("text_md5"), "word_count", "character_count")


def synthetic_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 on the synthetic corpus: hit at 1 for each kind of question."""
    c, q = synthetic.chunks(ready(spark), 40), synthetic.questions(spark, 40)
    found = sparse.search(sparse.build(c, "vector_id", page_text()), q, 20).join(c.select(F.col("vector_id").alias("id"), "page_id"), "id")
    pages = evaluate.pages_in_order(found.withColumn("rank", F.col("sparse_rank")))
    per = evaluate.per_question(pages, q.select("qid", F.explode("relevant_page_ids").alias("page_id")), q)
    return per.join(q.select("qid", "tag"), "qid").groupBy("tag").agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg("hit_at_1"), 4).alias("hit_at_1"), F.round(F.avg("mrr"), 4).alias("mrr"))


QUERIES = (
    tokenize_stats, word_count, snippet, html_strip_sql, html_to_markdown, normalize_field_name, bm25_term_stats, bm25_topk, bm25_batch, dense_topk, dense_topk_batch, minmax_norm, hybrid_fusion, rerank_breakdown, retrieve_filtered, citations,
    context_block, answers, answer_metrics, confidence_bucket, score_summary, diagnostics, dedup_pages, precision_recall_hit, mrr_map, eval_aggregate, context_sufficiency, compare_dense_hybrid, auto_bootstrap, golden_merge, chunk_documents,
    chunk_validation, md_line_spans, corpus_summary, corpus_counts, page_tree, page_urls, field_value_table, embedding_texts, embed_chunks, ask_history_top, collection_listing, reindexed_terms, reindexed_search,
    tree_lines, api_metadata, vector_ids, candidate_keys, inline_sources, prompts, golden_from_ask, eval_by_k, registry_changes, raw_sink, ingested_pages, index_sink, golden_sink, history_sink, results_sink, sidecar_sink,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
