import math

import pytest
from pyspark.sql import functions as F

from quarry.operators import answer, catalog, dense, evaluate, golden, hybrid, rerank, sparse, synthetic, validate


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_bm25_by_hand(spark):
    docs = [(0, "apple apple pie"), (1, "apple tart"), (2, "apple plum jam"), (3, "stone fruit"), (4, None)]
    d = frame(spark, docs, "id long, text string")
    index = sparse.build(d, "id", F.col("text"))
    n, lens = 5, [3, 2, 3, 2, 0]
    raw = lambda df: math.log(n - df + 0.5) - math.log(df + 0.5)
    df = {"apple": 3, "pie": 1, "tart": 1, "plum": 1, "jam": 1, "stone": 1, "fruit": 1}
    mean = sum(map(raw, df.values())) / len(df)
    idf = {t: 0.25 * mean if raw(k) < 0 else raw(k) for t, k in df.items()}
    assert {r["term"]: pytest.approx(r["idf"]) for r in index.terms.collect()} == idf
    avg = sum(lens) / n
    s = lambda t, tf, dl: idf[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    got = sparse.search(index, frame(spark, [(1, "apple apple pie"), (2, "the nothing")], "qid long, question string")).collect()
    want = {0: 2 * s("apple", 2, 3) + s("pie", 1, 3), 1: 2 * s("apple", 1, 2), 2: 2 * s("apple", 1, 3)}
    assert {r["id"]: pytest.approx(r["bm25_score"]) for r in got} == want and {r["qid"] for r in got} == {1}


def test_minmax(spark):
    d = frame(spark, [(1, "a", 0.0), (1, "b", 10.0), (1, "c", 5.0), (2, "a", 3.0), (2, "b", 3.0), (3, "a", 0.0)], "qid long, k string, v double")
    got = {(r["qid"], r["k"]): r["n"] for r in d.select("qid", "k", hybrid.minmax(F.col("v")).alias("n")).collect()}
    assert got == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 0.5, (2, "a"): 1, (2, "b"): 1, (3, "a"): 0}


def test_fusion(spark):
    d = frame(spark, [(1, 1, 0.9, 1), (1, 2, 0.8, 2)], "qid long, id long, score double, dense_rank int")
    s = frame(spark, [(1, 1, 5.0, 1), (1, 3, 4.0, 2)], "qid long, id long, bm25_score double, sparse_rank int")
    got = hybrid.fuse(d, s).orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 2, 3] and got[0]["cosine_score"] == 0.9 and got[0]["bm25_score"] == 5.0 and got[2]["cosine_score"] == 0
    one = hybrid.fuse(frame(spark, [(1, 7, 1.0, 1)], d.schema), frame(spark, [(1, 8, 1.0, 1)], s.schema), 1.0).where("rank = 1").first()
    assert one["id"] == 7
    assert hybrid.candidate_k(20) == 60 and hybrid.candidate_k(5) == 30


def test_dense_batches_and_ties(spark, monkeypatch):
    v = frame(spark, [(i, [float(i % 3), 1.0]) for i in range(12)] + [(None, [9.0, 9.0]), (99, None)], "vec_id long, embedding array<float>")
    q = frame(spark, [(q, [1.0, 0.0]) for q in range(5)], "qid long, embedding array<float>")
    monkeypatch.setattr(dense, "GROUP", 2)
    got = dense.search(v, q, 5).orderBy("qid", "dense_rank").collect()
    assert [r["id"] for r in got if r["qid"] == 4] == [2, 5, 8, 11, 1] and len(got) == 25
    assert dense.search(v, q.where("1 = 0")).count() == 0
    assert [r["id"] for r in dense.search_one(v.where("embedding is not null and vec_id is not null"), [1.0, 0.0], 2).collect()] == [2, 5]


def _chunks(spark):
    c = synthetic.chunks(spark, 4)
    return c.withColumn("embedding", F.array(*[F.when(F.col("vector_id") == k, 1.0).otherwise(0.1) for k in range(20)]))


def test_retrieval_explains_scores_and_puts_the_cosine_back(spark):
    c = _chunks(spark)
    q = frame(spark, [(1, "What does error code ERR-1011 indicate?", [1.0 if k == 8 else 0.0 for k in range(20)])], "qid long, question string, embedding array<double>")
    got = rerank.retrieve(c, q, min_score=0.0).orderBy("rank").collect()
    assert got[0]["chunk_id"] == "900002_004" and len({r["chunk_id"] for r in got}) == len(got)
    r = got[0]
    assert r["embedding_score"] == r["score_breakdown"]["embedding"] == r["cosine_score"]
    assert r["score"] == pytest.approx(r["hybrid_score"] + sum(r["score_breakdown"][k] for k in rerank.BOOSTS))
    assert all(a["score"] >= b["score"] - 1e-9 for a, b in zip(got, got[1:], strict=False))
    few = rerank.retrieve(c, q, top_k=3, use_hybrid=False, min_score=0.5).collect()
    assert len(few) <= 3 and all(x["score"] >= 0.5 for x in few)
    assert rerank.retrieve_one(c, q).count() == 1


def test_answers_cover_all_outcomes(spark):
    c = _chunks(spark)
    asked = [(1, "restart the Aurora service"), (2, "zzz")]
    q = frame(spark, [(i, t, [0.5] * 20) for i, t in asked], "qid long, question string, embedding array<double>")
    ranked = rerank.retrieve(c, q.where("qid = 1"), min_score=0.0)
    off = {r["qid"]: r for r in answer.answer(q, ranked).collect()}
    assert off[2]["answer"] == answer.NOT_FOUND and off[2]["confidence"] == "LOW" and off[2]["citations"] is None
    assert off[1]["answer"] == answer.DISABLED and not off[1]["answer_generated"] and [x["index"] for x in off[1]["citations"]] == [1, 2, 3, 4, 5] and off[1]["metrics"]["chunks_used"] == 5
    on = answer.answer(q, ranked, lambda p: "yes" if "SOURCE 1" in p and "QUESTION\n\nrestart" in p else "no").where("qid = 1").first()
    assert on["answer"] == "yes" and on["answer_generated"]

    def broken(prompt):
        raise RuntimeError("down")

    bad = answer.answer(q, ranked, broken).where("qid = 1").first()
    assert bad["answer"] == answer.FAILED + "(down)" and bad["error"] == "down"
    lines = answer.format_inline(answer.citations(ranked, 2)).first()["sources"].split("\n")
    assert len(lines) == 2 and lines[0].startswith("[1] ")


def test_citation_scores_and_snippet(spark):
    d = frame(spark, [(1, 1, "c", "p", "t", "s", "w " * 400, 0.9, 0.7)], "qid long, rank int, chunk_id string, page_id string, title string, section string, text string, score double, embedding_score double")
    r = answer.citations(d).first()
    assert r["similarity"] == 0.7 and r["rerank_score"] == 0.9 and r["snippet"].endswith("...") and r["index"] == 1


@pytest.mark.parametrize(("s", "want"), [(0.55, "HIGH"), (0.4, "MEDIUM"), (0.39, "LOW"), (None, "LOW")])
def test_confidence(spark, s, want):
    assert spark.range(1).select(answer.confidence(F.lit(s).cast("double")).alias("c")).first()["c"] == want


def test_metrics_by_hand(spark):
    pages = frame(spark, [(q, p, i + 1) for q in range(1, 6) for i, p in enumerate("ABCDE")] + [(6, "A", 1), (6, "X", 2), (6, "C", 3)], "qid long, page_id string, rank int")
    rel = frame(spark, [(1, "A"), (2, "B"), (2, "D"), (3, "C"), (4, "Z"), (6, "A"), (6, "C")], "qid long, page_id string")
    q = frame(spark, [(i,) for i in range(1, 8)], "qid long")
    got = {r["qid"]: r for r in evaluate.per_question(pages, rel, q, (1, 2, 3, 4)).collect()}
    assert (got[1]["precision_at_1"], got[1]["precision_at_3"], got[2]["precision_at_4"]) == (1, pytest.approx(1 / 3), 0.5)
    assert (got[1]["recall_at_3"], got[3]["hit_at_2"], got[3]["hit_at_3"]) == (1, 0, 1)
    assert (got[1]["mrr"], got[3]["mrr"], got[4]["mrr"]) == (1, pytest.approx(1 / 3), 0)
    assert got[6]["map"] == pytest.approx((1 + 2 / 3) / 2) and got[6]["precision_at_4"] == pytest.approx(2 / 3)
    assert got[5]["map"] == got[5]["recall_at_3"] == 0 and got[7]["precision_at_1"] == 0


def test_pages_keep_their_best_place(spark):
    d = frame(spark, [(1, "A", 1), (1, "B", 2), (1, "A", 3), (1, "C", 4)], "qid long, page_id string, rank int")
    assert [tuple(r) for r in evaluate.pages_in_order(d).orderBy("rank").collect()] == [(1, "A", 1), (1, "B", 2), (1, "C", 3)]


@pytest.mark.parametrize(("words", "want"), [(["100", "Minute"], 1.0), (["100", "nonsense"], 0.5), ([], 0.0)])
def test_context_sufficiency(spark, words, want):
    ranked = frame(spark, [(1, 1, "limit is 100"), (1, 2, "per minute"), (1, 9, "nonsense")], "qid long, rank int, text string")
    q = frame(spark, [(1, words)], "qid long, answer_keywords array<string>")
    assert evaluate.context_sufficiency(ranked, q).first()["context_sufficiency"] == want


def test_comparison(spark):
    schema = "qid long, hit_at_1 double, mrr double"
    got = {r["metric"]: r for r in evaluate.compare(frame(spark, [(1, 0.0, 0.5), (2, 0.0, 0.2)], schema), frame(spark, [(1, 1.0, 1.0), (2, 0.0, 0.2)], schema)).collect()}
    assert got["hit_at_1"]["delta"] == 0.5 and got["mrr"]["delta"] == 0.25
    per = evaluate.compare_questions(frame(spark, [(1, 0.0, 0.5)], schema), frame(spark, [(1, 1.0, 1.0), (2, 0.0, 0.2)], schema)).orderBy("qid").collect()
    assert per[0]["dense_mrr"] == 0.5 and per[1]["dense_mrr"] is None
    assert "MRR           : 0.5000" in evaluate.report(evaluate.aggregate(frame(spark, [(1, 0.0, 0.5)], schema)))


def test_golden_drafts_and_merges(spark):
    c = synthetic.chunks(spark, 3)
    auto = golden.auto_bootstrap(c, 2).orderBy("id").collect()
    assert [r["id"] for r in auto] == [f"auto{i:03d}" for i in range(1, 7)] and auto[0]["question"] == "What information does the 'Aurora Service' page provide?"
    assert auto[1]["question"] == "What does the 'Configuration' section of 'Aurora Service' cover?" and auto[1]["answer_keywords"] == ["Configuration", "Aurora", "Service"]
    have = frame(spark, [("g1", "How?", ["b", "a"])], "id string, question string, relevant_page_ids array<string>")
    new = frame(spark, [(1, "n1", " how? ", ["a", "b"]), (2, "n2", "New", ["a"]), (3, "n3", "new ", ["a"]), (4, "n4", "  ", ["a"])], "pos long, id string, question string, relevant_page_ids array<string>")
    assert [r["id"] for r in golden.approve(have, new).collect()] == ["n2"]
    merged = golden.merge(have, new)
    assert merged.count() == 2 and golden.approve(merged, new).count() == 0
    asked = frame(spark, [(1, "How?", "a"), (2, "How?", "c"), (3, "How? ", "c")], "pos long, question string, page_id string")
    assert [(r["id"], r["relevant_page_ids"]) for r in golden.from_ask(have, asked).collect()] == [("ask002", ["c"])]


def test_generated_questions_survive_bad_replies(spark):
    c = synthetic.chunks(spark, 2)
    reply = lambda p: '```json\n[{"question": "Q1?", "answer_keywords": ["a"]}, {"question": " "}]\n```' if "Aurora" in p else "no json"
    assert [(r["id"], r["question"]) for r in golden.llm_bootstrap(c, reply).collect()] == [("llm001", "Q1?")]
    assert golden.llm_bootstrap(c, None).count() == 0


def test_synthetic_corpus(spark):
    c, q = synthetic.chunks(spark, 50), synthetic.questions(spark, 50, 4)
    assert c.count() == 250 and c.select("chunk_id").distinct().count() == 250 and q.count() == 200
    names = [r["name"].lower() for r in synthetic.services(spark, 50).collect()]
    assert len(set(names)) == 50
    for r in q.where("tag = 'exact_match'").collect():
        assert not any(n in r["question"].lower().split() for n in names)
    assert c.where("section = 'Error Codes'").select(F.regexp_extract("text", r"ERR-\d+", 0)).distinct().count() == 50
    assert validate.validate(c).first()["result"] == "PASS"


def test_validation_counts_errors(spark):
    c = synthetic.chunks(spark, 2)
    bad = c.withColumn("text", F.when(F.col("chunk_number") == 1, " ").otherwise(F.col("text"))).withColumn("section", F.when(F.col("chunk_number") > 3, F.col("section"))).unionByName(c.where("chunk_number = 5"))
    r = validate.validate(bad).first()
    assert (r["duplicate_ids"], r["empty_texts"], r["missing_fields"], r["result"]) == (2, 2, 6, "FAIL") and r["numbering_errors"] > 0


def test_collections(spark):
    reg = frame(spark, [("default", "Default", "confluence", "", {}), ("a", "A", "mediawiki", "", {"wiki_titles": "X,Y", "token_env": "T"})], catalog.SCHEMA)
    reg = catalog.register(reg, "b", "B", "mediawiki", wiki_page_limit=5)
    reg = catalog.register(reg, "b", "B2", "mediawiki")
    assert catalog.get(reg, "b")["title"] == "B2"
    assert catalog.source_options(catalog.get(reg, "a"), {"T": "secret"}) == {"wiki_titles": "X,Y", "token": "secret"}
    rows = catalog.listed(reg, frame(spark, [("a",)], "name string"), frame(spark, [("b",)], "name string")).collect()
    assert [(r["name"], r["has_index"], r["has_golden"]) for r in rows] == [("default", False, False), ("a", True, False), ("b", False, True)]
    assert catalog.remove(reg, "a").count() == 2
    for call in (lambda: catalog.register(reg, "default", "", "mediawiki"), lambda: catalog.register(reg, "x", "", "ftp"), lambda: catalog.get(reg, "nope"), lambda: catalog.remove(reg, "default")):
        with pytest.raises(catalog.ConfigError):
            call()


def test_settings():
    s = catalog.Settings.from_env({"WIKI_TITLES": "A, B,", "USE_HYBRID": "false", "TOP_K": "7", "HYBRID_ALPHA": "0.3"})
    assert s.wiki_titles == ("A", "B") and s.use_hybrid is False and s.top_k == 7 and s.hybrid_alpha == 0.3
    with pytest.raises(catalog.ConfigError):
        s.require("confluence_base_url")
