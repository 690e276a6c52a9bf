"""What retrieval leaves where it is read: texts, and blocks of postings."""

from collections import Counter

from quarry.operators import sparse
from quarry.plans import queries
from quarry.session import cut as real_cut

SF = "/root/testdata/sf0.001"


def _plan(d, kind="optimizedPlan"):
    return getattr(d._jdf.queryExecution(), kind)().toString()


def test_texts_are_indexed_without_a_join_to_their_vectors(spark, monkeypatch):
    seen, real = [], sparse.gather
    monkeypatch.setattr(sparse, "gather", lambda d, *a: seen.append(_plan(d)) or real(d, *a))
    queries.hybrid_fusion(spark, SF)
    queries.retrieved(spark, SF)
    assert len(seen) == 2 and not any("Join" in x for x in seen)


def test_texts_stay_and_candidates_come_to_them(spark):
    plan = _plan(queries.retrieved(spark, SF), "executedPlan")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_blocks_stay_and_questions_come_to_them(spark, monkeypatch):
    seen, real = [], sparse._evaluate
    monkeypatch.setattr(sparse, "_evaluate", lambda *a: seen.append(real(*a)) or seen[-1])
    index = queries.bm25_index(spark, SF)
    got = sparse.search(index, queries.questions(spark, SF), 30)
    assert seen and not any("SortMergeJoin" in _plan(d, "executedPlan") for d in seen)
    assert got.count() == got.select("qid", "id").distinct().count() > 0


def test_documents_are_counted_once_for_terms_and_their_mean(spark):
    index = queries.bm25_index(spark, SF)
    plan = _plan(sparse.question_terms(queries.questions(spark, SF)).join(index.terms, "term"))
    assert plan.count("Generate inline") == plan.count("Filter isnotnull(term") - plan.count("Generate explode") == 2


def test_a_question_without_id_asks_nothing(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue fox"), (3, "blue"), (4, "green"), (5, "grey")], "id long, text string")
    asked = spark.createDataFrame([(None, "fox"), (7, "red")], "qid long, question string")
    index = sparse.build(docs, "id", docs["text"])
    assert [(r["qid"], r["id"]) for r in sparse.search(index, asked, 5).collect()] == [(7, 1)]


def test_bounds_take_only_asked_terms_from_blocks(spark, monkeypatch):
    plans, real = {}, sparse.cut
    monkeypatch.setattr(sparse, "cut", lambda d, name, *a: plans.setdefault(name, _plan(d)) and real(d, name, *a))
    index = queries.bm25_index(spark, SF)
    sparse.search(index, queries.questions(spark, SF), 30)
    # A row for each term of each block would be a table that is larger than the texts.
    assert "inline" not in plans["block-bounds"] and "array<string>" not in sparse._BLOCKS


def test_a_task_adds_counts_of_its_blocks_before_they_move(spark, monkeypatch):
    monkeypatch.setattr(sparse, "BLOCK_DOCS", 10)
    docs = spark.createDataFrame([(i, f"red fox {i % 2}") for i in range(400)], "id long, text string").coalesce(1)
    blocks = real_cut(sparse.gather(docs), "blocks").coalesce(1)
    handed, frame = [], type(blocks)
    real = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda *a, **b: handed.append(real(*a, **b)) or handed[-1])
    got = {r["term"]: r["df"] for r in sparse.document_counts(blocks).collect()}
    assert blocks.count() == 40 and got == {"red": 400, "fox": 400, "0": 200, "1": 200}
    assert [sum(len(r["counted"]) for r in d.collect()) for d in handed] == [4]


def test_counts_that_are_added_more_than_once_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(sparse, "BLOCK_DOCS", 10)
    docs = spark.createDataFrame([(i, f"red w{i % 3} w{i} {'fox ' * (i % 4)}") for i in range(200)], "id long, text string").coalesce(1)
    blocks, want = real_cut(sparse.gather(docs), "blocks").coalesce(1), Counter(w for i in range(200) for w in {"red", f"w{i % 3}", f"w{i}", *["fox"] * (i % 4 > 0)})
    for most in (1, 30, 100, 150, 1 << 20):
        monkeypatch.setattr(sparse, "MERGED", most)
        assert {r["term"]: r["df"] for r in sparse.document_counts(blocks).collect()} == want
