import pytest

from quarry import __main__ as command
from quarry.operators import answer, evaluate
from quarry.plans import evaluation, pipeline
from quarry.sources import snapshots


def _kept(spark, path):
    return spark.read.json(f"{path}/{snapshots.Log(spark, path).manifest()['data']}")


@pytest.fixture(scope="module")
def job(spark, tmp_path_factory):
    job = pipeline.Ingestion(spark, f"file://{tmp_path_factory.mktemp('kb')}", "kb")
    rows = [(str(i), f"Page {w}", f"http://w/{i}", f"<h1>{w}</h1><h2>Use of {w}</h2><p>How to use {w}: press the {c} button until the {w} stops.</p>") for i, (w, c) in enumerate((("alpha", "red"), ("beta", "green"), ("gamma", "blue")))]
    job._write(spark.createDataFrame(rows, "page_id string, title string, url string, html string"), "raw")
    list(job.run(["clean", "metadata", "chunk", "embed", "index"]))
    return job


def test_question_sets_results_and_comparison_are_kept(spark, job):
    e = evaluation.Evaluation(job)
    assert e.questions().count() == 0 and e.questions("candidates").count() == 0
    assert e.bootstrap(2).count() == 6
    assert e.approve() == 6 and e.approve() == 0
    s = e.evaluate().first().asDict()
    assert s["num_questions"] == 6 and s["hit_at_1"] == 1.0 and 0 < s["context_sufficiency"] <= 1
    back = _kept(spark, e.path("results"))
    assert back.count() == 6 and {"id", "question", "retrieved_top5", "mrr"} <= set(back.columns)
    assert _kept(spark, e.path("summary")).first()["mrr"] == s["mrr"]
    got = {r["metric"]: r for r in e.compare(0.5).collect()}
    assert got["hit_at_1"]["hybrid"] == 1.0 and got["mrr"]["delta"] == round(got["mrr"]["hybrid"] - got["mrr"]["dense"], 4)
    text = evaluate.comparison_report(_kept(spark, e.path("comparison")), 0.5, 6).split("\n")
    assert text[1] == "DENSE vs HYBRID  (alpha=0.5, 6 questions)" and text[5].startswith("precision@3 ") and text[-2].startswith("context_sufficiency@5")
    lines = evaluate.report(e.evaluate(), 1.5).split("\n")
    assert lines[3:5] == ["Questions evaluated : 6", "Eval time           : 1.5s"] and lines[6].startswith("PRECISION@3") and lines[-3].startswith("MAP           : ") and lines[-2].startswith("CTX_SUFF@5")


def test_asks_are_logged_with_times(spark, job):
    e = evaluation.Evaluation(job)
    for k in (1, 2):
        e.log(job.ask(spark.createDataFrame([(k, "How do I use beta?")], "qid long, question string")))
    rows = e.history().collect()
    assert [r["ask_id"] for r in rows] in ([2, 1], [1, 2]) and rows[0]["retrieved_titles"][0] == "Page beta"
    m = job.ask(spark.createDataFrame([(1, "beta")], "qid long, question string"), generator=lambda p: "so").first()["metrics"]
    assert m["retrieval_time_ms"] > 0 and m["total_time_ms"] >= m["retrieval_time_ms"]


def test_failed_calls_are_named_by_class():
    class APIStatusError(Exception):
        status_code = 418

    class InternalServerError(APIStatusError):
        pass

    class RateLimitError(Exception):
        pass

    assert [answer.error_text(e) for e in (InternalServerError("x"), RateLimitError("x"), ValueError("own"))] == ["OpenAI Error: 418", "OpenAI rate limit exceeded.", "own"]


def test_commands(spark, job, capsys, monkeypatch):
    monkeypatch.setattr(command, "get_spark", lambda: spark)
    root = ["--root", job.root, "--collection", "kb"]
    assert command.main(["--root", job.root, "--add-collection", "kb", "--source", "mediawiki"]) == 0
    for argv, says in ((["--bootstrap", "1"], "3 candidates"), (["--approve"], "questions added"), (["--evaluate"], "RETRIEVAL EVALUATION"), (["--compare"], "DENSE vs HYBRID"), (["--ask", "How do I use gamma?"], "Page gamma")):
        assert command.main(root + argv) == 0
        assert says in capsys.readouterr().out
    assert command.main(["--benchmark"]) == 0 and "(alpha=0.5, 80 questions)" in capsys.readouterr().out
    monkeypatch.setenv("COLLECTION", "kb")
    assert command.parser().parse_args([]).collection == "kb"


def test_texts_that_hold_a_passage(spark):
    texts = [("1", "xx one two three four five six seven yy"), ("2", "one two three  four five six seven"), ("3", "six seven"), ("4", None), ("5", "zero one two three four five six sevent")]
    passages = [(1, "one two three four five six seven"), (2, "six sev"), (3, ""), (4, None), (5, "ne two three four five six seve")]
    got = evaluate.holding(spark.createDataFrame(texts, "page_id string, text string"), spark.createDataFrame(passages, "qid long, passage string"))
    want = {(q, i) for i, t in texts for q, p in passages if t and p and p in t}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
