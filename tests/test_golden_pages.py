import random

from quarry.operators import golden


def test_pages_are_cut_before_they_are_gathered(spark):
    """The first characters of a page equal those of its whole text, whether chunks are many, long, empty or null."""
    r = random.Random(4)
    rows = [("many", i, "Many", "" if i % 3 else "x" * r.randrange(5)) for i in range(3000)]
    rows += [("long", 5000 + i, "Long", r.choice("abc") * 900) for i in range(4)] + [("huge", 6000, "Huge", "é" * 50_000)]
    rows += [("null", 7001, "Later", "end"), ("null", 7000, None, None), ("even", 8000, "Even", "a" * 99), ("even", 8001, "Even", "b")]
    r.shuffle(rows)
    d = spark.createDataFrame(rows, "page_id string, vector_id long, title string, text string").repartition(5)
    for most in (1, 100, 2000):
        got = {p["page_id"]: (p["first"], p["title"], p["text"]) for p in golden.pages(d, most).collect()}
        want = {}
        for page in {x[0] for x in rows}:
            own = sorted((x for x in rows if x[0] == page), key=lambda x: x[1])
            want[page] = (own[0][1], own[0][2], "\n".join(x[3] or "" for x in own)[:most])
        assert got == want
    assert golden.pages(d.where("1 = 0")).count() == 0


def test_a_page_of_very_many_chunks_is_cut_in_many_tasks_first(spark):
    d = spark.range(20_000).selectExpr("IF(id < 0, 'q', 'p') AS page_id", "id AS vector_id", "'T' AS title", "'x' AS text")
    first = golden.pages(d, 10)._jdf.queryExecution().executedPlan().toString().splitlines()
    assert any("Exchange hashpartitioning(page_id" in x and "salt" in x for x in first)
    assert golden.pages(d, 10).first()["text"] == "x\n" * 5
