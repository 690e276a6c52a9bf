import numpy as np
from pyspark.sql import functions as F

from quarry.llm import ann


def _brute(ids, x, k):
    out = {}
    for i in range(len(x)):
        if ids[i] % 20 == 0:
            s = (x * x[i]).sum(1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
            out[ids[i]] = [(ids[j], s[j]) for j in order]
    return out


def test_recall_against_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    t = d.toPandas()
    want = _brute(t.vec_id.to_numpy(), np.stack(t.embedding).astype(float), 20)
    got = ann.search(d, F.col("id") % 20 == 0).toPandas()
    assert set(got.groupby("query_id").size()) == {20}
    found = {q: set(g.id) for q, g in got.groupby("query_id")}
    assert np.mean([len(found[q] & {i for i, _ in w}) / 20 for q, w in want.items()]) >= 0.9
    exact = ann.search(d, F.col("id") % 20 == 0, exact=True).toPandas().sort_values(["query_id", "rank"])
    for q, g in exact.groupby("query_id"):
        assert list(g.id) == [i for i, _ in want[q]] and np.allclose(g.score, [s for _, s in want[q]], atol=1e-12)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, []), (10, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (40, None), (0, [1.0, 0.0])]
    d = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, part int, id string")
    got = ann.search(d, F.col("id") % 20 == 0, k=20).toPandas().sort_values(["query_id", "rank", "id"])
    assert set(got.query_id) == {0, 20}
    assert list(got[got.query_id == 20].id) == [3, 0, 0, 1, 2] and 0 not in set(got[got.query_id == 0].id)
    assert ann.search(d.where("1 = 0"), F.col("id") % 20 == 0).count() == 0


def test_a_common_vector_fills_many_blocks(spark):
    r = np.random.default_rng(2)
    x = np.r_[np.tile(r.normal(size=8), (400, 1)), r.normal(size=(800, 8))]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(d, F.col("id") % 20 == 0, k=7, parts=4, block=64, exact=True).toPandas().sort_values(["query_id", "rank"])
    want = _brute(np.arange(len(x)), x, 7)
    for q, g in got.groupby("query_id"):
        assert list(g.id) == [i for i, _ in want[q]]


def test_parts_are_balanced():
    x = np.random.default_rng(1).normal(size=(640, 16))
    at = ann.balanced_parts(x, ann.neighbours(x, 10), 8)
    assert np.bincount(at, minlength=8).max() <= 90


def test_queries_whose_parts_hold_too_few_probe_all_others(spark):
    r = np.random.default_rng(0)
    centres, share = r.normal(size=(16, 16)) * 6, r.dirichlet(np.full(16, 0.7))
    x = centres[r.choice(16, 260, p=share)] + r.normal(size=(260, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(d, F.col("id") % 20 == 0, k=20, parts=16).toPandas()
    assert set(got.groupby("query_id").size()) == {20} and got.groupby("query_id")["rank"].max().eq(20).all()
    want = _brute(np.arange(260), x, 20)
    assert np.mean([len(set(g.id) & {i for i, _ in want[q]}) / 20 for q, g in got.groupby("query_id")]) >= 0.9


def test_clusters_are_searched_in_few_parts():
    r = np.random.default_rng(3)
    x = np.repeat(r.normal(size=(32, 32)) * 3, 64, axis=0) + r.normal(size=(2048, 32))
    router, threshold = ann.learn(x, 16, 0.95, 20)
    assert ann.probed(router(x), threshold).mean() <= 4
    assert list(ann.probed(np.array([[0.6, 0.3, 0.1], [0.1, 0.1, 0.8]]), 0.85)) == [2, 2]
    assert list(ann.probed(np.array([[0.6, 0.3, 0.1]]), np.inf)) == [3]
