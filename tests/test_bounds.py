"""Sparse and dense search by bounds: the same answers as scoring everything, at a part of the work."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.operators import dense, sparse


def _brute_dense(rows, asked, k):
    out = []
    for q, v in asked:
        near = sorted((-round(float(np.dot(v, x)), 9), i) for i, x in rows if len(x) == len(v))
        out += [(q, i, n + 1) for n, (_, i) in enumerate(near[:k])]
    return sorted(out)


def _spied(monkeypatch, module, name):
    """What a function of the module was given."""
    seen, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a: seen.append(a) or real(*a))
    return seen


def test_dense_bounds_leave_out_far_blocks(spark, monkeypatch):
    r = np.random.default_rng(1)
    middle = r.normal(size=(20, 16)) * 10
    rows = [(i, (middle[i % 20] + r.normal(size=16) * 0.1).tolist()) for i in range(2000)]
    rows += [(5000 + i, rows[7][1]) for i in range(30)]  # ties at every place
    asked = [(i, rows[i][1]) for i in range(0, 2000, 20)]
    for name, n in (("BLOCK", 64), ("GROUP", 32), ("PAGE", 8)):
        monkeypatch.setattr(dense, name, n)
    seen = _spied(monkeypatch, dense, "_products")
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = spark.createDataFrame(asked, "qid long, embedding array<double>")
    got = dense.search(v, q, 10)
    assert sorted((x["qid"], x["id"], x["dense_rank"]) for x in got.collect()) == _brute_dense(rows, asked, 10)
    blocks = {x["block"]: len(x["ids"]) for x in seen[0][2].collect()}
    scored = sum(len(x["at"]) * blocks[x["block"]] for a in seen for x in a[0].collect())
    assert scored < 0.3 * len(asked) * len(rows)


def test_dense_search_is_exact_on_the_given_vectors(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(x["vec_id"], np.array(x["embedding"], float)) for x in e.collect()]
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    got = dense.search(dense.build(e), q, 20).collect()
    assert sorted((x["qid"], x["id"], x["dense_rank"]) for x in got) == _brute_dense(rows, [x for x in rows if x[0] % 20 == 0], 20)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, None), (6, []), (7, [1.0, None]), (None, [9.0, 9.0]), (8, [1.0, 2.0, 3.0]), (9, [-5.0, 0.0]), (9, [-5.0, 0.0])]
    v = spark.createDataFrame([(*x, 1, "b") for x in rows], "vec_id long, embedding array<double>, block int, ids string")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0, 1.0]), (3, None), (4, [1.0]), (5, [nan, 0.0])], "qid long, embedding array<double>")
    got = sorted((x["qid"], x["dense_rank"], x["id"], x["score"]) for x in dense.search(v, q, 3).collect())
    assert got == [(1, 1, 1, 1.0), (1, 2, 2, 0.0), (1, 3, 9, -5.0), (2, 1, 8, 3.0)]
    assert dense.search(v.where("1 = 0"), q).count() == 0 and dense.search(v, q.where("1 = 0")).count() == 0


def _topics(n, r):
    """Documents of forty topics with words of their own, and words that all share."""
    return [(i, " ".join([f"t{i % 40}x{r.randrange(30)}" for _ in range(25)] + [f"c{int(r.expovariate(0.5))}" for _ in range(25)]), f"{i % 40}") for i in range(n)]


def _brute_sparse(docs, asked, k):
    words = {i: t.split() for i, t, _ in docs}
    avg = sum(map(len, words.values())) / len(words)
    df = Counter(w for t in words.values() for w in set(t))
    raw = {w: math.log(len(words) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(raw.values()) / len(raw)
    out = []
    for q, text in asked:
        scores = defaultdict(float)
        for w, times in Counter(text.split()).items():
            for i, t in words.items():
                if tf := t.count(w):
                    scores[i] += times * (raw[w] if raw[w] >= 0 else 0.25 * mean) * sparse.impact(tf, len(t), avg)
        out += [(q, i, n + 1) for n, (_, i) in enumerate(sorted((-round(s, 9), i) for i, s in scores.items() if s > 0)[:k])]
    return sorted(out)


def test_sparse_bounds_leave_out_blocks_and_postings(spark, monkeypatch):
    r = random.Random(3)
    docs = _topics(4000, r)
    docs += [(10_000 + i, docs[11][1], "11") for i in range(30)]  # ties
    asked = [(i, docs[i * 37][1]) for i in range(12)]
    d = spark.createDataFrame(docs, "id long, text string, topic string")
    q = spark.createDataFrame(asked, "qid long, question string")
    want = _brute_sparse(docs, asked, 10)
    for name, n in (("BLOCK_DOCS", 100), ("GROUP", 5)):
        monkeypatch.setattr(sparse, name, n)
    seen = _spied(monkeypatch, sparse, "_evaluate")
    for together in ((), ("topic",)):
        seen.clear()
        index = sparse.build(d, "id", F.col("text"), together)
        got = sorted((x["qid"], x["id"], x["sparse_rank"]) for x in sparse.search(index, q, 10).collect())
        assert got == want
    pairs = sum(a[1].count() for a in seen)
    assert pairs < 0.25 * len(asked) * index.blocks.count()
    # Of these pairs' postings, thresholds leave a part to be scored.
    asked_words = {x["qid"]: x["words"] for x in seen[0][2].collect()}
    held = {x["block"]: x for x in index.blocks.collect()}
    avgdl, scored = index.corpus.first()["avgdl"], 0
    for x in (p for a in seen for p in a[1].collect()):
        words = asked_words[x["qid"]]
        scored += sparse.score_block(_block(held[x["block"]], avgdl), np.zeros(len(words), int), pa.array([w["term"] for w in words]), np.array([w["weight"] for w in words]), np.array([x["least"]]))[1]
    df = {x["term"]: x["df"] for x in index.terms.collect()}
    assert scored < 0.1 * sum(df[w["term"]] for words in asked_words.values() for w in words)


def _block(row, avgdl):
    kinds = {"lengths": pa.int32(), "ends": pa.int32(), "docs": pa.int32(), "tf": pa.int32(), "terms": pa.string()}
    return sparse._Block(pa.RecordBatch.from_arrays([pa.array([row[c]], pa.list_(t)) for c, t in kinds.items()], names=list(kinds)), 0, avgdl)


def test_sparse_odd_rows(spark):
    docs = [(1, "apple"), (2, None), (3, ""), (None, "apple pie"), (4, "the of"), (5, "x " * 30_000 + "apple"), (6, "apple"), (6, "apple")]
    d = spark.createDataFrame([(*x, 1, "t") for x in docs], "id long, text string, block int, terms string")
    q = spark.createDataFrame([(1, "apple"), (2, ""), (3, None), (4, "nothing here"), (5, "x")], "qid long, question string")
    index = sparse.build(d, "id", F.col("text"))
    got = sparse.search(index, q, 9).orderBy("qid", "sparse_rank").collect()
    assert [x["id"] for x in got if x["qid"] == 5] == [5] and {x["qid"] for x in got} == {1, 5}
    assert sorted(str(x["id"]) for x in got if x["qid"] == 1) == ["1", "5", "6", "6", "None"]
    assert sorted((x["term"], str(x["id"]), x["tf"], x["dl"]) for x in index.postings.where("term <> 'apple'").collect()) == [("pie", "None", 1, 2), ("x", "5", 30_000, 30_001)]
    assert sparse.search(sparse.build(d.where("1 = 0"), "id", F.col("text")), q).count() == 0


def test_nothing_passes_the_driver():
    for m in (dense, sparse):
        with open(m.__file__) as f:
            text = f.read()
        assert "toLocalIterator" not in text and "toPandas" not in text
