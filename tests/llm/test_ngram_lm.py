import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import ngram_lm as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _tokens(t):
    return WORD.findall((t or "").translate(LOW)) + ["<end>"]


def test_base_score_against_counting(spark):
    from quarry.llm.queries import op8_deleted_interpolation

    sf = "/root/testdata/sf0.001"
    t = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    got = op8_deleted_interpolation(spark, sf).toPandas().set_index("doc_id").loc[t.doc_id]
    train = [zlib.crc32(str(i).encode()) % 5 != 1 for i in t.doc_id]
    toks = [_tokens(x) for x in t.text]
    c = Counter(w for k, on in zip(toks, train, strict=True) if on for w in k)
    n, v = sum(c.values()), len(c)
    assert np.allclose(got.base_score, [sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in k) for k in toks])
    assert list(got.n_tokens) == list(map(len, toks)) and list(got.n_known) == [sum(c[w] > 0 for w in k) for k in toks]
    assert set(got.train_tokens) == {n} and list(got.held_out) == [not x for x in train]
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_score_is_the_mixture(spark, monkeypatch, block_bytes):
    """With fixed weights the score follows from counts alone."""
    fixed = np.array([0.4, 0.25, 0.2, 0.15])
    monkeypatch.setattr(L, "learn_weights", lambda cells, v: {-1: fixed})
    rows = [(i, t) for i, t in enumerate(["a b a b c", "b a b", "A c c c", "", "a b d", None, "q", "b a b c", "x a b a q"])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["score"] for r in L.score(d, learn=lambda i: i < 4, block_bytes=block_bytes).collect()}
    train = [["<s>", *_tokens(t)] for i, t in rows if i < 4]
    one, two, three, ctx = Counter(), Counter(), Counter(), Counter()
    for k in train:
        one.update(k[1:])
        two.update(zip(k, k[1:], strict=False))
        three.update(zip(k, k[1:], k[2:], strict=False))
        ctx.update(k[:-1])
    n, v = sum(one.values()), len(one)
    for i, t in rows:
        k = ["<s>", *_tokens(t)]
        want = 0.0
        for at in range(1, len(k)):
            f2 = two[k[at - 1], k[at]] / max(ctx[k[at - 1]], 1)
            f3 = three[tuple(k[at - 2 : at + 1])] / max(two[k[at - 2], k[at - 1]], 1) if at > 1 else f2
            want += math.log10(0.4 * f3 + 0.25 * f2 + 0.2 * one[k[at]] / n + 0.15 / (v + 1))
        assert got[i] == pytest.approx(want)


def test_small_blocks_and_buckets_give_the_same_scores(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    a, b = (sorted(map(tuple, L.score(d, block_bytes=n, bucket_rows=m).collect())) for n, m in ((1 << 22, 1 << 20), (5000, 200)))
    assert np.allclose(np.array(a, float), np.array(b, float))


def test_weights_rise_with_the_share_that_longer_contexts_explain():
    w = L.learn_weights(np.array([(1, L.UNSEEN, L.UNSEEN, 8, 100), (9, L.UNSEEN, 2, 30, 1000), (L.LONG + 3, 1, 20, 30, 1000)]), 50)
    assert w[9][1] > 0.8 > w[1][1] and w[L.LONG + 3][0] > 0.8 and all(abs(x.sum() - 1) < 1e-9 for x in w.values())
    assert L.learn_weights(np.zeros((0, 5)), 0).keys() == {-1}


def test_text_that_occurs_twice_scores_far_above_the_rest(spark):
    """A model of the whole corpus knows the runs of words of a text whose copy it has learnt from."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").dropDuplicates(["text"]).where("length(text) > 100").cache()
    texts = d.count()
    twice = d.unionByName(d.where("doc_id % 10 = 3").selectExpr("doc_id + 1000000 doc_id", "text"))
    got = {r["id"]: r["score"] / r["n_tokens"] for r in L.score(twice, learn=lambda i: i < 1_000_000, block_bytes=20_000).collect()}
    alone = {r["id"]: r["score"] / r["n_tokens"] for r in L.score(d, learn=lambda i: i % 10 != 3, block_bytes=20_000).collect() if r["id"] % 10 == 3}
    assert texts > 50 and all(got[i + 1_000_000] > alone[i] for i in alone)


def test_odd_rows(odd_docs, no_docs):
    got = L.score(odd_docs, learn=lambda i: F.lit(True)).collect()
    assert len(got) == odd_docs.count() and all(r["score"] <= 0 for r in got)
    by = {r["id"]: r["n_tokens"] for r in got}
    assert by[2] == by[3] == by[4] == 1 and by[10] == 30_001
    assert all(r["score"] == 0 and r["train_tokens"] == 0 for r in L.score(odd_docs, learn=lambda i: F.lit(False)).collect())
    assert L.score(no_docs).count() == 0


def test_counts_above_32_bits_add_up():
    import pandas as pd

    from quarry.llm import blocks as B

    keys = np.array([5, 9], np.uint64)
    sent = [(np.array([[3_000_000_000, 1], [1, 2]], np.int64), b) for b in (7, 8)]
    g = pd.DataFrame([(0, 0, b, B.squeeze_sorted(keys), B.squeeze(np.ascontiguousarray(c.T).ravel())) for c, b in sent], columns=["kind", "bucket", "block_id", "keys", "counts"])
    told = L.add_up(g)
    assert told["n_main"].tolist() == [6_000_000_002, 0] and told["n_all"].tolist() == [6_000_000_008, 0]
    words, _ = L.heard([{"kind": 0, "bucket": 0, "counts": told["counts"][1]}], [2, 0])
    assert words.tolist() == [[6_000_000_000, 2], [2, 4]]
