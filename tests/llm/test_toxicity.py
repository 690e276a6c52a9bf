import random
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import toxicity as T


def test_self_kernel_is_the_sum_over_subsequences():
    m = np.random.default_rng(0).integers(0, 4, (5, 9)).astype(np.uint8)
    m[0, 3] = T.GAP
    for row, k in zip(m, T.self_kernel(m), strict=True):
        c = Counter()
        for t in combinations(range(9), 3):
            if all(row[i] != T.GAP for i in t):
                c[tuple(row[list(t)])] += T.DECAY ** (t[2] - t[0] + 1)
        assert abs(sum(v * v for v in c.values()) - k) < 1e-9


def test_margin_is_the_kernel_with_landmarks():
    units, marks = ["idiot", "thunder", "i.d.i-o.t"], ["idiot", "under"]
    vectors = T.features(marks)
    w = vectors.T @ np.array([1.0, -0.5])
    assert np.allclose(T.margins(units, w, 0.25), T.kernel(units, vectors) @ [1.0, -0.5] + 0.25)
    assert T.kernel(["IDIOT"], vectors)[0, 0] > 0.999 > T.kernel(["i.d.i-o.t"], vectors)[0, 0] > T.kernel(["thunder"], vectors)[0, 0]


def _corpus(spark, n=300):
    r = random.Random(3)
    syllables = ["an", "er", "th", "on", "re", "st", "le", "or"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    rows = []
    for i in range(n):
        ws = [word() for _ in range(60)]
        toxic = i % 3 == 0
        if toxic:
            ws.insert(r.randrange(60), r.choice(["moldrat", "Moldrat!", "slimepig", "zugwumpf"]))
        rows.append((i, " ".join(ws) + ". " + word(), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_learns_gapped_insults_from_labels(spark):
    d = _corpus(spark)
    model = T.train(d.select("doc_id", "text"), d.select("doc_id", "toxic"), learn=lambda k: k % 4 != 2)
    got = T.score(d, model).withColumnRenamed("id", "doc_id").join(d, "doc_id").where("doc_id % 4 = 2").toPandas()
    assert (got[got.toxic == 1].score >= 0.3).mean() > 0.9 and (got[got.toxic == 0].score >= 0.3).mean() < 0.1
    z = T.highest(["an er m.o.l.d-r.a.t th", "an er m o l d r a t on", "an er on th"], model)
    assert min(z[0], z[1]) > z[2]


def test_odd_rows(spark, odd_docs, no_docs):
    d = _corpus(spark)
    model = T.train(d.select("doc_id", "text"), d.select("doc_id", "toxic"))
    got = T.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    by = {r["id"]: r["score"] for r in got}
    assert by[2] == by[3] == by[4] == min(by.values())
    assert T.score(no_docs, model).count() == 0
    kept = T.reject(odd_docs, model)
    assert kept.columns == odd_docs.columns
    nobody = d.select("doc_id", F.lit(None).cast("int").alias("toxic"))
    assert T.train(d.select("doc_id", "text"), nobody) is None and T.train(no_docs, nobody) is None
    assert {r["score"] for r in T.score(odd_docs, None).collect()} == {0.0}


def test_query_has_one_row_for_each_document(spark):
    from quarry.llm.queries import op1_toxicity_string_kernel

    sf = "/root/testdata/sf0.001"
    got = op1_toxicity_string_kernel(spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
