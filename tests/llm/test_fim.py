import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import fim, queries

TRANSFORM = fim.transform
ALPHABET = ["a", "<", "P", "S", "M", ">", "é", "日", "😀", "\n"]


def _sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute(key, text):
    text = text or ""
    n, h = len(text), hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (key, n, "plain", None, None, _sha(text), _sha(text))
    p, m, s = text[:a], text[a:b], text[b:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (key, n, form, a, b - a, _sha(out), _sha(text))


def _got(docs, monkeypatch, chunk):
    monkeypatch.setattr(queries, "table", lambda *a: docs)
    monkeypatch.setattr(queries.fim, "transform", lambda d: TRANSFORM(d, chunk_bytes=chunk))
    return sorted(map(str, map(tuple, queries.op13_parallel_automaton(docs.sparkSession, "").collect())))


@pytest.mark.parametrize("chunk", [7, fim.CHUNK_BYTES])
def test_against_brute_force(spark, odd_docs, no_docs, monkeypatch, chunk):
    r = random.Random(3)
    rows = [(i, "".join(r.choice(ALPHABET) for _ in range(r.choice((0, 1, 2, 5, 30, 400))))) for i in range(120)]
    d = spark.createDataFrame([*rows, (1, "<" * 50), (2, "<<P>"), (3, "<P<S<M"), (None, None), (5, "é" * 63 + "<M>")], "doc_id long, text string")
    monkeypatch.setattr(fim, "PAGE", 4)
    assert _got(d, monkeypatch, chunk) == sorted(str(brute(*x)) for x in d.collect())
    assert _got(d.where("1 = 0"), monkeypatch, chunk) == []


def test_odd_rows_and_giants(spark, odd_docs, monkeypatch):
    big = spark.createDataFrame([(77, "日本é<" * 60_000), (78, "x" * 200_000 + "<S>")], "doc_id long, text string")
    d = odd_docs.select("doc_id", "text", "row", "size", "key", "n").unionByName(big, allowMissingColumns=True)
    assert _got(d, monkeypatch, 4096) == sorted(str(brute(x["doc_id"], x["text"])) for x in d.collect())


def test_whole_table(spark, monkeypatch):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert _got(d, monkeypatch, fim.CHUNK_BYTES) == sorted(str(brute(x["doc_id"], x["text"])) for x in d.collect())


def test_functions_compose_whatever_the_cut():
    r, m = random.Random(1), fim.automaton()
    for _ in range(60):
        data = "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 300))).encode()
        at = sorted(r.randint(0, len(data)) for _ in range(2))
        whole = fim.Scan(np.frombuffer(data, np.uint8), np.array([0, len(data)]), m)
        parts = fim.Scan(np.frombuffer(data, np.uint8), np.array([0, *at, len(data)]), m)
        for s in range(m.states):
            now, n, hit = s, 0, False
            for k in range(3):
                n, hit, now = n + parts.begun[k, now], hit | parts.hit[k, now], parts.left[k, now]
            assert (now, n, hit) == (whole.left[0, s], whole.begun[0, s], whole.hit[0, s])
        assert (whole.begun[0, 0], whole.hit[0, 0]) == (len(data.decode()), any(x in data.decode() for x in fim.SENTINELS))
        for unit in range(0, len(data.decode()) + 1, 7):
            assert whole.find(np.zeros(1, int), np.zeros(1, int), np.array([unit]))[0] == len(data.decode()[:unit].encode())


def test_texts_come_back(odd_docs):
    d = fim.transform(odd_docs, chunk_bytes=1000).select("id", fim.restored(F.col("output"), F.col("form")).alias("text"))
    assert sorted(map(str, d.collect())) == sorted(str(r) for r in odd_docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).collect())
