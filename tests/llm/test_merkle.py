import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quarry.llm import merkle as M
from quarry.llm import places, queries

H = lambda *xs: hashlib.sha256("".join(xs).encode()).hexdigest()
UPPER = dict(zip(range(65, 91), range(97, 123), strict=True))


def _leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def _proof(levels, i):
    steps = []
    for nodes in levels[:-1]:
        run = i // 8 * 8
        steps.append((nodes[run:i], nodes[i + 1 : run + 8]))
        i //= 8
    return steps


def _fold(now, steps):
    for left, right in steps:
        now = H(*left, now, *right)
    return now


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0], _leaf(r), r))
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    for k in order:
        trees[k].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    per = {k: _levels([x[1] for x in trees[k]]) for k in order}
    top = _levels([per[k][-1][0] for k in order])
    out = []
    for t, k in enumerate(order):
        for i, (key, leaf, r) in enumerate(trees[k]):
            steps = _proof(per[k], i) + _proof(top, t)
            changed = key is not None and zlib.crc32(str(key).encode()) % 3 == 0 and r[4] is not None
            folded = _fold(_leaf((*r[:4], r[4].translate(UPPER))) if changed else leaf, steps)
            out.append((key, leaf, per[k][-1][0], top[-1][0], H(*[x for s in steps for side in s for x in side]), folded, folded == top[-1][0]))
    return out


def _got(docs, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *a: docs)
    return sorted(map(str, (tuple(r) for r in queries.op11_merkle_coordinate_proofs(docs.sparkSession, "").collect())))


@pytest.mark.parametrize("n", [1, 9, 64, 577])
def test_proofs_of_trees_of_all_shapes(spark, monkeypatch, n):
    d = spark.range(n).select((F.col("id") * 7 % 1000 - 5).alias("doc_id"), F.lit("s").alias("source"), F.lit("x").alias("lang"), F.col("id").alias("n_chars"), F.concat(F.lit("Text "), "id").alias("text"))
    if n == 9:  # a tree of nine, and nine trees of one leaf each
        d = d.unionByName(d.withColumn("lang", F.col("doc_id").cast("string")))
    assert _got(d, monkeypatch) == sorted(str(x) for x in brute([tuple(r) for r in d.collect()]))


def test_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    some = F.when(F.col("doc_id") % 3 == 0, "de").when(F.col("doc_id") % 3 == 1, "").otherwise(F.lit(None))
    d = odd_docs.withColumn("lang", some).withColumn("source", F.when(F.col("doc_id") > 4, "é:1")).withColumn("n_chars", F.length("text").cast("long"))
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in d.collect()]
    assert _got(d, monkeypatch) == sorted(str(x) for x in brute(rows))
    assert _got(d.where("1 = 0"), monkeypatch) == []


def test_whole_table(spark, monkeypatch):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in d.collect()]
    assert _got(d, monkeypatch) == sorted(str(x) for x in brute(rows))


def test_any_change_breaks_the_proof(spark, odd_docs):
    p = M.proofs(M.build(odd_docs, ("doc_id", "text"), "label"))
    right, wrong = M.fold(F.col("leaf"), F.col("steps")), M.fold(F.reverse("leaf"), F.col("steps"))
    assert p.select((right == F.col("root")).alias("a"), (wrong == F.col("root")).alias("b")).distinct().collect() == [(True, False)]


def test_places_within_keys(spark):
    d = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.when(F.col("id") % 2 == 0, (F.col("id") % 7).cast("string"))).alias("k"), (F.col("id") * 37 % 3000).alias("v"))
    got = places.placed(d, ["k"], ["v"]).collect()
    by = {}
    for r in got:
        by.setdefault(r["k"], []).append((r["v"], r["_place"], r["_n"]))
    assert len(got) == 3000
    for rows in by.values():
        rows.sort()
        assert [x[1] for x in rows] == list(range(len(rows))) and {x[2] for x in rows} == {len(rows)}
