"""What a task and its Python hold at once follows neither the table nor the batches in which Spark hands rows over."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry import session
from quarry.arrow import filled
from quarry.operators import dense, sparse
from quarry.plans import queries


def test_arrow_batches_are_bounded_by_bytes_unless_the_session_says(spark):
    queries.table(spark, "/root/testdata/sf0.001", "pages")
    assert int(spark.conf.get(session.ARROW)) == session.BATCH_BYTES <= 8 << 20
    rows = spark.range(12_000).coalesce(1).select(F.repeat(F.lit("x"), 4000).alias("t"))
    held = rows.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in bs), "n long").collect()
    assert max(r["n"] for r in held) < 9 << 20
    try:
        spark.conf.set(session.ARROW, "1m")
        assert session.ready(spark).conf.get(session.ARROW) == "1m"
    finally:
        spark.conf.set(session.ARROW, str(session.BATCH_BYTES))


def test_runs_go_on_over_the_edges_of_batches():
    texts = [None if i % 7 == 3 else "x" * (i % 11) for i in range(200)] + ["y" * 90, "z"]
    whole = pa.RecordBatch.from_pydict({"i": list(range(len(texts))), "text": pa.array(texts, pa.string())})
    want = [b.column("i").to_pylist() for b in filled(iter([whole]), "text", 40, 9)]
    for n in (1, 4, 50):
        parts = [whole.slice(k, n) for k in range(0, len(texts), n)] + [whole.slice(0, 0)]
        assert [b.column("i").to_pylist() for b in filled(iter(parts), "text", 40, 9)] == want
    assert sum(want, []) == list(range(len(texts))) and len(want) > 20 and list(filled(iter([]), "text", 40)) == []


def test_postings_blocks_do_not_end_where_a_batch_does(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        d = spark.range(0, 3000, 1, 1).select("id", F.concat(F.lit("word w"), F.col("id") % 9).alias("text"))
        held = sparse.build(d, "id", F.col("text")).packed.select(F.size("ids").alias("n")).collect()
        assert sorted(r["n"] for r in held) == [3000 - sparse.BLOCK_DOCS, sparse.BLOCK_DOCS]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rows_of_vector_blocks_are_bounded_whatever_the_dimensions(spark):
    v = np.random.default_rng(2).normal(size=(2, 512))[np.arange(900) % 2]
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").coalesce(1)
    index = dense.build(d)
    assert index.blocks.agg(F.max(F.size("vectors")), F.sum(F.size("ids"))).first() == (dense.VALUES, 900)  # 256 of 450 equal vectors
    got = dense.search(index, d.where("vec_id < 5").withColumnRenamed("vec_id", "qid"), 3).collect()
    product = np.round(v[:5] @ v.T, 9)
    assert sorted((r["qid"], r["dense_rank"], r["id"]) for r in got) == [(q, k + 1, int(i)) for q in range(5) for k, i in enumerate(np.argsort(-product[q], kind="stable")[:3])]
