"""Python holds a bounded part of an Arrow batch at a time, and parses each text once."""

import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry import arrow
from quarry.operators import dense, documents, embedding, sparse
from quarry.plans import queries


def _peak(f, *a):
    """MB of Python objects at the most, and what f returns."""
    tracemalloc.start()
    try:
        out = f(*a)
        return tracemalloc.get_traced_memory()[1] / 1e6, out
    finally:
        tracemalloc.stop()


def test_texts_become_python_objects_a_part_at_a_time(monkeypatch):
    texts = [None, "", "x" * 500, *(f"{i} " * 20 for i in range(300)), "é" * 50]
    monkeypatch.setattr(arrow, "PART_BYTES", 400)
    seen = []
    got = arrow.by_parts(lambda some: seen.append(some) or pa.array([x and x[::-1] for x in some], pa.string()), pa.string())(pa.array(texts))
    assert got.to_pylist() == [x and x[::-1] for x in texts] and [x for some in seen for x in some] == texts
    assert all(len(some) == 1 or sum(len((x or "").encode()) for x in some) <= 400 for some in seen) and len(seen) > 30
    assert arrow.by_parts(None, pa.string())(pa.array([], pa.string())).to_pylist() == []


def test_memory_of_a_parsed_batch_does_not_follow_its_size():
    few, _ = _peak(documents._parsed(lambda x: x.upper(), "", pa.string()), pa.array(["a" * 5000] * 200))
    many, out = _peak(documents._parsed(lambda x: x.upper(), "", pa.string()), pa.array(["a" * 5000] * 4000))
    assert len(out) == 4000 and many < few + 1


def test_pages_are_parsed_once_and_keep_their_errors(spark):
    d = spark.createDataFrame([("1", "# A\n\nb\n\n# C\n\nd", ["u", None], {"k": "v"}), ("2", None, None, None), (None, "", [], {}), ("3", "e", None, {"x": None})], "page_id string, markdown string, ancestors array<string>, m map<string,string>")
    got = documents.chunk_pages(d)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("EvalPython") == 1
    rows = [(r["chunk_id"], r["text"], r["ancestors"], r["m"], r["chunk_number"], r["total_chunks"], r["heading_path"]) for r in got.orderBy("chunk_id").collect()]
    assert rows == [("1_001", "# A\n\nb", ["u", None], {"k": "v"}, 1, 2, ["A"]), ("1_002", "# C\n\nd", ["u", None], {"k": "v"}, 2, 2, ["C"]), ("3_001", "e", None, {"x": None}, 1, 1, [])]
    m = documents.with_metadata(documents.clean_pages(spark.createDataFrame([("1", "<h1>T</h1><table><tr><th>Field</th><th>Value</th></tr><tr><td>Owner</td><td>O</td></tr><tr><td>x y</td><td></td></tr></table>"), ("2", None)], "page_id string, html string"))).orderBy("page_id").collect()
    assert [(r["owner"], r["custom_fields"], r["headings"], r["markdown"] is None, r["error"], r["metadata_error"]) for r in m] == [("O", {"x_y": None}, [(1, "T")], False, None, None), (None, {}, [], False, None, None)]


def test_memory_of_embedding_holds_a_batch_of_texts():
    texts = pa.array([f"word{i % 9} " * 2000 for i in range(1000)])
    most, got = _peak(embedding.vectors(lambda some: np.ones((len(some), 4), np.float32) * [[len(x)] for x in some], 8), texts)
    assert most < 4 and got.type == pa.list_(pa.float32()) and got.to_pylist() == [[0.5] * 4] * 1000


def test_hashed_words_count_with_their_signs():
    got = embedding.hashing_embedder(["a b a", "", None], 5)
    want = np.zeros((3, 5), np.float32)
    for w in ("a", "b", "a"):
        h = zlib.crc32(w.encode())
        want[0, h % 5] += 1 if h >> 31 else -1
    assert got.dtype == np.float32 and (got == want).all()


def test_words_of_a_block_become_python_objects_a_part_at_a_time():
    texts = pa.array([f"Word{i} the word{i} " * 500 for i in range(300)])
    most, (words, own) = _peak(sparse._words, texts)
    assert most < 10 and own.tolist() == [1500] * 300 and words.slice(1500, 3).to_pylist() == ["word1", "the", "word1"]
    assert sparse._words(pa.array(["", "-"]))[1].tolist() == [0, 0]


def test_questions_are_scored_in_runs_of_bounded_postings(monkeypatch):
    r = np.random.default_rng(5)
    df = r.integers(1, 50, 40)
    docs = np.concatenate([np.sort(r.permutation(50)[:n]) for n in df])
    columns = {"lengths": (r.integers(5, 90, 50), pa.int32()), "ends": (np.cumsum(df), pa.int32()), "docs": (docs, pa.int32()), "tf": (r.integers(1, 9, len(docs)), pa.int32()), "terms": ([f"t{i}" for i in range(40)], pa.string())}
    held = sparse._Block(pa.RecordBatch.from_arrays([pa.array([x], pa.list_(t)) for x, t in columns.values()], names=list(columns)), 0, 40.0)
    asked = [[{"term": f"t{i}", "weight": float(r.normal())} for i in r.permutation(50)[:n]] for n in (0, 3, 40, 1, 7, 20, 0, 12)]
    words = pa.array([None, *asked], pa.list_(pa.struct({"term": pa.string(), "weight": pa.float64()})))[1:]
    least, flat = np.array([0.0, 0.5, 0.0, 9.0, 0.0, 1.0, 0.0, 0.2]), words.flatten()
    whole = sparse.score_block(held, np.repeat(np.arange(8), [len(x) for x in asked]), flat.field("term"), flat.field("weight").to_numpy(), least)[0]
    for most in (1, 900, 1 << 20):
        monkeypatch.setattr(sparse, "CELLS", most)
        runs = list(sparse.scores(held, words, least))
        assert [x for x, _ in runs] == np.r_[0, np.cumsum([len(x) for _, x in runs])][:-1].tolist() and (np.vstack([x for _, x in runs]) == whole).all()
        assert len(runs) == (8 if most == 1 else 1) or most == 900 and 1 < len(runs) < 8


def test_a_comparison_finds_its_relevant_texts_once(spark):
    got = queries.compare_dense_hybrid(spark, "/root/testdata/sf0.001")
    files = str(got.inputFiles())
    assert "documents.parquet" not in files and "relevant-" in files


def test_products_with_pivots_do_not_follow_the_batch():
    r = np.random.default_rng(3)
    v, p = r.normal(size=(10_000, 64)), r.normal(size=(256, 64))
    mb, near = _peak(dense._nearest, v, p)
    assert mb < 8 and near.tolist() == [int(((x - p) ** 2).sum(1).argmin()) for x in v]
    assert dense._nearest(v[:0], p).tolist() == []


def test_words_from_bytes_are_those_of_a_regular_expression():
    r = random.Random(4)
    texts = ["".join(r.choice("aZ09 \n-_éİKſßΣ日\x00") for _ in range(r.randrange(9))) for _ in range(3000)]
    for some in (pa.array(texts), pa.array(texts).slice(7, 900), pa.array(texts, pa.large_string()), pa.array([""])):
        words, own = sparse._words(some)
        found = [re.findall("[a-z0-9]+", t.lower()) for t in some.to_pylist()]
        assert words.to_pylist() == [w for x in found for w in x] and own.tolist() == [len(x) for x in found]


def test_blocks_hold_postings_in_few_bytes_and_give_them_back(spark):
    docs = [(i, f"w{i % 7} w{i % 5} w{i % 5} c " + f"only{i}" + " often" * (i * 300)) for i in range(300)]
    index = sparse.build(spark.createDataFrame(docs, "id long, text string").coalesce(1), "id", F.col("text"))
    want = sorted((w, i, n, len(t.split())) for i, t in docs for w, n in Counter(t.split()).items())
    assert sorted((r["term"], r["id"], r["tf"], r["dl"]) for r in index.postings.collect()) == want
    row = index.packed.first()
    held = sparse._Block(pa.RecordBatch.from_pylist([row.asDict()], pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("vocabulary", pa.binary()), ("postings", pa.binary())])), 0, 9.0)
    few = held.among(pa.array(["often", "none", "w3"]))
    assert set(few.terms.to_pylist()) == {"often", "w3"} and few.best.tolist() == [held.best[held.terms.to_pylist().index(w)] for w in few.terms.to_pylist()]
