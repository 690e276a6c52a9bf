import duckdb
import pytest

import corpus_pipeline
from quarry.llm import near_dedup, packing, substring

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "near-duplicates", "substring dedup", "best-fit packing"]
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path}/{k}"
        stage(spark, seen[-1], SF).write.parquet(path)
        seen.append(spark.read.parquet(path))
    for before, after in zip(seen[:3], seen[1:4], strict=True):
        assert after.columns == docs.columns and after.exceptAll(before).isEmpty() and after.count() <= before.count()
    once = near_dedup.classes(seen[3])
    assert once.where("id <> class_id").isEmpty()
    assert seen[4].columns == docs.columns and seen[4].count() == seen[3].count()
    # What is left of a document starts no window that a document with a smaller id had.
    cut = substring.dedup(seen[3]).toPandas().set_index("id")
    for r in seen[4].collect():
        assert r["text"].encode().split() == cut.text[r["doc_id"]].encode().split() and r["n_chars"] == len(r["text"])
    packed = seen[5].toPandas()
    assert set(packed.doc_id) == {r["doc_id"] for r in seen[4].select("doc_id").collect()}
    assert packed.groupby("sequence_id").length.sum().max() <= packing.CAPACITY


def test_pipeline_query_is_registered():
    import __spark_entry__

    assert {"pipeline", *(f"op{n}_" for n in range(1, 11))} <= {k if k == "pipeline" else k.split("_")[0] + "_" for k in __spark_entry__.queries()}


@pytest.mark.parametrize("name", ["op6_url_vocabulary", "op7_quality_cascade", "op10_prefix_suffix_trees"])
def test_queries_match_sql(spark, name):
    from quarry.llm import queries

    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = c.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()[want.columns.tolist()]
    key = want.columns[0]
    a, b = (x.sort_values(key).reset_index(drop=True).astype(object) for x in (got, want))
    assert a.where(a.notna(), None).values.tolist() == b.where(b.notna(), None).values.tolist()
