"""The query answers on small tables: what it searches, and with what."""

from quarry.plans import queries

FILLER = "nowhere else are such opening words to be met by anybody who reads these pages today"


def _tables(spark, path, texts, vectors, passage):
    docs = [(i, t, "en", f"s{i}", len(t)) for i, t in texts.items()]
    for name, rows, kind in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("embeddings", [(i, v, 0) for i, v in vectors.items()], "vec_id long, embedding array<float>, label int"),
        ("benchmark", [(1, passage)], "item_id long, text string"),
    ):
        spark.createDataFrame(rows, kind).write.parquet(f"file://{path}/{name}.parquet")
    return f"file://{path}"


def test_documents_without_a_vector_are_found_by_their_words(spark, tmp_path):
    texts = {1: "plain talk of rivers", 2: "zebra quagga okapi", 3: "hills", 4: "lakes", 5: "moors"}
    got = queries.answers(spark, _tables(spark, tmp_path, texts, {1: [1.0, 0.0]}, "zebra quagga okapi")).collect()
    assert [(r["qid"], r["n_citations"]) for r in got] == [(1, 2)]


def test_words_after_the_first_eighty_letters_are_asked(spark, tmp_path):
    texts = {1: "plain talk of rivers", 2: "zebra quagga okapi", 3: "hills", 4: "lakes", 5: "moors"}
    assert len(FILLER) >= 80
    got = queries.answers(spark, _tables(spark, tmp_path, texts, {1: [1.0, 0.0], 2: [0.0, 1.0]}, FILLER + " zebra quagga okapi")).collect()
    assert [(r["qid"], r["n_citations"]) for r in got] == [(1, 2)]
