import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from quarry.llm import piece_sampling as P

sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def _segmentations(text):
    """All ways to spell a text in pieces, by brute force."""
    if not text:
        return [()]
    out = []
    for n in range(1, len(text) + 1):
        i = sp.piece_to_id(text[:n])
        if sp.id_to_piece(i) == text[:n] and not sp.is_unknown(i):
            out += [(i, *r) for r in _segmentations(text[n:])]
    return out


def test_samples_follow_the_distribution_without_replacement():
    lat = P.Lattices("piece_bpe_32k.model")
    lat.weight = lat.weight * 0.25  # flatter, so that several segmentations matter
    text, n = "lakes", 12_000
    all_ = _segmentations("▁" + text)
    w = np.array([sum(lat.weight[list(s)]) for s in all_])
    p = np.exp(w - w.max())
    p /= p.sum()
    keys = np.arange(n, dtype=np.uint64) * np.uint64(7919) + np.uint64(11)
    got = P.sample_texts([text] * n, keys, 2, lat)
    first = Counter(tuple(r[0][0].tolist()) for r in got)
    second = Counter(tuple(r[1][0].tolist()) for r in got)
    weighted = Counter()
    for r in got:
        for ids, f, _, inclusion in r:
            weighted[tuple(ids.tolist())] += np.exp(f - inclusion)
    for i in np.argsort(-p)[:6]:
        s = all_[i]
        later = sum(p[j] * p[i] / (1 - p[j]) for j in range(len(p)) if j != i)
        for share, want in ((first[s] / n, p[i]), (second[s] / n, later)):
            assert abs(share - want) < 4.5 * np.sqrt(want * (1 - want) / n) + 1e-4
        assert abs(weighted[s] / n - p[i]) < 0.03


def test_all_segmentations_of_a_small_text_come_out_and_then_inclusion_is_one():
    got = P.sample_texts(["the"], np.array([3], np.uint64), 50, P.lattices())[0]
    assert {tuple(r[0].tolist()) for r in got} == set(_segmentations("▁the"))
    assert all(r[3] == 0 for r in got)


def test_round_trip_distinct_and_falling(spark, odd_docs, no_docs):
    got = P.decode(P.encode(odd_docs.where("doc_id is not null"), k=3)).join(odd_docs.select(F.col("doc_id").alias("id"), "text").distinct(), "id").toPandas()
    assert (got.decoded == got.text.fillna("")).all()
    for _, g in got.drop_duplicates(["id", "sample"]).groupby("id"):
        assert len({tuple(x) for x in g.ids}) == len(g)
        v = g.sort_values("sample").perturbed.to_numpy()
        assert (np.diff(v) <= 0).all()
    again = P.encode(odd_docs, k=3).drop("ids")
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, P.encode(odd_docs.repartition(5), k=3).drop("ids").collect()), key=str)
    assert P.encode(no_docs).count() == 0


def test_op3_gives_distinct_segmentations_and_decodes_each_of_all_documents(spark):
    from quarry.llm.queries import op3_gumbel_segmentations

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = op3_gumbel_segmentations(spark, sf).collect()
    assert {r["doc_id"] for r in got} == set(texts) and len({(r["doc_id"], tuple(r["ids"])) for r in got}) == len(got)
    for r in got:
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        assert sp.decode(r["ids"]) == texts[r["doc_id"]] and len(r["ids"]) == r["n_pieces"]


def test_decoding_odd_texts_in_the_same_task_is_exact(spark, odd_docs):
    texts = ["", " ", "  x", "x  ", "   a   b  ", "\u2581", " \u2581\u2581 x", "\u2581 \u2581", "\n \t", "\x00", "\u00a0x", "\U0001f600  \ufffd", "<0x41> <unk> <s>"]
    d = spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    want = {hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in d.collect()}
    got = P.encode(d, k=3, digest=True).join(d.select(F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha")).distinct(), "id").collect()
    assert {r["decoded_sha256"] for r in got} <= want and all(r["decoded_sha256"] == r["sha"] for r in got)
    assert {r["decoded"] for r in P.decode(P.encode(d.where("doc_id >= 100"), k=3)).collect()} >= set(texts)


def test_what_is_kept_of_the_words_changes_no_sample(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    wide, narrow = P.Lattices("piece_bpe_32k.model"), P.Lattices("piece_bpe_32k.model", 3000)
    for k, t in enumerate(texts):
        a, b = (P.sample_texts([t], np.array([k], np.uint64), 3, lat)[0] for lat in (wide, narrow))
        assert [(x[0].tolist(), x[1:]) for x in a] == [(y[0].tolist(), y[1:]) for y in b]


def test_a_draw_reads_few_edges_and_takes_the_first_whose_sum_exceeds_it():
    class Counted(np.ndarray):
        read = 0

        def __getitem__(self, at):
            got = np.asarray(super().__getitem__(at))
            Counted.read += got.size
            return got

    lat = P.Lattices("piece_bpe_32k.model")
    word = lat.words("the quick brown foxes were jumping over several sleeping dogs \U0001f600 \u4e2d\u6587 x".split(" ") * 40)
    cum, start, key, place = lat.cum, lat.start[word], np.arange(len(word), dtype=np.uint64), np.arange(len(word)) * 50
    lat.cum = cum.view(Counted)
    drawn, count = lat.walk(start, start + lat.size[word], key, place)
    assert Counted.read < 2 * len(drawn)
    at = 0
    for i, n in enumerate(count.tolist()):
        node = int(start[i])
        for e in drawn[at : at + n].tolist():
            u = P.uniform(key[i : i + 1], place[i : i + 1] + node - int(start[i]))[0]
            some = cum[lat.first[node] : lat.first[node + 1]]
            assert e == lat.first[node] + np.flatnonzero(some > u)[0]
            assert u == P.uniform_one(i, int(place[i]) + node - int(start[i]))
            node += int(lat.step[e])
        assert node == start[i] + lat.size[word[i]]
        at += n
