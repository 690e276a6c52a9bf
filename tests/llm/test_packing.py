import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import packing as P


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=40))
def test_plan_places_every_piece_once_without_gaps(histogram):
    plan, fill, got = P.best_fit(histogram, 64), {}, {}
    for length, rank, n, first, each, offset in plan.tolist():
        for i in range(n):
            assert got.setdefault((length, rank + i), True) and got.pop((length, rank + i))
            got[length, rank + i] = True
            fill.setdefault(first + i // each, []).append((offset + i % each * length, length))
    assert len(got) == sum(histogram.values())
    assert {(n, r) for n, c in histogram.items() for r in range(c)} == set(got)
    for slots in fill.values():
        at = 0
        for o, n in sorted(slots):
            assert o == at
            at += n
        assert at <= 64
    assert sorted(fill) == list(range(len(fill)))
    total = sum(n * c for n, c in histogram.items())
    assert len(fill) <= 2 * total // 64 + 1


def test_cuts():
    assert P.cuts(10, 4) == [(0, 2), (2, 4), (6, 4)] and P.cuts(8, 4) == [(0, 4), (4, 4)] and P.cuts(1, 4) == [(0, 1)]


def test_encoder_gives_the_ids_of_tokenizers(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["", " ", "a<|endoftext|>b", "  two\n\n\nlines\t", "日本語 é ß 👍🏽", " x\xa0y", "'S 's 'LL don't", "1234 5.6e7", "a" * 3000]
    for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert P.encoder()(t) == e.ids


def test_odd_rows_round_trip(spark, odd_docs, no_docs):
    got = P.pack(odd_docs, keep_ids=True).toPandas()
    assert P.pack(no_docs).count() == 0
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.r_[0, g.length.cumsum().to_numpy()[:-1]]).all() and g.length.sum() <= P.CAPACITY
    whole = [np.array([*P.encoder()(r["text"]), P.END_ID]) for r in odd_docs.collect()]
    want = sorted((len(w[s : s + n]), zlib.crc32(w[s : s + n].astype("<u4").tobytes())) for w in whole for s, n in P.cuts(len(w)))
    assert sorted(zip(got.length, got.ids_crc32, strict=True)) == want
    long = got[got.id == 10].sort_values("piece")
    assert (long.start.to_numpy() == np.r_[0, long.length.cumsum().to_numpy()[:-1]]).all() and (long.length.iloc[1:] == P.CAPACITY).all()
    assert np.array_equal(np.concatenate(long.ids.tolist()), next(w for w, r in zip(whole, odd_docs.collect(), strict=True) if r["doc_id"] == 10))
