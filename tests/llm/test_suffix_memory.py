"""What a task holds of a block's suffixes and of a group of them."""

import tracemalloc

import numpy as np
import pyarrow as pa

from quarry.llm import substring as S


def _peak(f, *a):
    tracemalloc.start()
    try:
        out = f(*a)
        return tracemalloc.get_traced_memory()[1] / 1e6, out
    finally:
        tracemalloc.stop()


def test_suffixes_are_compared_without_all_their_words_side_by_side():
    r = np.random.default_rng(6)
    texts = pa.array([" ".join(f"w{x}" for x in r.integers(0, 500, 3000)) for _ in range(50)])
    block = S.Block(pa.array(range(50)), texts, 13)
    code = np.unique(block.h, return_inverse=True)[1] + 1
    mb, (first, number, order, begin) = _peak(block.suffixes, block.whole, 13, code)
    assert len(block.whole) == 149_400 and mb < 13 * 8 * len(block.whole) / 1e6
    want = np.unique(code[block.whole[:, None] + np.arange(13)], axis=0)
    assert (np.unique(block.words(first, 13, code), axis=0) == want).all() and len(first) == len(want) == len(begin)
    assert (block.words(first[number], 13, code) == block.words(block.whole, 13, code)).all()


def test_a_group_is_sorted_without_a_second_copy():
    m = np.asfortranarray(np.random.default_rng(7).integers(1, 1000, (100_000, 13)))
    mb, (order, common) = _peak(S.sorted_suffixes, m)
    assert mb < m.nbytes / 1e6
    got = m[order]
    assert all(tuple(a) <= tuple(b) for a, b in zip(got[:2000], got[1:2001], strict=False))
    assert common[:2000].tolist() == [next((j for j in range(13) if a[j] != b[j]), 13) for a, b in zip(got[:2000], got[1:2001], strict=False)]
