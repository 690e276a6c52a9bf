import random
import tracemalloc
from collections import defaultdict

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import near_dedup as N

from .conftest import words


def _common(a, b):
    d = [0] * (len(b) + 1)
    for x in a:
        p = 0
        for j, y in enumerate(b):
            p, d[j + 1] = d[j + 1], p + 1 if x == y else max(d[j + 1], d[j])
    return d[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=30), st.lists(st.integers(0, 8), max_size=30))
def test_banded_alignment_decides_like_the_full_table(a, b):
    assert N.aligned(a, b, len(a) + len(b) + 1) == _common(a, b)
    most = N.most_apart(len(a), len(b), 0.8)
    assert (len(a) + len(b) - 2 * N.aligned(a, b, most) <= most) == (len(a) + len(b) - 2 * _common(a, b) <= most)


def _brute(rows):
    """Class of each row by comparing all pairs of different texts."""
    v, n, keys = N.shingles(pa.array([t or "" for _, t in rows]), N.WIDTH)
    end = n.cumsum()
    parts = [v[e - k : e] for e, k in zip(end, n, strict=True)]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = (keys[i] == keys[j]).all()
            if top(i) != top(j) and (same or (len(parts[i]) and len(parts[j]) and N.compare(parts[i], parts[j], 0.8)[0])):
                up[top(i)] = top(j)
    groups = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        groups[top(i)].append(key)
    return sorted(((k, min((x for x in g if x is not None), default=None)) for g in groups.values() for k in g), key=str)


def _edited(text, rate, r):
    out = []
    for w in text.split():
        x = r.random()
        out += [] if x < rate / 3 else [f"e{r.randrange(40)}"] if x < 2 * rate / 3 else [w, f"i{r.randrange(9)}"] if x < rate else [w]
    return " ".join(out)


def test_classes_of_a_large_group_with_links_of_every_strength(spark):
    r = random.Random(8)
    base, shared = words(150, 20), words(70, 21)
    rows = [(i, _edited(base, r.choice([0.005, 0.02, 0.05, 0.1]), r)) for i in range(150)]
    rows += [(1000 + i, words(60, 100 + i) + " " + shared) for i in range(60)] + [(2000 + i, base) for i in range(5)]
    parts = base.split()
    rows += [(3000 + i, " ".join(parts[75:] + parts[:75]) + f" tail{i}") for i in range(3)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(x) for x in N.classes(d).collect()), key=str)
    assert got == _brute(rows)
    small = sorted((tuple(x) for x in N.classes(d, bands=20).collect()), key=str)
    assert small == got


def test_blocks_of_members_give_the_same_classes(spark, monkeypatch):
    r = random.Random(9)
    base = words(120, 30)
    rows = [(i, _edited(base, r.choice([0.02, 0.05, 0.1]), r)) for i in range(90)]
    whole = N._second_candidates
    monkeypatch.setattr(N, "_second_candidates", lambda star, similarity, known=None, forests=1: whole(star, similarity, known, forests, block=7))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(x) for x in N.classes(d).collect()), key=str) == _brute(rows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)).filter(lambda x: x[0] < x[1]), unique=True), st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=3), st.integers(1, 4))
def test_forests_span_the_pairs_and_share_none(pairs, joined, most):
    def parts(edges):
        of = list(range(10))
        for x, y in edges:
            of = [of[x] if k == of[y] else k for k in of]
        return {frozenset(k for k in range(10) if of[k] == c) for c in of}

    got = N._forests(pairs, joined, most)
    assert len(set(got)) == len(got) and set(got) <= set(pairs) and parts(got + joined) == parts(pairs + joined)
    assert len(got) <= 9 * most and set(N._forests(pairs, joined, 1)) <= set(got)
    apart = parts(joined)
    assert not any({x, y} <= c for x, y in got for c in apart)
    assert set(N._forests(pairs, [], len(pairs) + 1)) == set(pairs)


def test_alignment_of_long_texts_takes_memory_by_their_length():
    r = random.Random(3)
    a = list(range(40_000))
    b = [x if r.random() > 0.002 else -x - 1 for x in a]
    tracemalloc.start()
    assert N.aligned(a, b, 400) == sum(x == y for x, y in zip(a, b, strict=True))
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()


def test_refused_pairs_leave_no_link_out(spark, monkeypatch):
    """Two groups whose members hold the same shingles in another order: all pairs between them are refused, each group is one class."""
    r = random.Random(12)
    base = words(160, 50, 4000).split()
    turned = base[80:] + base[:80]
    far = words(80, 51, 4000).split()
    rows = []
    for i, whole in enumerate([base, turned] * 20):
        edited = list(whole)
        edited[r.randrange(len(edited))] = f"e{i}"
        rows.append((i, " ".join(edited)))
    # The leader of most buckets is far from all of them, so that they meet by their differences alone.
    rows += [(100 + i, " ".join(base[:80] + far) + f" f{i}") for i in range(3)]
    rounds = []
    whole_round = N._second_candidates

    def counted(star, similarity, known=None, forests=1):
        rounds.append(forests)
        return whole_round(star, similarity, known, forests, block=9)

    monkeypatch.setattr(N, "_second_candidates", counted)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(x) for x in N.classes(d).collect()), key=str) == _brute(rows)
    assert len(rounds) <= 4


def test_odd_rows(odd_docs, no_docs):
    got = {(r["id"], r["class_id"]) for r in N.classes(odd_docs).collect()}
    assert {(1, 1), (6, 1), (7, 1), (None, 1), (2, 2), (3, 2), (4, 2), (None, 2), (5, 5)} <= got
    assert N.classes(odd_docs).count() == odd_docs.count() and N.classes(no_docs).count() == 0
    kept = N.reject(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(r["doc_id"] for r in kept.select("doc_id").collect())
    assert ids == sorted({c for _, c in got})
    assert N.reject(no_docs).count() == 0
