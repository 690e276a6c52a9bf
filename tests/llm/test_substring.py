import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quarry.llm import substring as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _brute(rows, n):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    rank = lambda i: float("inf") if i is None else i
    for i, w in split:
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, float("inf")), rank(i))
    out = []
    for i, w in split:
        gone = {k + j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < rank(i) for j in range(n)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def _got(d, **how):
    return sorted((tuple(r) for r in S.dedup(d, **how).collect()), key=str)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert _got(odd_docs) == _brute(rows, 13)
    assert _got(odd_docs, leaf=5) == _brute(rows, 13)
    assert S.dedup(no_docs).count() == 0
    whole = S.dedup(odd_docs, whole_rows=True)
    assert whole.columns == odd_docs.columns and whole.count() == len(rows)
    assert {r["text"] for r in whole.where("doc_id = 4").collect()} == {" \n\t "}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 6)), st.lists(st.sampled_from("abc"), max_size=25).map(" ".join)), min_size=1, max_size=12))
def test_small_alphabets_against_brute_force(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert _got(d, window=4, leaf=3) == _brute(rows, 4)


def test_prefixes_are_split_where_they_are_frequent(spark, monkeypatch):
    assert S.prefix_lengths(13) == [2, 4, 8, 13] and S.prefix_lengths(4) == [2, 4]
    shared = " ".join(f"s{i}" for i in range(30))
    rows = [(i, f"a{i} b{i} {shared if i % 2 else shared[::-1]} c{i}") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    seen, cut = [], S.cut
    monkeypatch.setattr(S, "cut", lambda x, name: seen.append((name, cut(x, name))) or seen[-1][1])
    monkeypatch.setattr(S, "SMALLEST", 1)
    assert _got(d, leaf=4) == _brute(rows, 13)
    assert [name for name, _ in seen] == ["repeated", *["nodes"] * 4]
    assert all(x.where("group is not null").count() > 0 for name, x in seen[1:4])


def _maximal(rows, least):
    """Every repeat that neither all its next words nor all its words before extend, by listing all runs of words."""
    found = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for a in range(len(w)):
            for b in range(a + least, len(w) + 1):
                found.setdefault(tuple(w[a:b]), []).append((i, a, w[a - 1] if a else None, w[b] if b < len(w) else None))
    different = lambda xs: None in xs or len(set(xs)) > 1
    rank = lambda x: (x[0] is None, x[0] or 0, x[1])
    return sorted(((len(k), len(v), *min(v, key=rank)[:2]) for k, v in found.items() if len(v) > 1 and different([x[2] for x in v]) and different([x[3] for x in v])), key=str)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.lists(st.sampled_from("abc"), max_size=25).map(" ".join), min_size=1, max_size=10))
def test_maximal_repeats_against_brute_force(spark, rows):
    rows = list(enumerate(rows))
    got = S.repeats(spark.createDataFrame(rows, "doc_id long, text string"), least=3, depth=30).collect()
    assert sorted(((r["length"], r["occurrences"], r["id"], r["start"]) for r in got), key=str) == _maximal(rows, 3)
    assert not any(r["open"] for r in got)


def test_repeats_of_odd_rows_and_long_ones(odd_docs, no_docs):
    assert S.repeats(no_docs).count() == 0
    got = S.repeats(odd_docs.where("doc_id in (8, 9, -4)"), depth=100).collect()
    assert [(r["length"], r["occurrences"], r["id"], r["start"], r["open"]) for r in got] == [(60, 3, -4, 0, False)]
    assert all(r["open"] and r["length"] == 20 for r in S.repeats(odd_docs.where("doc_id in (8, 9, -4)"), depth=20).collect())


def test_nodes_of_common_prefixes():
    import numpy as np

    assert sorted(S.nodes(np.array([2, 5, 5, 1, 3]), 2)) == [(2, 0, 3), (3, 4, 5), (5, 1, 3)]
    assert S.nodes(np.array([], int), 2) == []
