import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import chat, queries

ODD = ["", "\\", "###", "####", "</turn>", "<</turn>", "\\### Assistant: </turn> ok", "a\n### user: x</turn>\n", "é 日本 😀", ":", "\\\\</turn>\\"]


def _sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append(((turn is not None, turn or 0), (role is not None, (role or "").encode()), (text is not None, (text or "").encode()), role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort(key=lambda x: x[:3])
        esc = lambda x: x.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")
        learned = "".join(t for *_, r, t in turns if r == "assistant")
        size = sum(len(f"### {esc(r).replace(':', chr(92) + ':')}: {esc(t)}</turn>\n") for *_, r, t in turns)
        out.append((conv, len(turns), _sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(learned), _sha(learned), size))
    return sorted(map(str, out))


def _got(rows, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *a: rows)
    return sorted(str(tuple(r)) for r in queries.op12_reply_trees(rows.sparkSession, "").collect())


SAID = "\\### Assistant: </turn> ok"
MORE = [(-7, 0, "user", SAID), (-7, 1, "assistant", SAID)]


def test_odd_conversations(spark, monkeypatch):
    r = random.Random(2)
    rows = [(r.choice([1, 2, 3, None]), r.choice([0, 1, 2, 3, None]), r.choice(["user", "assistant", "a:b\\", None, ""]), r.choice([*ODD, None])) for _ in range(150)]
    rows += [(9, k, "assistant" if k % 2 else "user", f"turn {k} {ODD[k % len(ODD)]}") for k in range(700)] + [(10, 0, "user", "x" * 600_000)]
    d = spark.createDataFrame([(*x, "s", 1, "k", 2) for x in rows], "conv_id long, turn long, role string, text string, path string, segment int, key string, pos int")
    assert _got(d, monkeypatch) == brute([*rows, *MORE])
    assert _got(d.where("1 = 0"), monkeypatch) == brute(MORE)


def test_whole_table(spark, monkeypatch):
    d = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert _got(d, monkeypatch) == brute([*map(tuple, d.select("conv_id", "turn", "role", "text").collect()), *MORE])


def test_segments_are_bounded_and_whole(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", ODD[k % len(ODD)] * 3) for k in range(300)]
    d = chat.formatted(chat.paths(chat.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))), segment_chars=200).orderBy("segment").collect()
    assert len(d) > 20 and all(len(x["formatted"]) <= 200 for x in d if len(x["spans"]) > 1)
    assert [t for x in d for t in chat.turns_of(x["formatted"])] == [(r, t) for _, _, r, t in rows]
    assert [chat.unescaped(x["formatted"][s["start"] : s["start"] + s["length"]]) for x in d for s in x["spans"] if s["loss"]] == [t for _, _, r, t in rows if r == "assistant"]


MESSAGES = "conv_id long, id long, parent_id long, role string, text string, score double"


def _paths(rows, top=None):
    """(conv, rank, texts) by walking up from every leaf; ids are unique within a conversation and there are no cycles."""
    by = {(c, i): (p, t, s or 0.0) for c, i, p, _, t, s in rows}
    answered = {(c, p) for c, _, p, *_ in rows}
    out = defaultdict(list)
    for c, i, *_ in rows:
        if (c, i) not in answered:
            texts, total, at = [], 0.0, (c, i)
            while at in by:
                p, t, s = by[at]
                texts.append(t)
                total += s
                at = (c, p)
            out[c].append((-total, i, texts[::-1]))
    return sorted((c, k + 1, texts) for c, leaves in out.items() for k, (_, _, texts) in enumerate(sorted(leaves)[:top]))


@pytest.mark.parametrize("top", [None, 2])
def test_branches_by_score(spark, top):
    r = random.Random(5)
    rows = [(c, i, r.randrange(max(0, i - 9), i) if i and r.random() > 0.05 else r.choice([None, 10_000]), "user", f"{c}/{i}", r.choice([None, 0.5, -0.25, 1.0])) for c in (1, 2) for i in range(60)]
    rows += [(3, i, i - 1 if i else None, "user", f"3/{i}", 0.0) for i in range(70)]
    got = defaultdict(list)
    for x in chat.paths(chat.replies(spark.createDataFrame(rows, MESSAGES)), top).collect():
        got[x["conv"], x["rank"]].append((x["pos"], x["text"]))
    assert sorted((c, k, [t for _, t in sorted(v)]) for (c, k), v in got.items()) == _paths(rows, top)


def test_cycles_repeats_and_empty(spark):
    rows = [(1, 5, 7, "u", "e", 0.0), (1, 6, 5, "u", "f", 0.0), (1, 7, 6, "u", "g", 0.0), (1, 2, 7, "u", "b", 0.0), (2, 1, 1, "u", "self", 0.0), (3, 1, None, "u", "twice", 0.0), (3, 1, None, "u", "twice", 0.0), (3, 2, 1, "u", "answer", 0.0), (None, None, None, None, None, None)]
    d = spark.createDataFrame(rows, MESSAGES)
    got = defaultdict(list)
    for x in chat.paths(chat.replies(d)).collect():
        got[x["conv"], x["path"]].append((x["pos"], x["text"]))
    assert sorted(([t for _, t in sorted(v)] for v in got.values()), key=str) == sorted([["e", "f", "g", "b"], ["self"], ["twice"], ["twice", "answer"], [None]], key=str)
    assert chat.formatted(chat.paths(chat.replies(d.where("1 = 0")))).count() == 0
