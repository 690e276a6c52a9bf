import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from quarry.llm import quality as Q
from quarry.llm import sharding as H
from quarry.llm import url_filter as U


def test_shards_are_a_permutation_with_equal_counts(spark, odd_docs, no_docs):
    big = odd_docs.unionByName(spark.range(1000).select((F.col("id") % 7).alias("doc_id"), F.lit("same text").alias("text"), *[F.col(f"`{c}`") for c in []]), allowMissingColumns=True)
    got = H.plan_shards(big, 40, bucket_bytes=4000).toPandas()
    assert len(got) == big.count()
    n = got.groupby("shard").size()
    assert n.max() - n.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in big.collect())
    assert Counter((None if i != i else int(i), s, c) for i, s, c in zip(got.id, got["size"], got.text_crc32, strict=True)) == want
    same = lambda d: sorted(map(str, H.plan_shards(d, 40, bucket_bytes=4000).collect()))
    assert same(big) == same(big.repartition(7))
    assert H.plan_shards(no_docs).count() == 0
    order = got.sort_values(["slot", "shard"]).id.fillna(-1).tolist()
    assert order != sorted(order)


def test_written_shards_hold_every_record(spark, odd_docs, tmp_path):
    path = f"file://{tmp_path}/shards"
    H.write_shards(odd_docs, path, 3)
    back = spark.read.parquet(path)
    assert sorted(map(str, (r["record"] for r in back.collect()))) == sorted(map(str, odd_docs.collect()))
    assert sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [5, 6, 6]


def test_buckets_that_op9_deals_from_hold_every_record(spark, odd_docs, monkeypatch):
    seen, cut = {}, H.cut
    monkeypatch.setattr(H, "cut", lambda d, name: seen.setdefault(name, cut(d, name)))
    big = odd_docs.unionByName(odd_docs)
    plan = H.plan_shards(big, 3, bucket_bytes=4000).collect()
    held = seen["shard-buckets"].select("_bucket", "_pos", "_record.*").orderBy("_bucket", "_pos").collect()
    assert sorted(str(r[2:]) for r in held) == sorted(str(tuple(r)) for r in big.collect())
    dealt = [(r["id"], r["text_crc32"]) for r in sorted(plan, key=lambda r: (r["slot"], r["shard"]))]
    assert dealt == [(r["doc_id"], zlib.crc32((r["text"] or "").encode())) for r in held]


def test_urls(spark):
    rules = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"))
    rows = [
        (1, "HTTP://WWW.Example.COM/en/x?casino", "allow"), (2, "http://a.example.com/en/", "block"), (3, "http://a.example.com/de/", "allow"), (4, "http://myexample.com/en/", "allow"), (5, "http://x.org/free-porn/", "block"), (6, "http://x.org/pornographer", "allow"),
        (7, "http://x.org/free/win", "block"), (8, "http://x.org/free/free", "allow"), (9, None, "allow"), (10, "", "allow"), (11, "no scheme casino free", "block"), (12, "http://example.com", "allow"), (13, "http://x.org/xxx", "block"), (14, "http://x.org/" + "a" * 50_000, "allow"), (14, "http://x.org/" + "a" * 50_000, "allow"),
    ]
    d = spark.createDataFrame([(i, u, "h") for i, u, _ in rows], "page_id long, url string, host string")
    got = sorted((r["id"], r["verdict"]) for r in U.filter_urls(d, rules).collect())
    assert got == sorted((i, v) for i, _, v in rows)
    assert [(r["host"], r["path"]) for r in U.filter_urls(d.where("page_id in (1, 9)"), rules).orderBy("id").collect()] == [("www.example.com", "/en/x"), ("", "")]
    assert U.filter_urls(d.where("1 = 0"), rules).count() == 0


def _brute(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if any(ch not in " \t\n\x0b\f\r" for ch in x)]
    return len(w), sum(map(len, w)), sum((text or "").count(s) for s in Q.SYMBOLS), len(lines) - len(set(lines)), len(covered)


def test_statistics_against_brute_force(spark, odd_docs, no_docs):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("abc#") for _ in range(r.randint(0, 60))) + "\n" * r.randint(0, 2)) for i in range(80)]
    for d in (spark.createDataFrame(rows, "doc_id long, text string"), odd_docs):
        got = sorted(tuple(x) for x in Q.measure(d).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
        assert got == sorted((t or "", *_brute(t)) for _, t in ((x["doc_id"], x["text"]) for x in d.collect()))
    assert Q.cascade(no_docs).count() == 0 and Q.reject(odd_docs).columns == odd_docs.columns


def test_cascade_keeps_prose_whatever_the_order(spark):
    prose = " ".join(f"word{i} and then" for i in range(40))
    rows = [(1, prose), (2, "# $ % & " * 30 + prose), (3, "1234 5678 " * 40), (4, "SHOUT LOUD " + " ".join(f"XY{chr(65 + i % 26)}{chr(65 + i // 26)}" for i in range(90))), (5, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kept = lambda rules: {r["id"] for r in Q.cascade(d, rules).where("kept").collect()}
    assert kept(Q.RULES) == kept(Q.RULES[::-1]) == {1}


def test_rules_are_ordered_by_rejections_per_cost(spark, no_docs):
    text = " ".join(f"word{i} and then" for i in range(400))
    d = spark.createDataFrame([(i, ("bad " if i % 2 else "good ") + text) for i in range(400)], "doc_id long, text string")
    slow = Q.Rule("slow", lambda t, s: F.length(F.regexp_replace(F.regexp_replace(F.reverse(t), "[aeiou]+", "xx"), "(x+)y?", "$1$1")) * F.when(t.startswith("bad"), 1).otherwise(0) > 0)
    fast = Q.Rule("fast", lambda t, s: t.startswith("bad"))
    never = Q.Rule("never", lambda t, s: s["n_words"] < 0)
    rare = Q.Rule("rare", lambda t, s: t.startswith("bad") & (s["n_words"] < 0))
    for rules in ([slow, fast, never], [never, slow, fast]):
        order = Q.order_rules(d, rules)
        assert [r.name for r, _, _ in order] == ["fast", "slow", "never"] and [s for _, _, s in order] == [0.5, 0.5, 0]
    assert Q.order_rules(d, [never, rare])[0][0].name == "never" and len(Q.order_rules(no_docs)) == len(Q.RULES)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert len({tuple(r.name for r, _, _ in Q.order_rules(docs)) for _ in range(2)}) == 1


def test_rejected_rows_are_those_that_fail(spark, odd_docs, no_docs):
    kept = {r["id"] for r in Q.cascade(odd_docs).where("kept").collect()}
    rows = Q.reject(odd_docs)
    assert sorted(map(str, rows.collect())) == sorted(str(r) for r in odd_docs.collect() if r["doc_id"] in kept) and Q.reject(no_docs).count() == 0
