r"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A document is its sequence of shingles of ``width`` words (``[^\x20\x09-\x0D]+``, A-Z lower-cased), each labelled with its
occurrence number. For each of ``bands`` hash functions the sketch samples the ``keep`` smallest labelled shingles and hashes
them in text order, so documents that agree in a band share shingles in the same order. Two documents are linked if a banded
alignment of their sequences has ``common / (n1 + n2 - common)`` of at least ``similarity``; the band is as wide as that allows.

Candidates, without pairs of all members of a bucket: (1) equal word sequences are one vertex; (2) every member of a bucket is
aligned with the bucket's leader, the member with the largest buckets; (3) a member that isn't linked to its leader L can
still be linked to another member m. Both are then known by their differences from L, and their distance is the size of the
symmetric difference of those. So members of one leader are compared in blocks of a bounded size, by counting common differences,
without texts; a pair of blocks gives a spanning forest of its near pairs, which are then aligned. No candidate of a bucket is
lost, whatever its size.
Classes are the connected components of the links.

Defined cases: null and empty texts are one word sequence (none) and so one class; a text of one to ``width - 1`` words is one
shingle; a text of any length is compared whole; equal rows fall into one class; class_id is the smallest id of the class, null if it has none; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import blocks as B
from quarry.session import cut

WIDTH, BANDS, KEEP, SIMILARITY = 5, 20, 4, 0.8
_odd = np.random.Generator(np.random.PCG64(99)).integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labelled shingle hashes in text order, how many each text has, two fingerprints of each text's words)."""
    data, offsets = B.text_bytes(texts)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    h, doc = B.word_hashes(data, offsets)
    n = len(texts)
    words = np.bincount(doc, minlength=n)
    begin = np.cumsum(words) - words
    power, inverse = B._power(1, len(h) + 1)
    with np.errstate(over="ignore"):
        prints = []
        for v in (h, B.mix(h ^ np.uint64(0x5851F42D4C957F2D))):
            sums = np.r_[np.uint64(0), np.cumsum(v * power[: len(v)])]
            prints.append(B.mix((sums[begin + words] - sums[begin]) * inverse[begin] + words.astype(np.uint64)))
    runs = B.run_hashes(h, width)
    at = np.flatnonzero(doc[: len(runs)] == doc[width - 1 :]) if len(runs) else np.zeros(0, np.int64)
    short = np.flatnonzero((words > 0) & (words < width))
    value, owner = np.r_[runs[at], prints[0][short]], np.r_[doc[at], short]
    order = np.argsort(owner, kind="stable")
    value, owner = value[order], owner[order]
    by = np.lexsort((value, owner))
    same = np.r_[False, (value[by][1:] == value[by][:-1]) & (owner[by][1:] == owner[by][:-1])]
    place = np.arange(len(by))
    number = np.empty(len(by), np.uint64)
    number[by] = place - np.maximum.accumulate(np.where(same, 0, place))
    with np.errstate(over="ignore"):
        value = B.mix(value + number * np.uint64(0x9E3779B97F4A7C15))
    return value, np.bincount(owner, minlength=n), np.stack(prints, 1)


def sketch(value: np.ndarray, bands: int, keep: int) -> np.ndarray:
    """Order MinHash of one document: for each band, its smallest shingles hashed in text order."""
    if len(value) > keep:
        with np.errstate(over="ignore"):
            at = np.argpartition(value[None, :] * _odd[:bands, None], keep - 1, axis=1)[:, :keep]
        at.sort(axis=1)
    else:
        at = np.tile(np.arange(len(value)), (bands, 1))
    out = _odd[:bands].copy()
    with np.errstate(over="ignore"):
        for k in range(at.shape[1]):
            out = B.mix(out * np.uint64(0xD6E8FEB86659FD93) + value[at[:, k]])
    return out


def most_apart(n1: int, n2: int, similarity: float) -> int:
    """The most shingles that two linked sequences may not share, both sides together."""
    return math.floor((n1 + n2) * (1 - similarity) / (1 + similarity) + 1e-9)


def aligned(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence whose pairs lie within the band around the diagonal, by bit-parallel rows."""
    lead = 0
    while lead < len(a) and lead < len(b) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[lead : len(a) - tail], b[lead : len(b) - tail]
    if not a or not b:
        return lead + tail
    where: dict[int, list[int]] = {}  # places, not masks: a mask as long as the text for each shingle would be quadratic
    for i, x in enumerate(a):
        where.setdefault(x, []).append(i)
    width = 2 * band + 1
    full = (1 << width) - 1
    low, row, done = -band, full, 0  # bit i of row: column low + i; 0 where the common length steps up
    for j, x in enumerate(b):
        if j:
            done += not row & 1
            row = (row >> 1) | (1 << (width - 1))
            low += 1
        hit = 0
        for i in where.get(x, ()):
            if low <= i < low + width:
                hit |= 1 << (i - low)
        if hit:
            u = row & hit
            row = ((row + u) | (row - u)) & full
    return lead + tail + done + width - row.bit_count()


def compare(a: np.ndarray, b: np.ndarray, similarity: float) -> tuple[bool, list[int], list[int]]:
    """(linked, what only a has, what only b has)."""
    x, y = set(a.tolist()), set(b.tolist())
    only_a, only_b = list(x - y), list(y - x)
    apart = most_apart(len(a), len(b), similarity)
    if len(only_a) + len(only_b) > apart:
        return False, only_a, only_b
    common = aligned(a.tolist(), b.tolist(), apart)
    return len(a) + len(b) - 2 * common <= apart, only_a, only_b


def _sketches(docs: DataFrame, width: int, bands: int, keep: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in B.slices(batch, ["text"])):
            value, n, prints = shingles(b.column("text"), width)
            end = np.cumsum(n)
            rows = [sketch(value[e - k : e], bands, keep).view(np.int64) if k else None for e, k in zip(end, n, strict=True)]
            keys = prints.view(np.uint8).reshape(len(n), 16)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(n), pa.array(rows, pa.list_(pa.int64()))], names=["id", "v", "n", "bands"])

    return docs.mapInArrow(B.frugal(run), "id long, v binary, n long, bands array<long>")


def _texts(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """v, text of the wanted vertices; one of several equal documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in B.slices(batch, ["text"])):
            _, n, prints = shingles(b.column("text"), width)
            keys = prints.view(np.uint8).reshape(len(n), 16)
            yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys], pa.binary()), b.column("text")], names=["v", "text"])

    return docs.select("id", "text").mapInArrow(B.frugal(run), "v binary, text string").join(wanted.hint("merge"), "v", "left_semi").groupBy("v").agg(F.any_value("text").alias("text"))


def _verify(edges: DataFrame, texts: DataFrame, width: int, similarity: float, differences: bool) -> DataFrame:
    """a, b, linked and, if asked for, n_b and what only a and only b have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in B.slices(batch, ["ta", "tb"])):
            (v1, n1, _), (v2, n2, _) = (shingles(b.column(c), width) for c in ("ta", "tb"))
            e1, e2 = np.cumsum(n1), np.cumsum(n2)
            got = [compare(v1[p - k : p], v2[q - m : q], similarity) for p, k, q, m in zip(e1, n1, e2, n2, strict=True)]
            cols = [b.column("a"), b.column("b"), pa.array([g[0] for g in got], pa.bool_())]
            if differences:
                signed = [pa.array([np.array(g[k], np.uint64).view(np.int64) for g in got], pa.list_(pa.int64())) for k in (1, 2)]
                cols += [pa.array(n2), *signed]
            yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "linked", "n_b", "only_a", "only_b"][: len(cols)])

    t = lambda side: texts.select(F.col("v").alias(side), F.col("text").alias("t" + side))
    rows = edges.join(t("a"), "a").join(t("b"), "b").select("a", "b", "ta", "tb")
    return rows.mapInArrow(B.frugal(run), "a binary, b binary, linked boolean" + (", n_b long, only_a array<long>, only_b array<long>" if differences else ""))


def _near(i: list, j: list, similarity: float) -> list[tuple[int, int]]:
    """Pairs of rows (one of i, one of j) whose sequences are near enough by their differences from the same leader.

    A row is (key, linked, length, differences). The symmetric difference of two rows' differences is how far they are apart.
    Common differences are counted for all pairs at once, a bounded number of different ones at a time.
    """
    flat = [np.array(r[3], np.int64) for r in (*i, *j)]
    owner = np.repeat(np.arange(len(flat)), [len(x) for x in flat])
    value, number, times = np.unique(np.concatenate(flat) if flat else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
    often = times > 1
    column = np.cumsum(often) - 1
    keep = often[number]
    owner, place = owner[keep], column[number[keep]]
    common = np.zeros((len(i), len(j)), np.float32)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for start in range(0, int(often.sum()), 4096):
        here = slice(*np.searchsorted(place, [start, start + 4096]))
        m = np.zeros((len(flat), 4096), np.float32)
        m[owner[here], place[here] - start] = 1
        common += m[: len(i)] @ m[len(i) :].T
    size, length = np.array([len(x) for x in flat]), np.array([r[2] for r in (*i, *j)])
    apart = size[: len(i), None] + size[None, len(i) :] - 2 * common
    most = np.floor((length[: len(i), None] + length[None, len(i) :]) * ((1 - similarity) / (1 + similarity)) + 1e-9)
    linked = np.array([r[1] for r in (*i, *j)], bool)
    open_ = ~(linked[: len(i), None] & linked[None, len(i) :])
    return list(zip(*(x.tolist() for x in np.nonzero((apart <= most) & open_)), strict=True))


def _forests(pairs: list[tuple[int, int]], joined: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Up to ``most`` forests of the pairs without common pairs; what is joined is one vertex. The first spans all pairs.

    A pair enters the first forest that it makes no circle in. What is connected in one forest is so in all before it, so
    that forest is found by halving.
    """
    whole: dict[int, int] = {}

    def top(up: dict[int, int], x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = up[x]
        return x

    for x, y in joined:
        whole[top(whole, x)] = top(whole, y)
    ups: list[dict[int, int]] = []
    out = []
    for x, y in pairs:
        p, q = top(whole, x), top(whole, y)
        if p == q:
            continue
        low, high = 0, len(ups)
        while low < high:
            middle = (low + high) // 2
            if top(ups[middle], p) == top(ups[middle], q):
                low = middle + 1
            else:
                high = middle
        if low == most:
            continue
        if low == len(ups):
            ups.append({})
        ups[low][top(ups[low], p)] = top(ups[low], q)
        out.append((x, y))
    return out


def _second_candidates(star: DataFrame, similarity: float, known: DataFrame | None = None, forests: int = 1, block: int = 512) -> DataFrame:
    """Pairs (a, b) of members of one leader that may be linked, where not both are linked to it.

    Members are known by their differences from the leader, so blocks of a bounded number of members are compared without
    texts and without a row for each pair: a block pair gives a spanning forest of its near pairs. With known pairs
    (a, b, linked) only block pairs that hold a refused one are looked at again: what is linked there is one vertex, what was
    refused isn't tried again, and as many forests as asked for are given of the rest.
    """
    # Counted from the table itself, so that the join below can be split where a leader has very many members.
    groups = star.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("k"), F.count_if(~F.col("linked")).alias("f")).where("f > 0").select("b", "k")
    d = star.select("a", "b", "linked", (F.col("n_b") - F.size("only_b") + F.size("only_a")).alias("n"), F.concat("only_a", "only_b").alias("x"))
    d = spread_join(d, groups, "b", "a")
    d = d.withColumn("at", F.pmod(F.xxhash64("a"), F.col("k")).cast("int"))
    left = d.withColumn("j", F.explode(F.sequence("at", F.col("k") - 1))).select("b", F.col("at").alias("i"), "j", "a", "linked", "n", "x", F.lit(None).cast("binary").alias("mate"))
    right = d.withColumn("i", F.explode(F.sequence(F.lit(0), "at"))).select(*[F.col(c).alias(f"r_{n}") for c, n in (("b", "b"), ("i", "i"), ("at", "j"), ("a", "a"), ("linked", "linked"), ("n", "n"), ("x", "x"))])
    if known is not None:
        one = d.select("b", "a", F.col("at").alias("i")).join(known.select("a", F.col("b").alias("mate"), F.col("linked").alias("l")), "a")
        both = one.join(d.select("b", F.col("a").alias("mate"), F.col("at").alias("j")), ["b", "mate"])
        left = left.unionByName(both.select("b", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "a", F.col("l").alias("linked"), F.lit(0).alias("n"), F.array().cast("array<long>").alias("x"), "mate"))

    later = known is not None

    def pairs(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        told, p = p[p["mate"].notna()], p[p["mate"].isna()]
        none = pd.DataFrame([], columns=["a", "b"])
        if not len(p) or not len(q) or (later and told["linked"].all()):
            return none
        i, j = (sorted(zip(t[s + "a"], t[s + "linked"], t[s + "n"], t[s + "x"], strict=True), key=lambda r: r[0]) for t, s in ((p, ""), (q, "r_")))
        same = p["i"].iloc[0] == p["j"].iloc[0]
        # In a block against itself both sides are the same rows.
        rows = i if same else [*i, *j]
        where = {r[0]: k for k, r in enumerate(rows)}
        tried = {(where[a], where[b]): bool(x) for a, b, x in zip(told["a"], told["mate"], told["linked"], strict=True)}
        near = [(x, y if same else len(i) + y) for x, y in _near(i, j, similarity) if not same or x < y]
        near = [(x, y) for x, y in near if (x, y) not in tried and (y, x) not in tried]
        leader = [k for k, r in enumerate(rows) if r[1]]
        joined = [*((leader[0], k) for k in leader[1:]), *(xy for xy, linked in tried.items() if linked)]
        got = [sorted((rows[x][0], rows[y][0])) for x, y in _forests(near, joined, forests)]
        return pd.DataFrame(got, columns=["a", "b"]) if got else none

    return left.groupBy("b", "i", "j").cogroup(right.groupBy("r_b", "r_i", "r_j")).applyInPandas(pairs, "a binary, b binary").distinct()


def spread_join(many: DataFrame, one: DataFrame, key: str, by: str, how: str = "inner", ways: int = 16) -> DataFrame:
    """many joined to one, which has a row for each key: the rows of a hot key in many go to so many tasks, by the column ``by``."""
    salted = many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(ways)).cast("int"))
    return salted.join(one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))), [key, "_salt"], how).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """v, root: the smallest vertex of each vertex's component, by minimum labels and pointer jumping."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    label = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("root"))
    while True:
        label = cut(label, "labels")
        seen = spread_join(both, label.select(F.col("v").alias("b"), "root"), "b", "a").groupBy("a").agg(F.min("root").alias("m"))
        new = label.join(seen, label["v"] == seen["a"]).select("v", "root", F.least("root", "m").alias("near"))
        jump = new.select(F.col("v").alias("near"), F.col("near").alias("far"))
        new = cut(spread_join(new, jump, "near", "v", "left").select("v", "root", F.least("near", F.coalesce("far", "near")).alias("new")), "labels")
        if new.where("new <> root").isEmpty():
            return label
        label = new.select("v", F.col("new").alias("root"))


def _linked(docs: DataFrame, width: int, bands: int, keep: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(id and v of every row, v and root of every vertex that has a link); docs has id and text."""
    rows = cut(_sketches(docs, width, bands, keep), "sketches")
    vertices = rows.where("n > 0").groupBy("v").agg(F.any_value("bands").alias("bands"))
    members = cut(vertices.select("v", F.posexplode("bands").alias("band", "value")), "members")
    # Written, so that the joins with them have a shuffle of their own, which can be split where a bucket is hot.
    size = cut(members.groupBy("band", "value").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "buckets")
    shared = cut(members.join(size, ["band", "value"]), "shared")
    weight = shared.groupBy("v").agg(F.sum("k").alias("w"))
    shared = shared.join(weight, "v")
    lead = cut(shared.groupBy("band", "value").agg(F.max_by("v", F.struct("w", "v")).alias("b")), "leaders")
    edges = cut(shared.join(lead, ["band", "value"]).where("v <> b").select(F.col("v").alias("a"), "b").distinct(), "edges")
    texts = cut(_texts(docs, edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct(), width), "texts")
    star = cut(_verify(edges, texts, width, similarity, True), "star")
    links = star.where("linked").select("a", "b")
    known, forests = cut(_verify(_second_candidates(star, similarity), texts, width, similarity, False), "more"), 64
    new = known
    # Where alignment refuses a near pair, other near pairs of its blocks may link what the forest left to it. The number of
    # forests grows so fast that three more rounds cover all pairs of a block, however many of them are refused.
    while not new.where(~F.col("linked")).isEmpty():
        ends = known.where(~F.col("linked")).select(F.explode(F.array("a", "b")).alias("a")).distinct()
        again = star.join(star.join(ends, "a", "left_semi").select("b").distinct(), "b", "left_semi")
        new = cut(_verify(_second_candidates(again, similarity, known, forests), texts, width, similarity, False), "more")
        known, forests = known.union(new), 64 * forests
    links = links.union(known.where("linked").select("a", "b"))
    return rows.select("id", "v"), components(links)


def _named(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """v, n (rows that hold it) and m, the smallest (none, id, v) of its class, null ids last, for every vertex."""
    low = cut(rows.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "v")).alias("low")), "vertices")
    members = cut(linked.join(low.select("v", "low"), "v"), "members")
    best = members.groupBy("root").agg(F.min("low").alias("m"))
    of_class = spread_join(members.select("v", "root"), best, "root", "v").select("v", "m")
    return low.join(of_class, "v", "left").select("v", "n", F.coalesce("m", "low").alias("m"), F.col("low.id").alias("id"))


def classes(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, keep: int = KEEP, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and class_id of every row."""
    rows, linked = _linked(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), width, bands, keep, similarity)
    named = cut(_named(rows, linked), "classes").withColumn("class_id", F.col("m.id"))
    # A vertex of one row needs no join; the rows of the others meet their class in many tasks each.
    several = spread_join(rows, named.where("n > 1").select("v", "class_id"), "v", "id")
    return named.where("n = 1").select("id", "class_id").unionByName(several.select("id", "class_id"))


def reject(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, keep: int = KEEP, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, all columns, of each class: the one with the smallest id. Equal rows count as one."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    best = _named(*_linked(d.select("id", "text"), width, bands, keep, similarity)).select("m").distinct()
    kind = T.StructType().add("id", T.LongType()).add("v", T.BinaryType()).add(d.schema["row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in B.slices(batch, ["text"])):
            _, n, prints = shingles(b.column("text"), width)
            keys = prints.view(np.uint8).reshape(len(n), 16)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([k.tobytes() for k in keys], pa.binary()), b.column("row")], names=["id", "v", "row"])

    best = best.select(F.col("m.id").alias("best"), F.col("m.v").alias("v"))
    # The id is part of the key, so that copies of a class's first document go to other tasks than it does.
    rows = d.mapInArrow(B.frugal(run), kind).withColumnRenamed("v", "of")
    rows = rows.join(best, (F.col("of") == F.col("v")) & F.col("id").eqNullSafe(F.col("best")))
    return rows.groupBy("v").agg(F.first("row").alias("row")).select("row.*")
