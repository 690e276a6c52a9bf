"""Approximate nearest neighbours by learned partitions, largest inner product first.

A bounded sample of vectors (``sample_rows``) gives a neighbour graph, which is cut into equal parts with few
crossing edges. A small network learns from each sampled vector the parts of its neighbours. It then assigns every
vector to one part, and each query to its most probable parts until their probabilities add up to a threshold, the least that
reaches ``recall`` against brute force on the sample: a query inside a cluster probes few parts, one between clusters many.
The number of parts grows with the square root of the number of vectors, as far as the sample can teach them. A query
whose parts hold fewer than ``k`` candidates probes all the others too. Every vector is indexed. Parts are searched in blocks of a
bounded size, so a part that holds a third of all vectors is many blocks; scores are taken again in double precision.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows with a null id
or another dimension than most; equal scores go to the smaller id; a row never finds its own id; with fewer than ``k``
candidates the query gets all of them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import cut


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id and v (double components) of the rows that take part."""
    d = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return d.where("id is not null and size(v) > 0").where(F.forall("v", finite) & F.exists("v", lambda x: x != 0))


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """Parts of nearly equal size with few graph edges between them: recursive median cuts, then moves by gain."""
    at = np.zeros(len(x), np.int64)
    for step in range(parts.bit_length() - 1):
        new = at * 2
        for p in range(1 << step):
            rows = np.flatnonzero(at == p)
            if len(rows):
                y = x[rows] - x[rows].mean(0)
                side = y @ np.linalg.svd(y, full_matrices=False)[2][0]
                new[rows[np.argsort(side, kind="stable")[len(rows) // 2 :]]] += 1
        at = new
    edges = np.r_[np.c_[np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()], np.c_[graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])]]
    limit = int(np.ceil(slack * len(x) / parts))
    rng, everyone = np.random.default_rng(3), np.arange(len(x))
    for _ in range(rounds):
        links = np.zeros((len(x), parts))
        np.add.at(links, (edges[:, 0], at[edges[:, 1]]), 1)
        to = links.argmax(1)
        gain = links[everyone, to] - links[everyone, at]
        movers = np.flatnonzero((gain > 0) & (rng.random(len(x)) < 0.5))
        size = np.bincount(at, minlength=parts)
        for i in movers[np.argsort(-gain[movers], kind="stable")]:
            if size[to[i]] < limit:
                size[at[i]] -= 1
                size[to[i]] += 1
                at[i] = to[i]
    return at


class Router:
    """Softmax over parts from a network with one hidden layer."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 96, steps: int = 600) -> None:
        rng = np.random.default_rng(5)
        sizes = [(x.shape[1], hidden), (hidden, target.shape[1])]
        self.w = [rng.normal(0, (2 / a) ** 0.5, (a, b)) for a, b in sizes]
        self.b = [np.zeros(b) for _, b in sizes]
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in [*self.w, *self.b]]
        for t in range(1, steps + 1):
            rows = rng.integers(0, len(x), min(512, len(x)))
            h = np.maximum(x[rows] @ self.w[0] + self.b[0], 0)
            d = (self._soft(h @ self.w[1] + self.b[1]) - target[rows]) / len(rows)
            back = (d @ self.w[1].T) * (h > 0)
            grads = [x[rows].T @ back + 1e-4 * self.w[0], h.T @ d + 1e-4 * self.w[1], back.sum(0), d.sum(0)]
            for p, g, m in zip([*self.w, *self.b], grads, moments, strict=True):
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.999 * m[1] + 0.001 * g * g
                p -= 0.01 * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8)

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return self._soft(np.maximum(x @ self.w[0] + self.b[0], 0) @ self.w[1] + self.b[1])


def probed(p: np.ndarray, threshold: float) -> np.ndarray:
    """How many of its most probable parts each row probes: until their probabilities reach the threshold."""
    before = np.cumsum(-np.sort(-p, axis=1), axis=1)
    return np.minimum((before < threshold - 1e-12).sum(1) + 1, p.shape[1])


def learn(sample: np.ndarray, parts: int, recall: float, k: int) -> tuple[Router, float]:
    """The router, and the threshold of probability that it has to reach for this recall on the sample."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    k = min(k, len(sample) - 1)
    graph = neighbours(unit, k)
    at = balanced_parts(unit, graph, parts)
    target = np.zeros((len(sample), parts))
    np.add.at(target, (np.repeat(np.arange(len(sample)), k), at[graph].ravel()), 1 / k)
    half = np.random.default_rng(9).permutation(len(sample))
    asked, taught = half[: len(half) // 4], half[len(half) // 4 :]
    router = Router(unit[taught], target[taught])
    p = router(sample)
    assigned = p.argmax(1)
    place = np.argsort(np.argsort(-p[asked], axis=1), axis=1)
    true = neighbours(sample, k)[asked]
    where = np.take_along_axis(place, assigned[true], 1)
    for threshold in (0.3, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.925, 0.95, 0.97, 0.98, 0.99, 0.995):
        if (where < probed(p[asked], threshold)[:, None]).mean() >= recall:
            return router, threshold
    return router, 1.0


def block_top(qi: np.ndarray, q: np.ndarray, ci: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, scores) of each query's k best in a block. Equal vectors are scored once, so ties are exact."""
    unique, which = np.unique(c, axis=0, return_inverse=True)
    order = np.lexsort((ci, which.ravel()))
    start = np.r_[0, np.cumsum(np.bincount(which.ravel(), minlength=len(unique)))]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    take = min(k + 1, len(unique))
    # A slice of the queries at a time bounds the matrix of scores.
    for i, row in ((a + j, row) for a in range(0, len(q), 512) for j, row in enumerate(q[a : a + 512] @ unique.T)):
        least = np.partition(row, len(row) - take)[len(row) - take]
        some = np.flatnonzero(row >= least - 1e-9 * max(1.0, abs(least)))
        score = (unique[some] * q[i]).sum(1)
        ids = [order[start[u] : start[u + 1]][: k + 1] for u in some]
        found = ci[np.concatenate(ids)]
        each = np.repeat(score, [len(x) for x in ids])
        keep = found != qi[i]
        found, each = found[keep], each[keep]
        best = np.lexsort((found, -each))[:k]
        out.append((np.full(len(best), qi[i]), found[best], each[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def search(vectors: DataFrame, is_query: Column, k: int = 20, parts: int | None = None, recall: float = 0.95, sample_rows: int = 4096, block: int = 2048, query_block: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding", exact: bool = False) -> DataFrame:
    """query_id, rank, id, score. is_query: of the column ``id``. exact: probe every part, for measuring recall."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    dims = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    rows = rows.where(F.size("v") == dims["n"])
    # A share of the hash range about twice as large as needed is sorted, so little comes to the driver at any size.
    share = max(1, min(1 << 30, (2 * sample_rows << 30) // dims["count"]))
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share).orderBy(F.xxhash64("id"), "id").limit(sample_rows).toPandas()
    sample = np.unique(np.array(chosen["v"].tolist()), axis=0)
    parts = parts or 1 << max(1, round(math.log2(dims["count"] ** 0.5 / 2)))
    while parts > 1 and len(sample) < 16 * parts:
        parts //= 2
    router, threshold = learn(sample, parts, recall, k) if parts > 1 else (None, 1.0)
    threshold = math.inf if exact else threshold

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            v = b.column("v").flatten().to_numpy().reshape(n, -1)
            asked = b.column("asked").to_numpy(zero_copy_only=False)
            p = router(v) if router else np.ones((n, 1))
            order, most = np.argsort(-p, axis=1, kind="stable").astype("i4"), probed(p, threshold)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(order[:, 0]), pa.array([o[:m] if a else None for o, m, a in zip(order, most, asked, strict=True)], pa.list_(pa.int32()))], names=["id", "v", "part", "probe"])

    placed = cut(rows.withColumn("asked", is_query).mapInArrow(assign, "id long, v array<double>, part int, probe array<int>"), "ann")
    size = lambda d, of: {r["part"]: -(-r["count"] // of) for r in d.groupBy("part").count().collect()}
    blocks = size(placed, block)
    within = lambda counts: F.get(F.lit([counts.get(p, 0) or 1 for p in range(parts)]), "part").cast("int")
    number = lambda counts, salt: F.pmod(F.xxhash64(F.lit(salt), "id", "v"), within(counts)).cast("int")
    every = lambda counts: F.explode(F.sequence(F.lit(0), within(counts) - 1))

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        got = block_top(q["id"].to_numpy(), np.array(q["v"].tolist()), c["id"].to_numpy(), np.array(c["v"].tolist()), k) if len(q) and len(c) else ((), (), ())
        return pd.DataFrame(dict(zip(("query_id", "id", "score"), got, strict=True))).astype({"query_id": "int64", "id": "int64", "score": "float64"})

    def nearest(asked: DataFrame) -> DataFrame:
        """The best k in each block that the queries (id, v, part) probe."""
        keys, groups = ["part", "c", "g"], size(asked, query_block)
        there = placed.select("id", "v", "part", number(blocks, 1).alias("c")).withColumn("g", every(groups))
        askers = asked.select("id", "v", "part", number(groups, 2).alias("g")).withColumn("c", every(blocks))
        return askers.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInPandas(best, "query_id long, id long, score double")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")

    queries = placed.where("probe is not null")
    got = cut(ranked(nearest(queries.select("id", "v", F.explode("probe").alias("part")))), "found")
    full = got.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = queries.where(F.size("probe") < parts).join(full, "id", "left_anti")
    if short.isEmpty():
        return got
    rest = F.explode(F.array_except(F.lit(list(range(parts))).cast("array<int>"), "probe")).alias("part")
    again = nearest(short.select("id", "v", rest))
    return ranked(got.select("query_id", "id", "score").unionByName(again))
