"""Exact inner-product top-k of a table of query vectors over a table of vectors, with bounds.

Vectors are kept in blocks of neighbours, each with its centre, radius and largest norm. No vector of a block can give a query
more than the query's product with the centre plus its norm times the radius. Queries go in groups. Groups meet pages of block
summaries (never the vectors): each query finds its best block, whose k-th best product is its threshold, then the blocks whose
bound reaches it. Only those meet the groups again, with their vectors. No query passes through the driver; k rows for
each query and task move on. The answer is exact whatever the vectors are; how much is left out depends on how they cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import cut, ready

#: Rows of a block, queries of a group, block summaries of a page, and vectors of the sample around which blocks are formed.
BLOCK, GROUP, PAGE, PIVOTS = 1024, 1024, 4096, 256
REGION = 1 << 12
#: Components of a block's vectors, so that a block's row stays small however many dimensions there are.
VALUES = 1 << 17
SLACK = 1e-9

_BLOCKS = "block long, dims int, ids array<bigint>, vectors array<double>, centre array<double>, radius double, norm double"
_FOUND = "qid long, id long, score double"


@dataclass(frozen=True)
class DenseIndex:
    """blocks(block, dims, ids, vectors end to end, centre, radius, norm); a block's vectors have one number of dimensions."""

    blocks: DataFrame


def inner_product(a: Column, b: Column) -> Column:
    """In double precision, as a built-in expression."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _lists(values: list, kind: pa.DataType) -> pa.Array:
    """A list column from arrays, without an object for each value."""
    offsets = np.cumsum([0, *(len(x) for x in values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.zeros(0)]).astype(kind.to_pandas_dtype()), kind))


def _rows(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v, dims of what can be searched: an id, and components of which none is null or not finite."""
    d = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and size(v) > 0")
    return d.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))).withColumn("dims", F.size("v"))


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)


def _same_dims(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose vectors have one number of dimensions, in the order of the rows."""
    dims = b.column("dims").to_numpy()
    edges = np.r_[0, np.flatnonzero(np.diff(dims)) + 1, len(dims)] if len(dims) else np.zeros(1, np.int64)
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        yield b.slice(s, e - s)


def _chain(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in an order in which each is followed by the nearest of those that are left, and numbers for them that jump to the next REGION after a long step."""
    order, left, steps = [0], np.ones(len(p), bool), [0.0]
    while len(order) < len(p):
        left[order[-1]] = False
        far = np.where(left, ((p - p[order[-1]]) ** 2).sum(1), np.inf)
        order.append(int(far.argmin()))
        steps.append(math.sqrt(far.min()))
    long = np.array(steps) > 3 * np.median(steps[1:] or [0.0])
    return p[order], (np.cumsum(long) * REGION + np.arange(len(p))).astype(np.int32)


def _nearest(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The row of p that is nearest to each row of v. Products of BLOCK rows stand at a time."""
    half = (p * p).sum(1) / 2
    return np.concatenate([np.zeros(0, np.int64), *(np.argmax(v[k : k + BLOCK] @ p.T - half, axis=1) for k in range(0, len(v), BLOCK))])


def _together(rows: DataFrame) -> DataFrame:
    """rows, neighbours next to each other: by the nearest of PIVOTS rows, which hashes of ids choose. Ranges, not pivots, go to tasks."""
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
    pivots = {n: _chain(np.array([r["v"] for r in chosen if r["dims"] == n])) for n in {r["dims"] for r in chosen}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in _same_dims(batch)):
            p, number = pivots.get(b.column("dims")[0].as_py(), (None, None))
            near = np.zeros(b.num_rows, np.int32) if p is None else number[_nearest(_matrix(b), p)]
            yield b.append_column("near", pa.array(near))

    d = cut(rows.mapInArrow(run, "id long, v array<double>, dims int, near int"), "vector-rows")
    return d.repartitionByRange("dims", "near", "id").sortWithinPartitions("dims", "near", "id")


def _gathered(rows: DataFrame, limit: int, values: int | None = None) -> DataFrame:
    """Blocks of at most so many rows (and values, if given) of one number of dimensions and one region, from sorted rows. A block of a quarter of that ends where its pivot does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for b in (part for batch in batches for part in _same_dims(batch)):
            v, ids, near = _matrix(b), b.column("id"), b.column("near").to_numpy()
            most = limit if values is None else min(limit, max(1, values // v.shape[1]))
            ends, regions, at = np.r_[np.flatnonzero(np.diff(near)) + 1, len(near)], np.r_[np.flatnonzero(np.diff(near // REGION)) + 1, len(near)], 0
            while at < len(v):
                end = min(int(ends[min(np.searchsorted(ends, at + max(most // 4, 1)), len(ends) - 1)]), int(regions[np.searchsorted(regions, at, side="right")]), at + most)
                part = v[at:end]
                centre = part.mean(0)
                radius, norm = np.sqrt(((part - centre) ** 2).sum(1)).max(), np.sqrt((part * part).sum(1)).max()
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([v.shape[1]], pa.int32()), pa.ListArray.from_arrays(pa.array([0, end - at], pa.int32()), ids.slice(at, end - at)), _lists([part.ravel()], pa.float64()), _lists([centre], pa.float64()), pa.array([radius]), pa.array([norm])], names=[c.split()[0] for c in _BLOCKS.split(", ")])
                at, block = end, block + 1

    return rows.mapInArrow(run, _BLOCKS)


def build(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DenseIndex:
    ready(vectors.sparkSession)
    return DenseIndex(cut(_gathered(_together(_rows(vectors, id_col, vec_col)), BLOCK, VALUES), "vector-blocks"))


def _pages(blocks: DataFrame) -> DataFrame:
    """page, blocks: summaries of at most PAGE blocks; their number follows the number of blocks."""
    n = blocks.count()
    pages = -(-n // PAGE) or 1
    return blocks.groupBy(F.pmod(F.xxhash64("block"), F.lit(pages)).alias("page")).agg(F.collect_list(F.struct("block", "dims", "centre", "radius", "norm")).alias("held")), pages


def _bounds(q: np.ndarray, dims: int, held: pa.StructArray) -> tuple[pa.Array, np.ndarray]:
    """(blocks of this number of dimensions, the most that each query can get from each)."""
    held = held.filter(pc.equal(held.field("dims"), dims))
    if not len(held):
        return held.field("block"), np.zeros((len(q), 0))
    centre = held.field("centre").flatten().to_numpy().reshape(len(held), -1)
    size = np.sqrt((q * q).sum(1))[:, None]
    most = np.minimum(q @ centre.T + size * held.field("radius").to_numpy(), size * held.field("norm").to_numpy())
    return held.field("block"), most + SLACK * (1 + np.abs(most))


def _asked(b: pa.RecordBatch, k: int) -> np.ndarray:
    return b.column("vectors")[k].values.to_numpy().reshape(len(b.column("ids")[k].values), -1)


def _first(groups: DataFrame, pages: DataFrame, n_pages: int) -> DataFrame:
    """grp, at, block: the block with the best bound for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                q = _asked(b, k)
                blocks, most = _bounds(q, b.column("dims")[k].as_py(), b.column("held")[k].values)
                if len(blocks):
                    best = most.argmax(1)
                    yield pa.RecordBatch.from_arrays([pa.repeat(b.column("grp")[k], len(q)), pa.array(np.arange(len(q), dtype=np.int32)), blocks.take(pa.array(best)), pa.array(most[np.arange(len(q)), best])], names=["grp", "at", "block", "bound"])

    met = groups.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_pages - 1).cast("long")))).join(pages, "page")
    each = met.select("grp", "dims", "ids", "vectors", "held").mapInArrow(run, "grp long, at int, block long, bound double")
    return each.groupBy("grp", "at").agg(F.max_by("block", F.struct("bound", "block")).alias("block"))


def _rest(groups: DataFrame, pages: DataFrame, n_pages: int, done: DataFrame) -> DataFrame:
    """grp, block, at, least: the other blocks whose bound reaches the thresholds, with the queries that need them. done: grp, seen (of struct<at, block, least>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                q, seen = _asked(b, k), b.column("seen")[k].values
                blocks, most = _bounds(q, b.column("dims")[k].as_py(), b.column("held")[k].values)
                least, first = np.full(len(q), np.inf), np.full(len(q), -1)
                least[seen.field("at").to_numpy()] = seen.field("least").to_numpy()
                first[seen.field("at").to_numpy()] = seen.field("block").to_numpy()
                wanted = (most >= least[:, None]) & (blocks.to_numpy()[None, :] != first[:, None])
                for j in np.flatnonzero(wanted.any(0)):
                    at = np.flatnonzero(wanted[:, j])
                    yield pa.RecordBatch.from_arrays([b.column("grp").slice(k, 1), blocks.slice(j, 1), _lists([at], pa.int32()), _lists([least[at]], pa.float64())], names=["grp", "block", "at", "least"])

    met = groups.join(done, "grp").withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_pages - 1).cast("long")))).join(pages, "page")
    return met.select("grp", "dims", "ids", "vectors", "seen", "held").mapInArrow(run, "grp long, block long, at array<int>, least array<double>")


def _products(pairs: DataFrame, groups: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """grp, at and _FOUND: the k best of each query of pairs(grp, block, at, least) in its block, as the final ranking orders them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                at = b.column("at")[row].values.to_numpy()
                ids = b.column("ids")[row].values
                v = b.column("vectors")[row].values.to_numpy().reshape(len(ids), -1)
                q = b.column("q_vectors")[row].values.to_numpy().reshape(-1, v.shape[1])[at]
                score = q @ v.T
                near = np.round(score, 9)
                take = min(k, len(ids))
                kth = -np.partition(-near, take - 1, axis=1)[:, take - 1]
                keep = (near >= kth[:, None]) & (score >= b.column("least")[row].values.to_numpy()[:, None] - SLACK)
                for i in np.flatnonzero(keep.sum(1) > k):  # ties at the last place
                    some = np.flatnonzero(keep[i])
                    keep[i, some[np.lexsort((ids.to_numpy()[some], -near[i, some]))[k:]]] = False
                i, j = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.repeat(b.column("grp")[row], len(i)), pa.array(at[i].astype(np.int32)), b.column("q_ids")[row].values.take(pa.array(at[i])), ids.take(pa.array(j)), pa.array(score[i, j])], names=["grp", "at", "qid", "id", "score"])

    asked = groups.select("grp", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    d = pairs.join(blocks.select("block", "ids", "vectors"), "block").join(asked, "grp")
    return d.select("grp", "at", "least", "ids", "vectors", "q_ids", "q_vectors").mapInArrow(run, "grp long, at int, " + _FOUND)


def search(vectors: DataFrame | DenseIndex, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """qid, id, score, dense_rank. queries: qid, embedding. vectors: a table, or the index of one.

    Ties go to the smaller id. Vectors and queries without an id, or with null or non-finite components, take no part; a query
    finds only vectors of its own number of dimensions.
    """
    ready(queries.sparkSession)
    index = vectors if isinstance(vectors, DenseIndex) else build(vectors, id_col, vec_col)
    groups = cut(_gathered(_together(_rows(queries, "qid", "embedding")), GROUP).select(F.col("block").alias("grp"), "dims", "ids", "vectors"), "query-groups")
    pages, n_pages = _pages(index.blocks)
    pages = cut(pages, "block-pages")
    first = cut(_first(groups, pages, n_pages), "first-blocks")
    pairs = first.groupBy("grp", "block").agg(F.array_sort(F.collect_list("at")).alias("at")).withColumn("least", F.transform("at", lambda x: F.lit(float("-inf"))))
    found = cut(_products(pairs, groups, index.blocks, k), "first-products")
    least = found.groupBy("grp", "at").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("least"))
    done = first.join(least, ["grp", "at"]).groupBy("grp").agg(F.collect_list(F.struct("at", "block", "least")).alias("seen"))
    rest = cut(_rest(groups, pages, n_pages, done), "block-pairs")
    if rest.take(1):
        found = found.unionByName(_products(rest, groups, index.blocks, k))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "id"))
    return found.select("qid", "id", "score").withColumn("dense_rank", rank).where(F.col("dense_rank") <= k)


def search_one(vectors: DataFrame, query: list[float], k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One query without Python on the executors; Spark keeps k rows for each task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(id_col).alias("id"), inner_product(F.col(vec_col), q).alias("score")).orderBy(F.desc("score"), "id").limit(k)
