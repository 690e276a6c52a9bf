"""Blocks: documents gathered into rows of a bounded size, written once, and number crunching on their words.

A block row holds the ids and whole texts of some documents. It is written to the shared folder as a bucketed table, so
that what other tasks answer about a block is joined to it without moving the texts. Hashes of words and of runs of
words come from prefix sums over the block's bytes, without a Python object for each word.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.arrow import frugal, full, release  # noqa: F401
from quarry.session import ROW_GROUP, forget, scratch_path

BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 32 << 20  # of texts, in a part and on average in a bucket; so what a task reads does not grow with the input
STRIDE = (1 << 20) + 7  # more than there are tasks, and prime, so that the parts of a task spread over buckets
HASHED = 1 << 18  # bytes that are hashed at once
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_powers: dict = {}


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2 ** 64, and of its inverse."""
    if which not in _powers or len(_powers[which][0]) < n:
        p = _ODD[which]
        inverse = np.uint64(pow(int(p), -1, 1 << 64))
        size = max(1 << n.bit_length(), HASHED << 1)
        with np.errstate(over="ignore"):
            _powers[which] = tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, x, np.uint64)]) for x in (p, inverse))
    a, b = _powers[which]
    return a[:n], b[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads each value over 64 bits; a bijection. One array is kept for steps in between."""
    out = h >> np.uint64(29)
    out ^= h
    out *= np.uint64(0xBF58476D1CE4E5B9)
    part = out >> np.uint64(32)
    out ^= part
    out *= np.uint64(0x94D049BB133111EB)
    np.right_shift(out, np.uint64(29), out=part)
    out ^= part
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes end to end, where each text begins and the end)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (whole[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(texts) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, text number) of every word ``[^\\x20\\x09-\\x0D]+``."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (edge[:-1] | ~np.r_[False, word[:-1]]))
    ends = np.flatnonzero(word & (edge[1:] | ~np.r_[word[1:], False])) + 1
    h, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):  # the bytes of some words at a time: a word's hash doesn't depend on where sums begin
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + HASHED, side="right")))
        first, s, e = starts[at], starts[at:end] - starts[at], ends[at:end] - starts[at]
        power, inverse = _power(0, int(e[-1]) + 1)
        with np.errstate(over="ignore"):
            sums = np.r_[np.uint64(0), np.cumsum(_BYTE[data[first : first + e[-1]]] * power[: e[-1]])]
            h[at:end] = (sums[e] - sums[s]) * inverse[s]
        at = end
    return mix(h), np.searchsorted(offsets, starts, side="right") - 1


def run_sums(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the values, each weighted by its place, and what takes the place out of a difference of two."""
    power, inverse = _power(1, len(h) + 1)
    with np.errstate(over="ignore"):
        return np.r_[np.uint64(0), np.cumsum(h * power[: len(h)])], inverse


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n values; len(h) - n + 1 of them."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    sums, inverse = run_sums(h)
    with np.errstate(over="ignore"):
        return mix((sums[n:] - sums[:-n]) * inverse[: len(h) - n + 1])


def squeeze(a: np.ndarray) -> bytes:
    """An array as bytes: the bytes of equal weight together, compressed."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), 1)


def expand(b: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def squeeze_rows(m: np.ndarray) -> bytes:
    """A matrix, column by column."""
    return squeeze(np.ascontiguousarray(m.T).ravel())


def expand_rows(b: bytes, kind: str, width: int) -> np.ndarray:
    return expand(b, kind).reshape(width, -1).T


def split(values: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    """Where each bucket's values begin, and the end; values are ascending, of so many bits, and buckets are their high ones."""
    return np.searchsorted(values >> np.uint64(bits - (buckets.bit_length() - 1)), np.arange(buckets + 1, dtype=np.uint64)) if buckets > 1 else np.array([0, len(values)])


def squeeze_sorted(a: np.ndarray) -> bytes:
    return squeeze(np.diff(a, prepend=a.dtype.type(0)))


def expand_sorted(b: bytes, kind: str) -> np.ndarray:
    return np.cumsum(expand(b, kind), dtype=kind)


def bucket_hash(v: np.ndarray) -> np.ndarray:
    """Spark's hash of integers, by which bucketBy deals rows."""
    turn = lambda x, n: (x << np.uint32(n)) | (x >> np.uint32(32 - n))
    with np.errstate(over="ignore"):
        h = turn(np.uint32(42) ^ turn(v.astype(np.int32).view(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    return h.view(np.int32)


def part_of(task: int, buckets: int) -> int:
    """A number of the task's own that bucketBy deals to bucket ``task % buckets``, so that tasks spread evenly over buckets."""
    skip, start = task // buckets, 0
    while True:
        some = np.arange(start, start + 2 * buckets + (64 if task < STRIDE else 1 << 16))
        fits = some[bucket_hash(some) % buckets == task % buckets]
        if skip < len(fits):
            return int(fits[skip])
        skip, start = skip - len(fits), int(some[-1]) + 1


def bucket_count(spark: SparkSession, size: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)


def write_bucketed(df: DataFrame, buckets: int, label: str) -> DataFrame:
    """df as a table bucketed by part in the shared folder: joins on part read it without moving it."""
    spark = df.sparkSession
    name, path = f"{label}_{uuid.uuid4().hex}", scratch_path(spark, label)
    df.write.options(path=path, compression="zstd", **ROW_GROUP).bucketBy(buckets, "part").saveAsTable(name)
    table = spark.table(name)
    # The plan knows the files and their buckets; the catalog need not keep the name. The files go with the application.
    spark.sql(f"DROP TABLE {name}")
    forget(spark, path)
    return table


def write_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, whole_rows: bool = False, apart: Column | None = None) -> tuple[DataFrame, int]:
    """(part, block_id, ids, texts and, if asked for, whole rows; the bytes of all texts). A text over block_bytes is a block of its own.

    Rows where apart (a condition on docs) holds don't share blocks with others.
    A part is what one task writes, up to BUCKET_BYTES of texts, and its bucket goes by part: however much a task reads, what is joined
    by part stays small. Parts spread evenly over a number of buckets that follows the bytes. The high half of a block's id is its part.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    buckets, whole, most = bucket_count(spark, size), apart is None, BUCKET_BYTES

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch | None] = [None, None]
        for b in batches:
            for k, rows in enumerate([b] if whole else [b.filter(pc.invert(b.column("apart"))), b.filter(b.column("apart"))]):
                done, left[k] = full(rows, left[k], "text", block_bytes)
                yield from done
        yield from (x for x in left if x is not None)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, taken, nth = 0, 0, TaskContext.get().partitionId()
        part = part_of(nth, buckets)
        for b in runs(batches):
            texts = b.column("text").fill_null("")
            bytes_ = int(text_bytes(texts)[1][-1])
            if made and taken + bytes_ > most:
                made, taken, nth = 0, 0, nth + STRIDE
                part = part_of(nth, buckets)
            listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.concat_arrays([x]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([(part << 32) + made], pa.int64()), listed(b.column("id")), listed(texts), *([listed(b.column("row"))] if whole_rows else [])],
                names=["part", "block_id", "ids", "texts", "rows"][: 4 + whole_rows],
            )
            made, taken = made + 1, taken + bytes_

    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.lit(True).alias(" ")).alias("row")
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *([others] if whole_rows else []), *([] if apart is None else [F.coalesce(apart, F.lit(False)).alias("apart")]))
    return write_bucketed(d.mapInArrow(frugal(gather), _schema(d, whole_rows)), buckets, "blocks"), size


def with_answers(table: DataFrame, told: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The blocks with name: the rows of told about each, as structs of the columns. Only the answers move."""
    part = F.shiftright("block_id", 32).cast("int").alias("part")
    per = told.groupBy(part).agg(F.collect_list(F.struct("block_id", *columns)).alias(name))
    d = table.join(per, "part", "left")
    return d.withColumn(name, F.filter(name, lambda a: a["block_id"] == F.col("block_id")))


def written_answers(told: DataFrame, columns: list[str], sums: list[str], buckets: int) -> DataFrame:
    """(part, block_id, answers, sums): told, moved once to the blocks' buckets and written there; sums are totals of told's columns for each block."""
    d = told.withColumn("part", F.shiftright("block_id", 32).cast("int")).repartition(buckets, "part")
    return write_bucketed(d.groupBy("part", "block_id").agg(F.collect_list(F.struct(*columns)).alias("answers"), *[F.sum(c).alias(c) for c in sums]), buckets, "answers")


def join_answers(table: DataFrame, written: DataFrame, name: str) -> DataFrame:
    """The blocks with name: their answers, joined bucket by bucket. The difference keeps block_id out of the keys, by which the tables aren't dealt."""
    w = written.select(F.col("part").alias("of"), F.col("block_id").alias("to"), F.col("answers").alias(name))
    return table.join(w, (F.col("part") == F.col("of")) & (F.col("block_id") - F.col("to") == 0), "left").drop("of", "to")


def slices(batch: pa.RecordBatch, columns: list[str], most_bytes: int = BLOCK_BYTES // 4) -> Iterator[pa.RecordBatch]:
    """Parts of an Arrow batch whose texts take most_bytes at most, or single rows."""
    size = np.zeros(batch.num_rows + 1, np.int64)
    for c in columns:
        size += text_bytes(batch.column(c))[1]
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, size[at] + most_bytes, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def _schema(d: DataFrame, whole_rows: bool) -> T.StructType:
    out = T.StructType().add("part", T.IntegerType()).add("block_id", T.LongType()).add("ids", T.ArrayType(T.LongType())).add("texts", T.ArrayType(T.StringType()))
    return out.add("rows", T.ArrayType(d.schema["row"].dataType)) if whole_rows else out


def blocks_of(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array, pa.Array]]:
    """(row, ids, texts) of each block in an Arrow batch."""
    for i in range(batch.num_rows):
        yield i, batch.column("ids")[i].values, batch.column("texts")[i].values
