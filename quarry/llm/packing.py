"""Best-fit packing planned over the histogram of piece lengths.

A document is its token ids and then the end id. Documents over ``capacity`` are cut into full pieces, the
remainder first. Only the histogram (at most ``capacity`` counts) comes to the driver, which runs best-fit
decreasing over counts: a plan row puts a run of ranks of one length into consecutive sequences. Pieces then take
their planned slots by their rank within their length. Ranks are taken inside salted parts of a length, so a
length that holds most pieces is still ranked by many tasks.

Defined cases: a null text is empty; an empty document is the end id alone; equal rows are packed as separate
documents; ties within a length go by id, piece and checksum; an empty table gives an empty result; other
columns are ignored whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import blocks as B
from quarry.session import cut

CAPACITY = 1024
END_ID = 2
_PIECES = "id long, piece int, start long, length long, ids_crc32 long"
_encoders: dict = {}


class Encoder:
    """The ids of a byte-level BPE vocabulary. tiktoken reads the same vocabulary as ranks and encodes several
    times faster than the tokenizers library; texts that name a special token go to that library itself."""

    def __init__(self, vocabulary: str, ranks: str) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(ranks), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.fast = tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.path = public_tokenizers.path(vocabulary)
        self.slow = None

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        if "<|endoftext|>" not in text:
            return self.fast.encode_ordinary(text)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow.encode(text, add_special_tokens=False).ids


def encoder(vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> Encoder:
    if (vocabulary, ranks) not in _encoders:
        _encoders[vocabulary, ranks] = Encoder(vocabulary, ranks)
    return _encoders[vocabulary, ranks]


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the remainder first, then full pieces."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 and, if asked for, the piece's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for b in (part for batch in batches for part in B.slices(batch, ["text"])):
            rows, parts = [], []
            for at, text in enumerate(b.column("text").to_pylist()):
                ids = np.array([*encode(text), end_id], "<u4")
                for k, (s, n) in enumerate(cuts(len(ids), capacity)):
                    part = ids[s : s + n]
                    rows.append((at, k, s, n, zlib.crc32(part.tobytes())))
                    if keep_ids:
                        parts.append(part.astype("i4"))
            at, k, s, n, crc = np.array(rows, np.int64).reshape(-1, 5).T
            out = {"id": b.column("id").take(pa.array(at)), "piece": pa.array(k.astype("i4")), "start": pa.array(s), "length": pa.array(n), "ids_crc32": pa.array(crc)}
            yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(parts, pa.list_(pa.int32()))} if keep_ids else {}))

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(B.frugal(run), _PIECES + (", ids array<int>" if keep_ids else ""))


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Plan rows (length, first rank, ranks, first sequence, pieces a sequence, offset) of best-fit decreasing.

    Open sequences are kept as runs (first, how many) by room left, so the work grows with the number of
    different lengths and not with the number of pieces.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}
    plan, opened = [], 0

    def put(length: int, rank: int, left: int, first: int, n: int, room: int) -> int:
        """Fills sequences first .. first + n - 1, each with this room, while pieces are left; returns how many it placed."""
        each = room // length
        full = min(n, left // each)
        if full:
            plan.append((length, rank, full * each, first, each, capacity - room))
            rooms.setdefault(room - each * length, []).append((first, full))
        placed = full * each
        some = left - placed if full < n else 0
        some = min(some, each)
        if some:
            plan.append((length, rank + placed, some, first + full, some, capacity - room))
            rooms.setdefault(room - some * length, []).append((first + full, 1))
            full += 1
        if full < n:
            rooms.setdefault(room, []).append((first + full, n - full))
        return placed + some

    for length in sorted(histogram, reverse=True):
        rank, left = 0, int(histogram[length])
        while left:
            room = min((r for r, runs in rooms.items() if r >= length and runs), default=None)
            if room is None:
                n = -(-left // (capacity // length))
                done = put(length, rank, left, opened, n, capacity)
                opened += n
            else:
                first, n = rooms[room].pop()
                done = put(length, rank, left, first, n, room)
            rank, left = rank + done, left - done
    return np.array(plan, np.int64).reshape(-1, 6)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for) of every piece."""
    spark = docs.sparkSession
    table = cut(pieces(docs, capacity, end_id, id_col, text_col, keep_ids), "pieces")
    histogram = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}
    plan = best_fit(histogram, capacity)
    total = sum(histogram.values())
    part = max(500, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    parts = [-(-histogram.get(n, 0) // part) or 1 for n in range(capacity + 1)]
    salted = table.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32", "start"), F.get(F.lit(parts), F.col("length").cast("int"))))
    # At most total / part + capacity counts, which is at most four for each shuffle partition and one for each length.
    counts = np.array([tuple(r) for r in salted.groupBy("length", "salt").count().collect()], np.int64).reshape(-1, 3)
    counts = counts[np.lexsort((counts[:, 1], counts[:, 0]))]
    before = np.cumsum(counts[:, 2]) - counts[:, 2]
    begins = np.r_[True, counts[1:, 0] != counts[:-1, 0]] if len(counts) else np.zeros(0, bool)
    before = before - before[begins][np.cumsum(begins) - 1] if len(counts) else before
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32", "start")).cast("long") - 1)
    shift = np.int64(1) << 44
    count_key, plan_order = counts[:, 0] * shift + counts[:, 1], np.lexsort((plan[:, 1], plan[:, 0]))
    plan = plan[plan_order]
    plan_key = plan[:, 0] * shift + plan[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, salt, rank = (b.column(c).to_numpy() for c in ("length", "salt", "rank"))
            rank = rank + before[np.searchsorted(count_key, length * shift + salt)]
            p = plan[np.searchsorted(plan_key, length * shift + rank, side="right") - 1]
            at = rank - p[:, 1]
            b = b.drop_columns(["salt", "rank"])
            yield b.append_column("sequence_id", pa.array(p[:, 3] + at // p[:, 4])).append_column("offset", pa.array(p[:, 5] + at % p[:, 4] * length))

    return ranked.mapInArrow(B.frugal(place), _PIECES + (", ids array<int>" if keep_ids else "") + ", sequence_id long, offset long")
