"""BM25 over blocks of documents: postings, document and term statistics, and exact top-k for a table of questions.

A block holds the postings of some documents, by term, with offsets instead of ids, as two binary values: Spark hands them on
without looking at each number. Where groups of questions meet a block, only their terms are taken from it. The most that each of these can give
any document of the block, summed over a question's terms, is the question's bound for the block. The block with the best bound gives
each question a threshold (its k-th best score there), then only blocks whose bound reaches the threshold are scored. Inside a block the terms
that cannot reach the threshold together are looked up only for documents that the other terms leave in the race. What moves is a
bound for each question and block, the questions' terms, and k rows for each question and task, never a row for each question and document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.arrow import edges, filled, frugal
from quarry.functions import text as X
from quarry.session import cut, ready

K1, B, EPSILON = 1.5, 0.75, 0.25
BLOCK_DOCS, BLOCK_BYTES = 2048, 4 << 20
#: Questions that a block is scored for at once.
GROUP = 512
#: Postings, and cells of questions and documents, that are scored at once.
CELLS = 1 << 20
#: Terms whose counts a task adds up before it hands them on, and terms of a row that it hands on.
MERGED, HANDED = 1 << 20, 1 << 12
#: Scores that differ by less count as equal where a bound decides.
SLACK = 1e-8

_BLOCKS = "block long, ids array<bigint>, lengths array<int>, vocabulary binary, postings binary"
_LISTS = "block long, ids array<bigint>, lengths array<int>, terms array<string>, ends array<int>, docs array<int>, tf array<int>"
_STOPS = pa.array(X.STOP_WORDS)
#: Bytes of words, in lower case; 0 for all others. Of other characters two have such a letter in lower case.
_LOWER = np.zeros(256, np.uint8)
_LOWER[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = list(b"abcdefghijklmnopqrstuvwxyz0123456789")
_LOWER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = list(b"abcdefghijklmnopqrstuvwxyz")
_LOWERED = "\u0130".encode(), "\u212a".encode()
_names = lambda schema: [c.split()[0] for c in schema.split(", ")]


@dataclass(frozen=True)
class SparseIndex:
    """packed (blocks as gather makes them), terms(term, df, idf), corpus(n, avgdl), one row, and dead(block, dead): offsets of documents that are no more."""

    packed: DataFrame
    terms: DataFrame
    corpus: DataFrame
    dead: DataFrame | None = None

    @property
    def blocks(self) -> DataFrame:
        """The blocks with their terms and postings as arrays, for a look at them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(b.num_rows):
                    held = _Block(b, k, 1.0)
                    lists = [_single(held.terms), *[_single(pa.array(x, pa.int32())) for x in (held.ends, held.docs, held.tf)]]
                    yield pa.RecordBatch.from_arrays([*(b.column(c).slice(k, 1) for c in ("block", "ids", "lengths")), *lists], names=_names(_LISTS))

        return self.packed.mapInArrow(frugal(run), _LISTS)

    @property
    def postings(self) -> DataFrame:
        """term, id, tf, dl, without those of dead documents."""
        return postings(self.packed, self.dead)


def _single(values: pa.Array) -> pa.ListArray:
    """A list column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _pack(**columns: pa.Array | np.ndarray) -> pa.Array:
    """A binary column of one row, which holds arrays of one length."""
    b = pa.record_batch({k: x if isinstance(x, pa.Array) else pa.array(x) for k, x in columns.items()})
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, b.schema) as writer:
        writer.write_batch(b)
    return pa.array([out.getvalue().to_pybytes()], pa.binary())


def _unpack(value: pa.BinaryScalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(value.as_buffer()).read_next_batch()


def impact(tf, length, avgdl):
    """What one occurrence list gives a document, without the term's weight. Columns or arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avgdl))


def gather(docs: DataFrame, segment: int = 0) -> DataFrame:
    """Blocks of docs(id, text), in the order and partitions in which they come; nothing is shuffled. segment keeps block numbers apart.

    Tokens are those of functions.text.tokens, taken here since the words of a block are then coded, cleared of stop words and counted as arrays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = (segment << 48) | (TaskContext.get().partitionId() << 24)
        for b in filled(batches, "text", BLOCK_BYTES, BLOCK_DOCS):
            n, (words, own) = b.num_rows, _words(b.column("text").fill_null(""))
            doc = np.repeat(np.arange(n), own)
            coded = words.dictionary_encode().combine_chunks()
            del words
            code, kept = coded.indices.to_numpy().astype(np.int64), ~pc.is_in(coded.dictionary, value_set=_STOPS).to_numpy(zero_copy_only=False)
            doc, code = doc[kept[code]], (np.cumsum(kept) - 1)[code[kept[code]]]
            key = code * n + doc
            key, tf = np.unique(key.astype(np.int32) if kept.sum() * n < 1 << 31 else key, return_counts=True)
            term, docs = np.divmod(key, n)
            ends = np.cumsum(np.bincount(term, minlength=int(kept.sum()))).astype(np.int32)
            # Steps from one offset to the next, in the narrowest numbers that hold an offset: sums that overflow come back to it.
            steps, most = np.min_scalar_type(n), np.min_scalar_type(tf.max(initial=0))
            held = _pack(terms=coded.dictionary.filter(pa.array(kept)), ends=ends), _pack(steps=np.diff(docs.astype(steps), prepend=steps.type(0)), tf=tf.astype(most))
            lists = _single(b.column("id").cast(pa.int64())), _single(pa.array(np.bincount(doc, minlength=n), pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([block]), *lists, *held], names=_names(_BLOCKS))
            block += 1

    return docs.mapInArrow(frugal(run), _BLOCKS)


def _words(texts: pa.Array) -> tuple[pa.ChunkedArray, np.ndarray]:
    """(all words of the texts end to end, how many each text has), from the bytes of one part of the texts at a time."""
    words, own = [], [np.zeros(0, np.int64)]
    for at, end in edges(texts):
        part = texts.slice(at, end - at).cast(pa.large_string())
        begins, data = _bytes(part)
        raw = data.tobytes()
        if any(x in raw for x in _LOWERED):
            begins, data = _bytes(pa.array([t.lower() for t in part.to_pylist()], pa.large_string()))
        low = _LOWER[data]
        inside = low != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        new = begins[begins < len(data)]
        first[new] = inside[new]
        own.append(np.diff(np.searchsorted(np.flatnonzero(first), np.r_[begins, len(data)])))
        low, ends = low[inside], np.r_[np.flatnonzero(first[inside]), inside.sum()].astype(np.int32)
        words.append(pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(low)))
    return pa.chunked_array(words, pa.string()), np.concatenate(own)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(where each text begins, the bytes of all)."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return at[:-1] - at[0], np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]


def document_counts(blocks: DataFrame) -> DataFrame:
    """term, df: in how many documents of the blocks each term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for v in (_unpack(x) for b in batches for x in b.column("vocabulary")):
            held.append(pa.table({"term": v.column("terms"), "n": np.diff(v.column("ends").to_numpy(), prepend=0).astype(np.int64)}))
            if sum(len(x) for x in held) > MERGED:
                held = [_added(held)]
                if len(held[0]) > MERGED // 2:
                    yield from _handed(held.pop())
        if held:
            yield from _handed(_added(held))

    each = blocks.select("vocabulary").mapInArrow(frugal(run), "counted array<struct<term: string, n: bigint>>")
    # No term is null. A join on terms would say so on its own side alone, and the counts would be made twice.
    return each.select(F.inline("counted")).where("term is not null").groupBy("term").agg(F.sum("n").alias("df"))


def _added(counts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(counts).group_by("term", use_threads=False).aggregate([("n", "sum")]).select(["term", "n_sum"]).rename_columns(["term", "n"]).combine_chunks()


def _handed(counts: pa.Table) -> Iterator[pa.RecordBatch]:
    for b in counts.to_batches(max_chunksize=HANDED):
        yield pa.RecordBatch.from_arrays([_single(pa.StructArray.from_arrays(b.columns, names=["term", "n"]))], names=["counted"])


def sizes(blocks: DataFrame) -> DataFrame:
    """documents and tokens of the blocks, one row."""
    return blocks.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).cast("long").alias("documents"), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0)).alias("tokens"))


def weighed(counts: DataFrame, corpus: DataFrame) -> DataFrame:
    """terms(term, df, idf) from counts(term, df). Terms in more than half of all documents get a share of the mean over the vocabulary, negative ones included in that mean."""
    raw = counts.join(corpus).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(mean).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def build(chunks: DataFrame, id_col: str, text: Column, together: Sequence[str] = ()) -> SparseIndex:
    """Texts are read once and written as blocks. Documents alike in the columns together share blocks (at the price of a shuffle), which tightens bounds."""
    ready(chunks.sparkSession)
    d = chunks.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(together)])
    if together:
        by = [f"_{k}" for k in range(len(together))]
        d = d.withColumn("_n", F.octet_length("text")).repartitionByRange(*by, "_n").sortWithinPartitions(*by, "_n")
    blocks = cut(gather(d.select("id", "text")), "sparse-blocks")
    corpus = sizes(blocks).select(F.col("documents").alias("n"), F.try_divide("tokens", "documents").alias("avgdl"))
    return SparseIndex(blocks, weighed(document_counts(blocks), corpus), corpus)


class _Block:
    """A row of a batch of blocks, packed or not, as arrays."""

    def __init__(self, b: pa.RecordBatch, k: int, avgdl: float) -> None:
        get = lambda c: b.column(c)[k].values.to_numpy(zero_copy_only=False)
        self.lengths, self.avgdl = get("lengths"), avgdl
        if "postings" not in b.schema.names:
            self._hold(b.column("terms")[k].values, get("ends"), get("docs"), get("tf"))
        else:
            vocabulary, postings = _unpack(b.column("vocabulary")[k]), _unpack(b.column("postings")[k])
            steps = postings.column("steps").to_numpy()
            self._hold(vocabulary.column("terms"), vocabulary.column("ends").to_numpy(), np.cumsum(steps, dtype=steps.dtype), postings.column("tf").to_numpy())

    def _hold(self, terms: pa.Array, ends: np.ndarray, docs: np.ndarray, tf: np.ndarray) -> None:
        self.terms, self.ends, self.docs, self.tf = terms, ends.astype(np.int64), docs, tf
        self.begins = np.r_[0, self.ends[:-1]].astype(np.int64) if len(self.ends) else np.zeros(0, np.int64)

    def among(self, words: pa.Array) -> _Block:
        """The block with these words alone."""
        at = np.flatnonzero(pc.is_in(self.terms, value_set=words).to_numpy(zero_copy_only=False))
        posting, few = _ranges(self.begins[at], self.ends[at] - self.begins[at]), object.__new__(_Block)
        few.lengths, few.avgdl = self.lengths, self.avgdl
        few._hold(self.terms.take(pa.array(at)), np.cumsum(self.ends[at] - self.begins[at]), self.docs[posting], self.tf[posting])
        return few

    @cached_property
    def every(self) -> np.ndarray:
        """The impact of each posting."""
        return impact(self.tf, self.lengths[self.docs], self.avgdl)

    @cached_property
    def best(self) -> np.ndarray:
        """The largest impact of each term."""
        return np.maximum.reduceat(self.every, self.begins) if len(self.begins) else np.zeros(0)

    def places(self, words: pa.Array) -> np.ndarray:
        """Where the block has each word, or -1."""
        return pc.fill_null(pc.index_in(words, value_set=self.terms), -1).to_numpy()


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, … of every range, end to end."""
    return np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)


def score_block(held: _Block, question: np.ndarray, words: pa.Array, weight: np.ndarray, least: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """(scores of all questions and documents, -inf for those out of the race; postings that were scored).

    question, words and weight are the questions' terms; least is each question's threshold; at is where the block has the terms, if that is known.
    """
    nq, nd = len(least), len(held.lengths)
    at = held.places(words) if at is None else at
    q, w, at = question[at >= 0], weight[at >= 0], at[at >= 0]
    begins, n = held.begins[at], held.ends[at] - held.begins[at]
    most = np.maximum(w * held.best[at], 0)
    # By question, the least promising terms first; those that stay under the threshold together are the second wave.
    order = np.lexsort((most, q))
    run = np.cumsum(most[order])
    start = np.searchsorted(q[order], np.arange(nq))
    run -= np.r_[0, run][start][q[order]]
    second = np.zeros(len(q), bool)
    second[order] = run < least[q[order]] - SLACK
    rest = np.bincount(q[second], most[second], nq)

    def wave(which: np.ndarray, among: np.ndarray | None) -> tuple[np.ndarray, int]:
        posting = _ranges(begins[which], n[which])
        cell = np.repeat(q[which] * nd, n[which]) + held.docs[posting]
        value = np.repeat(w[which], n[which]) * held.every[posting]
        if among is not None:
            cell, value = cell[among[cell]], value[among[cell]]
        return np.bincount(cell, value, nq * nd).astype(float), len(cell)  # of nothing, counts are integers

    total, scored = wave(~second, None)
    race = total + np.repeat(rest, nd) >= np.repeat(least, nd) - SLACK
    if second.any():
        more, late = wave(second, race)
        total, scored = total + more, scored + late
    total[~race] = -np.inf
    return total.reshape(nq, nd), scored


def scores(held: _Block, words: pa.ListArray, least: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first question, scores) of runs of questions that have at most CELLS postings and cells together, or are single. words: of struct<term, weight>, a list for each question."""
    ends = words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py()
    flat = words.flatten()
    weight, place = flat.field("weight").to_numpy(), held.places(flat.field("term"))
    postings = np.r_[0, np.cumsum(np.where(place >= 0, (held.ends - held.begins)[place] if len(held.ends) else 0, 0))]
    cells, at = postings[ends] + np.arange(len(ends)) * len(held.lengths), 0
    while at < len(least):
        end = max(at + 1, int(np.searchsorted(cells, cells[at] + CELLS, side="right")) - 1)
        part = slice(ends[at], ends[end])
        yield at, score_block(held, np.repeat(np.arange(end - at), np.diff(ends[at : end + 1])), flat.field("term")[part], weight[part], least[at:end], place[part])[0]
        at = end


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best positive scores, as the final ranking orders them."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        r = np.round(scores[at], 9)
        kth = -np.partition(-r, k - 1)[k - 1]
        at, r = at[r >= kth], r[r >= kth]
        at = at[np.lexsort((ids[at], -r))[:k]]
    return at


def _group(groups: int) -> Column:
    return F.pmod(F.xxhash64("qid"), F.lit(groups)).alias("group")


def _together(words: DataFrame, groups: int) -> DataFrame:
    """group, asked, from words(qid, words). Written, since then the size is known: small groups go to the blocks, which stay where they are read."""
    return cut(words.groupBy(_group(groups)).agg(F.collect_list(F.struct("qid", "words")).alias("asked")), "asked-groups")


def _evaluate(index: SparseIndex, pairs: DataFrame, words: DataFrame, groups: int, k: int, asked: DataFrame | None = None) -> DataFrame:
    """qid, id, bm25_score of the k best of each of pairs(qid, block, least) that reach least. words: qid, words; asked: their groups, if they are there.

    Pairs are written without words, for the same reason as groups.
    """
    told = cut(pairs.where("qid is not null").groupBy("block", _group(groups)).agg(F.collect_list(F.struct("qid", "least")).alias("told")), "told")
    d = index.packed.join(told, "block").join(_together(words, groups) if asked is None else asked, "group").join(index.corpus.select("avgdl"))
    d = d.withColumn("dead", F.array().cast("array<int>")) if index.dead is None else d.join(index.dead, "block", "left").withColumn("dead", F.coalesce("dead", F.array().cast("array<int>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                held, told, words = _Block(b, row, b.column("avgdl")[row].as_py()), b.column("told")[row].values, b.column("asked")[row].values
                words = words.field("words").take(pc.index_in(told.field("qid"), value_set=words.field("qid")))
                held = held.among(words.flatten().field("term").unique())
                ids, gone = b.column("ids")[row].values, b.column("dead")[row].values.to_numpy()
                low = pc.fill_null(ids, -(1 << 63)).to_numpy()
                q, at, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
                for first, total in scores(held, words, told.field("least").to_numpy()):
                    total[:, gone] = -np.inf
                    for i, one in enumerate(total):
                        at.append(_best(one, low, k))
                        q.append(np.full(len(at[-1]), first + i))
                        score.append(one[at[-1]])
                yield pa.RecordBatch.from_arrays([told.field("qid").take(pa.array(np.concatenate(q))), ids.take(pa.array(np.concatenate(at))), pa.array(np.concatenate(score))], names=["qid", "id", "bm25_score"])

    return d.select(*index.packed.columns, "told", "asked", "avgdl", "dead").mapInArrow(frugal(run), "qid long, id long, bm25_score double")


def postings(blocks: DataFrame, dead: DataFrame | None = None, kept: bool = True) -> DataFrame:
    """term, id, tf, dl of the documents of blocks that are not dead, or of those that are."""
    none = F.array().cast("array<int>")
    d = blocks.withColumn("dead", none) if dead is None else blocks.join(dead, "block", "left").withColumn("dead", F.coalesce("dead", none))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                held, ids = _Block(b, k, 1.0), b.column("ids")[k].values
                out = np.isin(held.docs, b.column("dead")[k].values.to_numpy(), invert=kept)
                term = np.repeat(np.arange(len(held.ends)), held.ends - held.begins)[out]
                docs = held.docs[out]
                yield pa.RecordBatch.from_arrays([held.terms.take(pa.array(term)), ids.take(pa.array(docs)), pa.array(held.tf[out].astype(np.int64)), pa.array(held.lengths[docs])], names=["term", "id", "tf", "dl"])

    return d.select(*blocks.columns, "dead").mapInArrow(frugal(run), "term string, id long, tf long, dl int")


def question_terms(questions: DataFrame) -> DataFrame:
    """qid, term, times; a repeated term counts each time."""
    return questions.select("qid", F.explode(X.tokens(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))


def block_bounds(index: SparseIndex, asked: DataFrame, groups: int) -> DataFrame:
    """qid, block, bound: the most that any document of the block can score, where it has a term of the question. asked: group, asked, as _together gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                asked = b.column("asked")[k].values
                words = asked.field("words")
                term, weight = words.flatten().field("term"), words.flatten().field("weight").to_numpy()
                held = _Block(b, k, b.column("avgdl")[k].as_py()).among(term.unique())
                at, question = held.places(term), np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
                question, most = question[at >= 0], np.maximum(weight[at >= 0] * held.best[at[at >= 0]], 0)
                has = np.flatnonzero(np.bincount(question, minlength=len(words)))
                bound = np.bincount(question, most, len(words))[has].astype(float)
                yield pa.RecordBatch.from_arrays([asked.field("qid").take(pa.array(has)), pa.repeat(b.column("block")[k], len(has)), pa.array(bound)], names=["qid", "block", "bound"])

    every = index.packed.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    d = every.join(asked, "group").join(index.corpus.select("avgdl")).select("block", "lengths", "vocabulary", "postings", "asked", "avgdl")
    return d.mapInArrow(frugal(run), "qid long, block long, bound double")


def search(index: SparseIndex, questions: DataFrame, k: int = 30) -> DataFrame:
    """qid, id, bm25_score, sparse_rank: the k best with a positive score, ties to the smaller id."""
    ready(questions.sparkSession)
    asked = cut(question_terms(questions).join(index.terms, "term").select(F.col("qid").cast("long").alias("qid"), "term", (F.col("times") * F.col("idf")).alias("weight")), "asked")
    words = cut(asked.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("words")), "asked-words")
    groups = -(-words.count() // GROUP) or 1
    met = _together(words, groups)
    bounds = cut(block_bounds(index, met, groups), "block-bounds")
    first = bounds.groupBy("qid").agg(F.max_by("block", F.struct("bound", "block")).alias("block"))
    found = cut(_evaluate(index, first.withColumn("least", F.lit(0.0)), words, groups, k, met), "first-pass")
    least = found.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.min("bm25_score")).otherwise(0.0).alias("least"))
    rest = bounds.join(first.select("qid", F.col("block").alias("_block")), "qid").where("block <> _block").join(least, "qid", "left")
    rest = rest.withColumn("least", F.coalesce("least", F.lit(0.0))).where(F.col("bound") >= F.col("least") - SLACK).select("qid", "block", "least")
    if rest.take(1):
        found = found.unionByName(_evaluate(index, rest, words, groups, k, met))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("bm25_score", 9)), "id"))
    return found.withColumn("sparse_rank", rank).where(F.col("sparse_rank") <= k)
