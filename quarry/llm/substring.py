r"""Substring dedup by prefix-partitioned suffix trees.

A suffix starts at a word ``[^\x20\x09-\x0D]+`` and is followed for ``depth`` words or to its document's end. Only suffixes
whose first ``window`` words occur twice or more can hang below a node that deep. They are found first, by hashes of these
words over the whole corpus; a hash that two different windows share costs work and decides nothing.

Those suffixes are split into groups by prefixes of variable length: of two words, and where a group turns out to hold more
than ``leaf`` suffixes, of four, eight or ``window`` words; a group that is too large is dealt again without being held. A group is sorted by words; the common
prefixes of neighbours give the internal nodes of its subtree (``nodes``). A node of ``window`` words or more is a repeat.
``dedup`` cuts suffixes after the window, as deeper nodes hang below and remove nothing more; ``repeats`` follows
them further and gives the maximal repeats. Each block of documents sends every different suffix once, with its own smallest
document id, so a passage that a third of all documents share costs a group one row for each block.

Every word has a number of its own in the corpus (words are known by 64-bit hashes); two windows are equal if all their words are. A word goes if it lies in a window that also
starts in a document with a smaller id, judged on the input.

Defined cases: a null text is empty; an empty document has no words and stays, empty; a text under ``window`` words is
left as it is; a text of any length is followed whole; a null id counts as larger than any id; rows with equal ids never remove
from each other; an empty table gives an empty result; other columns are ignored. Removed words leave the rest joined by
single spaces, and so are the words of all documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import blocks as B
from quarry.session import cut

WINDOW = 13
LEAF, SMALLEST = 1 << 19, 1 << 16  # suffixes in a group, and the least that a group is split from
SENT = 256  # messages in an Arrow batch
NO_ID = np.iinfo(np.int64).max
FIRST, SEVERAL = np.uint64(1), np.uint64(2)  # what stands before a suffix: its document's begin, or different words
_odd = np.random.Generator(np.random.PCG64(4242)).integers(1, 1 << 62, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_lengths(window: int) -> list[int]:
    return sorted({n for n in (2, 4, 8) if n < window} | {window})


def row_hashes(columns: Iterable[np.ndarray], n: int) -> np.ndarray:
    """One hash for each of n rows, from their columns."""
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j, c in enumerate(columns):
            out += B.mix(c.astype(np.uint64) * _odd[j % len(_odd)] + np.uint64(j))
    return B.mix(out)


class Block:
    """The words of a block of documents: hashes, the documents they stand in, and where whole windows start."""

    def __init__(self, ids: pa.Array, texts: pa.Array, window: int) -> None:
        self.window = window
        self.h, self.doc = B.word_hashes(*B.text_bytes(texts))
        n = len(self.h)
        self.whole = np.flatnonzero(self.doc[: n - window + 1] == self.doc[window - 1 :]) if n >= window else np.zeros(0, np.int64)
        self.ids = ids.fill_null(NO_ID).to_numpy()

    def keys(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(different windows ascending, how often each, number of each start's window), known by so many bits."""
        key = B.run_hashes(self.h, self.window)[self.whole] >> np.uint64(64 - bits)
        order = np.argsort(key, kind="stable")
        new = np.r_[True, np.diff(key[order]) > 0] if len(key) else np.zeros(0, bool)
        number = np.empty(len(key), np.int64)
        number[order] = np.cumsum(new) - 1
        return key[order[new]], np.diff(np.r_[np.flatnonzero(new), len(key)]), number

    def repeated(self, bits: int, buckets: int, answers: list) -> np.ndarray:
        """Starts of windows that occur twice or more, in this block or, as the answers say, in others too."""
        key, times, number = self.keys(bits)
        often, at = times > 1, B.split(key, buckets, bits)
        for a in answers:
            if a["kind"] == WINDOWS:
                often[at[a["bucket"]] + B.expand_sorted(a["told"], "i4")] = True
        return self.whole[often[number]]

    def numbers(self, answers: list) -> np.ndarray:
        """The corpus's number of each word, from 1."""
        told = [B.expand(a["told"], "i8") for a in sorted(answers, key=lambda a: a["bucket"]) if a["kind"] == WORDS]
        return (np.concatenate(told) if told else np.zeros(0, np.int64))[np.unique(self.h, return_inverse=True)[1]]

    def word(self, starts: np.ndarray, j: int, code: np.ndarray) -> np.ndarray:
        """The number of the j-th word from each start, 0 after its document's end."""
        place = starts + j
        if j < self.window:
            return code[place]
        within = np.minimum(place, len(code) - 1)
        return np.where((place < len(code)) & (self.doc[within] == self.doc[starts]), code[within], 0)

    def words(self, starts: np.ndarray, depth: int, code: np.ndarray) -> np.ndarray:
        """The suffixes that begin there, a row each."""
        m = np.empty((depth, len(starts)), np.int64)
        for j in range(depth):
            m[j] = self.word(starts, j, code)
        return m.T

    def groups(self, starts: np.ndarray, n: int, ways: int, code: np.ndarray) -> np.ndarray:
        """groups_of the suffixes that begin there."""
        return (row_hashes((self.word(starts, j, code) for j in range(n)), len(starts)) % np.uint64(ways)).astype(np.int64)

    def suffixes(self, starts: np.ndarray, depth: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The different suffixes there: (a start of each; number of each start's suffix; order of the starts; where each suffix begins in it).

        Suffixes are compared a word at a time, so that their words don't all stand beside each other.
        """
        key = row_hashes((self.word(starts, j, code) for j in range(depth)), len(starts))
        order = np.argsort(key, kind="stable")
        key, by = key[order], starts[order]
        new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        for j in range(depth if len(key) else 0):
            w = self.word(by, j, code)
            new[1:] |= w[1:] != w[:-1]
        number = np.empty(len(key), np.int64)
        number[order] = np.cumsum(new) - 1
        return by[new], number, order, np.flatnonzero(new)


def messages(rows_of: Callable[[np.ndarray], np.ndarray], group: np.ndarray) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(group, its rows, their words) for each group."""
    order = np.argsort(group, kind="stable")
    names, begin = np.unique(group[order], return_index=True)
    for name, rows in zip(names.tolist(), np.split(order, begin[1:]) if len(names) else [], strict=True):
        yield name, rows, B.squeeze_rows(rows_of(rows))


def groups_of(m: np.ndarray, n: int, ways: int) -> np.ndarray:
    """A number below ways for each row, by its first n words."""
    return (row_hashes(m.T[:n], len(m)) % np.uint64(ways)).astype(np.int64)


def sorted_suffixes(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefixes of neighbours) of the rows of a group, sorted by words."""
    bits = max(1, int(m.max(initial=0)).bit_length())
    each, keys = 63 // bits, []
    for j in range(0, m.shape[1], each):
        key = np.zeros(len(m), np.int64)
        for k in range(j, min(j + each, m.shape[1])):
            key = (key << bits) | m[:, k]
        keys.append(key)
    order = np.lexsort(keys[::-1])
    del keys
    common, length = np.full(max(len(m) - 1, 0), m.shape[1]), np.zeros(len(m), np.int64)
    for j in reversed(range(m.shape[1])):
        w = m[order, j]
        common[w[1:] != w[:-1]] = j
        length += w != 0
    return order, np.minimum(common, np.minimum(length[1:], length[:-1]))


def nodes(common: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(depth, first leaf, last leaf) of each internal node of at least that depth, from the neighbours' common prefixes."""
    found = []
    for depth in np.unique(common[common >= least]).tolist():
        deep = np.r_[False, common >= depth, False]
        edges = np.flatnonzero(deep[1:] != deep[:-1])
        shallow = np.minimum.reduceat(np.r_[common, 0], edges)[::2]
        found += [(depth, a, b) for a, b in edges.reshape(-1, 2)[shallow == depth].tolist()]
    return found


WINDOWS, WORDS = 0, 1


def find_repeated(table: DataFrame, window: int, bits: int, buckets: int) -> DataFrame:
    """block_id, kind, bucket, n, told: which of a block's different windows other blocks hold too, and the numbers of its words.

    Every word of the corpus has one number; in each bucket those that more blocks hold have smaller ones, which take less room.
    """
    of_words = max(16, buckets >> 3)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, ids, texts in B.blocks_of(b):
                words, block = Block(ids, texts, window), b.column("block_id")[i].as_py()
                for kind, key, at in ((WINDOWS, key := words.keys(bits)[0], B.split(key, buckets, bits)), (WORDS, key := np.unique(words.h), B.split(key, of_words))):
                    some = np.flatnonzero(np.diff(at))
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(some), pa.int32()), pa.array(some.astype("i4")), pa.array([block] * len(some), pa.int64()), pa.array([B.squeeze_sorted(key[at[k] : at[k + 1]]) for k in some], pa.binary())], names=["kind", "bucket", "block_id", "keys"])

    def answer(g: pd.DataFrame) -> pd.DataFrame:
        keys, kind, bucket = [B.expand_sorted(k, "u8") for k in g["keys"]], int(g["kind"].iloc[0]), int(g["bucket"].iloc[0])
        columns = ["block_id", "kind", "bucket", "n", "told"]
        if kind == WORDS:
            _, which, held = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            rank = np.empty(len(held), np.int64)
            rank[np.argsort(-held, kind="stable")] = np.arange(len(held))
            number = np.split(rank[which] * of_words + bucket + 1, np.cumsum([len(k) for k in keys])[:-1])
            return pd.DataFrame([(block, kind, bucket, 0, B.squeeze(x)) for block, x in zip(g["block_id"], number, strict=True)], columns=columns)
        every = np.sort(np.concatenate(keys))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        rows = []
        for block, k in zip(g["block_id"], keys, strict=True):
            at = np.minimum(np.searchsorted(twice, k), max(len(twice) - 1, 0))
            told = np.flatnonzero(twice[at] == k) if len(twice) else at[:0]
            if len(told):
                rows.append((block, kind, bucket, len(told), B.squeeze_sorted(told.astype("i4"))))
        return pd.DataFrame(rows, columns=columns)

    asked = table.select("block_id", "ids", "texts").mapInArrow(B.frugal(ask), "kind int, bucket int, block_id long, keys binary")
    return cut(asked.groupBy("kind", "bucket").applyInPandas(answer, "block_id long, kind int, bucket int, n long, told binary"), "repeated")


MESSAGE = "group long, block_id long, home long, at binary, n long, words binary, least binary"


KINDS = {"least": "i8", "left": "u8", "times": "i8", "where": "i8"}


def _arrow(schema: str) -> pa.Schema:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])


def longer(message: dict, n: int, depth: int, extra: tuple[str, ...], ways: int = 64) -> Iterator[dict]:
    """The message in parts, by its suffixes' first n words."""
    m, at = B.expand_rows(message["words"], "i8", depth), B.expand_sorted(message["at"], "i4")
    # Groups that get the same number by chance are one, which costs memory alone.
    group = (B.mix(np.array([message["group"]], np.int64).view(np.uint64)) + groups_of(m, n, ways).astype(np.uint64)).view(np.int64)
    for name, rows, words in messages(m.__getitem__, group):
        yield {"group": name, "block_id": message["block_id"], "home": message["home"], "at": B.squeeze_sorted(at[rows]), "n": len(rows), "words": words, **{x: B.squeeze(B.expand(message[x], KINDS[x])[rows]) for x in ("least", *extra)}}


def together(group: list[dict], depth: int) -> np.ndarray:
    """The suffixes of a group's messages, a row each; those of one message at a time are expanded beside them."""
    m, at = np.empty((depth, sum(x["n"] for x in group)), np.int64), 0
    for x in group:
        m[:, at : at + x["n"]] = B.expand_rows(x["words"], "i8", depth).T
        at += x["n"]
    return m.T


def subtrees(sent: DataFrame, window: int, depth: int, leaf: int, total: int, extra: tuple[str, ...], result: str, tree) -> DataFrame:
    """The rows of result that tree(messages of a group) gives for all groups.

    A task counts a group's suffixes as its messages come. A group of more than leaf is not held: its messages are passed on in
    parts by longer prefixes, to be dealt again.
    """
    message = MESSAGE + "".join(f", {x} binary" for x in extra)
    told, kind = _arrow(result), f"{result}, {message}"
    whole = _arrow(kind)
    tasks = max(int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * total // leaf)
    lengths, found = prefix_lengths(window), []

    def grow(further: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size, name = [], 0, None
            for b in batches:
                for i in range(b.num_rows):
                    m = {c: b.column(c)[i].as_py() for c in b.schema.names}
                    if m["group"] != name:
                        if held:
                            yield pa.RecordBatch.from_pylist(tree(held), schema=whole)
                        held, size, name = [], 0, m["group"]
                    size += m["n"]
                    held.append(m)
                    if further and size > leaf:
                        for x in held:
                            yield pa.RecordBatch.from_pylist(list(longer(x, further, depth, extra)), schema=whole)
                        held = []
            if held:
                yield pa.RecordBatch.from_pylist(tree(held), schema=whole)

        return run

    for k in range(len(lengths)):
        further = lengths[k + 1] if k + 1 < len(lengths) else None
        out = cut(sent.repartition(tasks, "group").sortWithinPartitions("group").mapInArrow(B.frugal(grow(further)), kind), "nodes")
        found.append(out.where("group is null").select(told.names))
        sent = out.where("group is not null").select(_arrow(message).names)
        if sent.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def _corpus(docs: DataFrame, window: int, id_col: str, text_col: str, whole_rows: bool) -> tuple[DataFrame, int, int, int]:
    """(blocks with what is repeated in each, how many suffixes that is, bits, buckets)."""
    table, size = B.write_blocks(docs, id_col, text_col, whole_rows=whole_rows)
    words = size // 6 + 1
    # Enough bits that few windows look repeated by chance.
    bits, buckets = min(64, max(32, words.bit_length() + 6)), 1 << max(4, (words >> 20).bit_length())
    told = find_repeated(table, window, bits, buckets)
    return B.with_answers(table, told, ["kind", "bucket", "told"], "repeated"), told.agg(F.sum("n")).first()[0] or 0, bits, buckets


def _messages(both: DataFrame, total: int, window: int, depth: int, bits: int, buckets: int, leaf: int, extra: tuple[str, ...]) -> tuple[DataFrame, int]:
    """The different suffixes of each block by groups, and the number of groups before any is split."""
    ways = 1 << max(4, (2 * total // leaf).bit_length())
    schema = MESSAGE + "".join(f", {x} binary" for x in extra)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, ids, texts in B.blocks_of(b):
                block = Block(ids, texts, window)
                heard = b.column("repeated")[i].as_py() or []
                starts = block.repeated(bits, buckets, heard)
                code = block.numbers(heard)
                first, number, order, begin = block.suffixes(starts, depth, code)
                owner = block.ids[block.doc[starts]]
                least = np.minimum.reduceat(owner[order], begin) if len(begin) else owner
                more = _details(block, starts, number, order, begin, owner, least) if extra else {}
                name, out = b.column("block_id")[i].as_py(), []
                for group, rows, words in messages(lambda rows: block.words(first[rows], depth, code), block.groups(first, prefix_lengths(window)[0], ways, code)):  # noqa: B023  used at once
                    out.append({"group": group, "block_id": name, "home": group, "at": B.squeeze_sorted(np.arange(len(rows), dtype="i4")), "n": len(rows), "words": words, "least": B.squeeze(least[rows]), **{k: B.squeeze(v[rows]) for k, v in more.items()}})
                    if len(out) == SENT:
                        yield pa.RecordBatch.from_pylist(out, schema=_arrow(schema))
                        out = []
                yield pa.RecordBatch.from_pylist(out, schema=_arrow(schema))

    return both.select("block_id", "ids", "texts", "repeated").mapInArrow(B.frugal(send), schema), ways


def group_leaf(spark: SparkSession, total: int, leaf: int) -> int:
    """leaf, or less where the groups would be too few for the tasks."""
    return int(min(leaf, max(SMALLEST, 2 * total // int(spark.conf.get("spark.sql.shuffle.partitions")))))


def _details(block: Block, starts: np.ndarray, number: np.ndarray, order: np.ndarray, begin: np.ndarray, owner: np.ndarray, least: np.ndarray) -> dict[str, np.ndarray]:
    """For each different suffix what stands before it, how often it occurs, and its first word's place in the smallest document."""
    if not len(begin):
        return {"left": np.zeros(0, np.uint64), "times": np.zeros(0, np.int64), "where": np.zeros(0, np.int64)}
    first = np.r_[True, block.doc[1:] != block.doc[:-1]]
    before = np.where(first[starts], FIRST, block.h[np.maximum(starts - 1, 0)])[order]
    low, high = np.minimum.reduceat(before, begin), np.maximum.reduceat(before, begin)
    times = np.diff(np.r_[begin, len(starts)])
    left = np.where(low != high, SEVERAL, np.where((low == FIRST) & (times > 1), SEVERAL, low))
    place = starts - np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))[starts]
    place = np.where(owner == least[number], place, NO_ID)[order]
    return {"left": left, "times": times, "where": np.minimum.reduceat(place, begin)}


def dedup(docs: DataFrame, window: int = WINDOW, leaf: int = LEAF, id_col: str = "doc_id", text_col: str = "text", whole_rows: bool = False) -> DataFrame:
    """id, n_words, n_removed, text (the words that stay) for each row.

    whole_rows: the table's own columns instead, and untouched documents keep their text as it is.
    """
    table, total, bits, buckets = _corpus(docs, window, id_col, text_col, whole_rows)
    leaf = group_leaf(docs.sparkSession, total, leaf)
    sent, ways = _messages(table, total, window, window, bits, buckets, leaf, ())

    def tree(group: list[dict]) -> list[dict]:
        """Each deep node's smallest document, told to the blocks whose own smallest is larger."""
        order, common = sorted_suffixes(together(group, window))
        least = np.concatenate([B.expand(x["least"], "i8") for x in group])
        # Suffixes end at the window here, so a node of that depth is a run of neighbours that agree over all of it.
        begins = np.r_[True, common < window]
        low = np.empty(len(least), np.int64)
        low[order] = np.minimum.reduceat(least[order], np.flatnonzero(begins))[np.cumsum(begins) - 1]
        rows, start = [], 0
        for x in group:
            told = np.flatnonzero(low[start : start + x["n"]] < least[start : start + x["n"]])
            if len(told):
                rows.append({"to": x["block_id"], "of": x["home"], "told": B.squeeze_sorted(B.expand_sorted(x["at"], "i4")[told]), "low": B.squeeze(low[start + told])})
            start += x["n"]
        return rows

    told = subtrees(sent, window, window, leaf, total, (), "to long, of long, told binary, low binary", tree).withColumnRenamed("to", "block_id")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, ids, texts in B.blocks_of(b):
                block = Block(ids, texts, window)
                heard = b.column("repeated")[i].as_py() or []
                starts = block.repeated(bits, buckets, heard)
                code = block.numbers(heard)
                first, number, order, begin = block.suffixes(starts, window, code)
                owner = block.ids[block.doc[starts]]
                least = np.minimum.reduceat(owner[order], begin) if len(begin) else owner
                if answers := b.column("answers")[i].as_py() or []:
                    group = block.groups(first, prefix_lengths(window)[0], ways, code)
                    by = np.argsort(group, kind="stable")
                    names, begins = np.unique(group[by], return_index=True)
                    at = dict(zip(names.tolist(), begins.tolist(), strict=True))
                    for a in answers:
                        least[by[at[a["of"]] + B.expand_sorted(a["told"], "i4")]] = B.expand(a["low"], "i8")
                gone = starts[owner > least[number]]
                cover = np.zeros(len(block.h) + 1, np.int64)
                np.add.at(cover, gone, 1)
                np.add.at(cover, gone + window, -1)
                out = np.cumsum(cover[:-1]) > 0
                words = np.bincount(block.doc, minlength=len(ids))
                removed = np.bincount(block.doc[out], minlength=len(ids))
                kept, at = [], 0
                for t, n, r in zip(texts.to_pylist(), words.tolist(), removed.tolist(), strict=True):
                    ws = t.encode().split() if r or not whole_rows else [t.encode()]
                    kept.append(b" ".join([w for w, x in zip(ws, out[at : at + n].tolist(), strict=True) if not x] if r else ws))
                    at += n
                columns = [ids, pa.array(words), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, b.column("rows")[i].values] if whole_rows else columns, names=["id", "n_words", "n_removed", "text", "row"][: 4 + whole_rows])

    both = B.with_answers(table, told, ["of", "told", "low"], "answers").select("ids", "texts", "repeated", "answers", *(["rows"] if whole_rows else []))
    kind = T.StructType().add("id", T.LongType()).add("n_words", T.LongType()).add("n_removed", T.LongType()).add("text", T.StringType())
    if not whole_rows:
        return both.mapInArrow(B.frugal(apply), kind)
    d = both.mapInArrow(B.frugal(apply), kind.add("row", table.schema["rows"].dataType.elementType))
    return d.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])


def repeats(docs: DataFrame, least: int = WINDOW, depth: int = 64, leaf: int = LEAF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal repeats of at least that many words: length, occurrences, id and start (a word's place, from 0) of the first one, open.

    A repeat is maximal if its occurrences neither all continue with one word nor all follow one word. Suffixes are followed for
    depth words; a repeat of that length may go on, and is open.
    """
    table, total, bits, buckets = _corpus(docs, least, id_col, text_col, False)
    leaf, extra = group_leaf(docs.sparkSession, total, leaf), ("left", "times", "where")
    sent, _ = _messages(table, total, least, depth, bits, buckets, leaf, extra)

    def tree(group: list[dict]) -> list[dict]:
        m = together(group, depth)
        low, left, times, where = (np.concatenate([B.expand(x[c], KINDS[c]) for x in group]) for c in ("least", *extra))
        # A suffix that occurs several times in its block is a node by itself: it is set beside itself.
        copies = np.minimum(times, 2)
        order, common = sorted_suffixes(np.repeat(m, copies, axis=0))
        leaf_of = np.repeat(np.arange(len(times)), copies)[order]
        rows = []
        for d, a, b in nodes(common, least):
            here = np.unique(leaf_of[a : b + 1])
            before = left[here]
            if before.min() != before.max() or before[0] in (FIRST, SEVERAL):
                first = here[np.lexsort((where[here], low[here]))[0]]
                rows.append({"length": d, "occurrences": int(times[here].sum()), "id": None if low[first] == NO_ID else int(low[first]), "start": int(where[first]), "open": d == depth})
        return rows

    return subtrees(sent, least, depth, leaf, total, extra, "length long, occurrences long, id long, start long, open boolean", tree)
