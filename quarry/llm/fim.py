"""Fill-in-middle transformation by a parallel automaton scan.

A finite automaton over bytes knows where code points begin and whether a sentinel occurs. A chunk of bytes, whatever lies
before it, is a function from the state in which it is entered to the state in which it is left, with a count of code points
begun and a sentinel flag for each entry state. Functions compose associatively: four bytes at a time by table, then pairwise
to blocks of 64 bytes, then to chunks. A document of one chunk is done where it is read. Chunks of larger documents are dealt
over tasks; their functions (not their bytes) are composed in pages of at most PAGE chunks, and pages of pages, up to the
document; going down again gives each chunk its entry state and the code points before it. The chunk in which a cut lies is
then found by its counts, and the byte inside it by blocks.

A text of n code points is cut after the smaller and the larger of ``h1 % (n + 1)`` and ``h2 % (n + 1)``, where h1 to h4 are
hashes of the id. plain keeps the text, psm gives ``<P>prefix<S>suffix<M>middle`` and spm ``<S>suffix<P>prefix<M>middle``.

Defined cases: a null text is empty; an empty text, and one that contains a sentinel (which would make the output ambiguous),
stays plain; a null id hashes like an empty one; equal rows are separate documents with equal results; a byte that can't
continue a code point begins one; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import blocks as B
from quarry.session import cut

SENTINELS = ("<P>", "<S>", "<M>")
CHUNK_BYTES = 1 << 16
PAGE = 1024  # chunks whose functions one task composes at once
BLOCK, GRAM = 64, 4
PLAIN_FROM, SPM_BELOW = 90, 20


class Automaton:
    """States are what of a sentinel has been read (none of it is state 0), and how many bytes a code point still lacks."""

    def __init__(self, sentinels: tuple[str, ...]) -> None:
        names = [x.encode() for x in sentinels]
        read = sorted({x[:k] for x in names for k in range(len(x))})
        self.states = len(read) + 3
        self.next = np.zeros((self.states, 257), np.uint8)  # 256 is no byte at all: nothing changes
        self.begun, self.hit = np.zeros((self.states, 257), np.uint8), np.zeros((self.states, 257), bool)
        self.next[:, 256] = np.arange(self.states)
        for s, b in product(range(self.states), range(256)):
            lacks = s - len(read) + 1
            if lacks > 0 and 0x80 <= b < 0xC0:
                self.next[s, b] = s - 1 if lacks > 1 else 0
                continue
            seen = (read[s] if lacks <= 0 else b"") + bytes([b])
            self.begun[s, b] = 1
            self.hit[s, b] = any(seen.endswith(x) for x in names)
            more = (0xC2 <= b < 0xE0) + 2 * (0xE0 <= b < 0xF0) + 3 * (0xF0 <= b < 0xF5)
            self.next[s, b] = len(read) + more - 1 if more else next(read.index(seen[k:]) for k in range(len(seen) + 1) if seen[k:] in read)
        alike, self.kind = np.unique(np.concatenate([self.next, self.begun, self.hit]), axis=1, return_inverse=True)
        self.kind = self.kind.ravel().astype(np.uint16)
        self.kinds = alike.shape[1]
        one = [np.zeros((self.kinds, self.states), t) for t in (np.uint8, np.uint8, bool)]
        for table, full in zip(one, (self.next, self.begun, self.hit), strict=True):
            table[self.kind] = full.T
        self.by_kind = one
        grams = [x[:, None] for x in one]
        while grams[0].shape[1] < GRAM:
            grams = [np.concatenate([np.repeat(g, self.kinds, 0), np.tile(x[:, None], (len(g), 1, 1))], 1) for g, x in zip(grams, one, strict=True)]
        self.gram = compose(*grams)
        self.weights = self.kinds ** np.arange(GRAM - 1, -1, -1)


def compose(f: np.ndarray, begun: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The functions along axis 1 (a power of two of them) composed into one, pairwise."""
    while f.shape[1] > 1:
        at = f[:, 0::2].astype(np.intp)
        begun = begun[:, 0::2] + np.take_along_axis(begun[:, 1::2], at, 2)
        hit = hit[:, 0::2] | np.take_along_axis(hit[:, 1::2], at, 2)
        f = np.take_along_axis(f[:, 1::2], at, 2)
    return f[:, 0], begun[:, 0], hit[:, 0]


@cache
def automaton(sentinels: tuple[str, ...] = SENTINELS) -> Automaton:
    return Automaton(sentinels)


class Scan:
    """The functions of some pieces of bytes, whatever state each is entered in.

    left, begun and hit have a row for each piece and a column for each entry state.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, machine: Automaton) -> None:
        self.machine, self.sizes = machine, np.diff(offsets)
        n = -(-self.sizes // BLOCK)
        self.first = np.cumsum(n) - n
        self.blocks = n
        kinds = np.full(int(n.sum()) * BLOCK, machine.kind[256], np.uint16)
        kinds[np.arange(len(data)) + np.repeat(self.first * BLOCK - offsets[:-1], self.sizes)] = machine.kind[data]
        self.kinds = kinds.reshape(-1, BLOCK)
        grams = (self.kinds.reshape(-1, BLOCK // GRAM, GRAM) * machine.weights).sum(2)
        f, begun, hit = compose(*(x[grams] for x in machine.gram))
        states, pieces = machine.states, len(self.sizes)
        self.left = np.tile(np.arange(states, dtype=np.uint8), (pieces, 1))
        self.begun, self.hit = np.zeros((pieces, states), np.int64), np.zeros((pieces, states), bool)
        # Of every block: the state in which it is entered and the code points before it, for each entry state of its piece.
        self.entered, self.before = np.zeros(f.shape, np.uint8), np.zeros(f.shape, np.int64)
        order = np.argsort(-n, kind="stable")
        for k in range(int(n.max(initial=0))):
            live = order[: np.searchsorted(-n[order], -k, side="left")]
            at, now = self.first[live] + k, self.left[live].astype(np.intp)
            self.entered[at], self.before[at] = now, self.begun[live]
            self.begun[live] += np.take_along_axis(begun[at], now, 1)
            self.hit[live] |= np.take_along_axis(hit[at], now, 1)
            self.left[live] = np.take_along_axis(f[at], now, 1)

    def find(self, piece: np.ndarray, entry: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """The byte of the piece at which its code point number unit begins, if the piece is entered in state entry; its size if it has no such."""
        out = self.sizes[piece].copy()
        held = np.flatnonzero(unit < self.begun[piece, entry])
        piece, entry, unit = piece[held], entry[held], unit[held]
        low, high = self.first[piece], self.first[piece] + self.blocks[piece]
        while (high - low > 1).any():  # the last block with no more than unit before it
            mid = (low + high) // 2
            up = self.before[mid, entry] <= unit
            low, high = np.where(up, mid, low), np.where(up, high, mid)
        state, rest, found = self.entered[low, entry].astype(np.intp), unit - self.before[low, entry], np.full(len(low), -1)
        follow, begun, _ = self.machine.by_kind
        for k in range(BLOCK):
            kind = self.kinds[low, k]
            begins = begun[kind, state]
            found[(begins == 1) & (rest == 0) & (found < 0)] = k
            rest, state = rest - begins, follow[kind, state].astype(np.intp)
        out[held] = (low - self.first[piece]) * BLOCK + found
        return out


def hashes(key: Column) -> list[Column]:
    """The first four 8-digit groups of the digest of ``1:`` and the id, as numbers."""
    h = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


_CUTS = "n long, found boolean, first long, second long, first_byte long, second_byte long"


def _whole(docs: DataFrame) -> DataFrame:
    """docs(id, text, h1, h2) of one chunk each, with their cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in B.slices(batch, ["text"])):
            scan = Scan(*B.text_bytes(b.column("text")), automaton())
            n, every, start = scan.begun[:, 0], np.arange(b.num_rows), np.zeros(b.num_rows, np.intp)
            at = np.sort([b.column(h).to_numpy() % (n + 1) for h in ("h1", "h2")], axis=0)
            made = [n, scan.hit[:, 0], *at, *(scan.find(every, start, a) for a in at)]
            for c, v in zip(_CUTS.split(", "), made, strict=True):
                b = b.append_column(c.split()[0], pa.array(v))
            yield b

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(B.frugal(run), f"{kinds}, {_CUTS}")


_FUNCTION = "key long, chunk long, size long, left array<tinyint>, begun array<bigint>, hit array<boolean>"


def functions(chunks: DataFrame) -> DataFrame:
    """key, chunk, size, left, begun, hit: the function of each of chunks(key, chunk, bytes), an entry for each entry state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                data = np.frombuffer(b.column("bytes")[k].as_buffer(), np.uint8)
                s = Scan(data, np.array([0, len(data)]), automaton())
                yield pa.RecordBatch.from_arrays([b.column("key").slice(k, 1), b.column("chunk").slice(k, 1), pa.array([len(data)]), *(pa.array([x[0]], pa.list_(t)) for x, t in ((s.left, pa.int8()), (s.begun, pa.int64()), (s.hit, pa.bool_())))], names=[c.split()[0] for c in _FUNCTION.split(", ")])

    return chunks.mapInArrow(B.frugal(run), _FUNCTION)


def _matrix(t: pa.Table, name: str) -> np.ndarray:
    return np.array(t.column(name).combine_chunks().flatten().to_pylist()).reshape(t.num_rows, -1)


def _pages(level: DataFrame) -> DataFrame:
    """The functions of pages of the level's functions, composed in order."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        left, begun, hit = (_matrix(t, c) for c in ("left", "begun", "hit"))
        now, n, h = np.arange(left.shape[1]), np.zeros(left.shape[1], np.int64), np.zeros(left.shape[1], bool)
        for k in range(t.num_rows):
            n, h, now = n + begun[k][now], h | hit[k][now], left[k][now]
        size = int(np.sum(t.column("size").to_numpy()))
        return pa.table([pa.array([t.column("key")[0].as_py()]), pa.array([t.column("chunk")[0].as_py() // PAGE]), pa.array([size]), pa.array([now], pa.list_(pa.int8())), pa.array([n], pa.list_(pa.int64())), pa.array([h], pa.list_(pa.bool_()))], names=[c.split()[0] for c in _FUNCTION.split(", ")])

    return level.groupBy("key", F.expr(f"chunk div {PAGE}").alias("page")).applyInArrow(run, _FUNCTION)


_ENTRY = "key long, chunk long, entry int, start long, start_byte long, count long"


def _entries(level: DataFrame, above: DataFrame) -> DataFrame:
    """The level's functions with the state in which each is entered, and the code points and bytes before it, from those of their pages."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        left, begun, sizes = _matrix(t, "left"), _matrix(t, "begun"), t.column("size").to_numpy()
        now, n, at = (t.column(c)[0].as_py() for c in ("entry", "start", "start_byte"))
        entry, start, count = [], [], []
        for k in range(t.num_rows):
            entry.append(now)
            start.append(n)
            count.append(int(begun[k][now]))
            n, now = n + count[-1], int(left[k][now])
        return pa.table([t.column("key"), t.column("chunk"), pa.array(entry, pa.int32()), pa.array(start), pa.array(at + np.cumsum(sizes) - sizes), pa.array(count)], names=[c.split()[0] for c in _ENTRY.split(", ")])

    up = above.select(F.col("key").alias("_key"), F.col("chunk").alias("page"), "entry", "start", "start_byte")
    d = level.withColumn("page", F.expr(f"chunk div {PAGE}")).join(up, (F.col("key") == F.col("_key")) & (up["page"] == F.expr(f"chunk div {PAGE}"))).drop(up["page"]).drop("_key")
    return d.groupBy("key", "page").applyInArrow(run, _ENTRY)


def resolve(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of chunks(key, chunk from 0, bytes): each chunk with its entry state, code points and bytes before it and its count; and n and found of each key."""
    levels = [cut(functions(chunks), "functions")]
    while levels[-1].where("chunk > 0").take(1):
        levels.append(cut(_pages(levels[-1]), "function-pages"))
    whole = levels[-1].select("key", F.get("begun", 0).alias("n"), F.get("hit", 0).alias("found"))
    at = levels[-1].select("key", "chunk", F.lit(0).alias("entry"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("start_byte"), F.get("begun", 0).alias("count"))
    for level in levels[-2::-1]:
        at = cut(_entries(level, at), "entries")
    return at, whole


def locate(chunks: DataFrame, resolved: DataFrame, units: DataFrame) -> DataFrame:
    """key, name, byte for units(key, name, unit): the byte of the document at which its code point number unit begins. One that it lacks has no row."""
    at = resolved.join(units, "key").where("start <= unit and unit < start + count").select("key", "chunk", "entry", "start_byte", "name", (F.col("unit") - F.col("start")).alias("unit"))
    d = at.join(chunks, ["key", "chunk"]).select("key", "name", "entry", "unit", "start_byte", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                data = np.frombuffer(b.column("bytes")[k].as_buffer(), np.uint8)
                found = Scan(data, np.array([0, len(data)]), automaton()).find(np.zeros(1, np.intp), np.array([b.column("entry")[k].as_py()]), np.array([b.column("unit")[k].as_py()]))
                yield pa.RecordBatch.from_arrays([b.column("key").slice(k, 1), b.column("name").slice(k, 1), pa.array(found + b.column("start_byte")[k].as_py())], names=["key", "name", "byte"])

    return d.mapInArrow(B.frugal(run), "key long, name string, byte long")


def _parts(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """docs(id, text, h1, h2) of several chunks each, with their cuts."""
    d = cut(docs.withColumn("key", F.monotonically_increasing_id()), "large-documents")
    last = F.expr(f"(octet_length(text) - 1) div {chunk_bytes}")
    each = d.select("key", F.col("text").cast("binary").alias("all"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    piece = F.substring(F.col("all"), (F.col("chunk") * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes))
    chunks = cut(each.select("key", "chunk", piece.alias("bytes")).repartition("key", "chunk"), "chunks")
    resolved, whole = resolve(chunks)
    a, b = (F.pmod(F.col(h), F.col("n") + 1) for h in ("h1", "h2"))
    cuts = cut(d.drop("text").join(whole, "key").withColumns({"first": F.least(a, b), "second": F.greatest(a, b)}), "large-cuts")
    both = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("unit")) for c in ("first", "second")])
    bytes_at = locate(chunks, resolved, cuts.select("key", F.inline(both))).groupBy("key").agg(*[F.max(F.when(F.col("name") == c, F.col("byte"))).alias(f"{c}_byte") for c in ("first", "second")])
    made = cuts.select("key", "n", "found", "first", "second").join(bytes_at, "key", "left")
    end = F.octet_length("text").cast("long")
    return d.join(made, "key").withColumns({f"{c}_byte": F.coalesce(F.col(f"{c}_byte"), end) for c in ("first", "second")}).drop("key")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """id, n, form, prefix_chars and middle_chars (null if plain), output and the bytes of the text before each cut."""
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumns({f"h{k + 1}": h for k, h in enumerate(hashes(F.col("id")))})
    whole, parts = _whole(d.where(F.octet_length("text") <= chunk_bytes)), d.where(F.octet_length("text") > chunk_bytes)
    d = whole.unionByName(_parts(parts, chunk_bytes)) if parts.take(1) else whole
    form = F.when((F.col("n") == 0) | F.col("found") | (F.pmod("h3", F.lit(100)) >= PLAIN_FROM), "plain").when(F.pmod("h4", F.lit(100)) < SPM_BELOW, "spm").otherwise("psm")
    d, every = d.withColumn("form", form), F.col("text").cast("binary")
    piece = lambda a, b: F.substring(every, (a + 1).cast("int"), (b - a).cast("int")).cast("string")
    a, b, end = F.col("first_byte"), F.col("second_byte"), F.octet_length("text")
    prefix, middle, suffix, (p, s, m) = piece(F.lit(0), a), piece(a, b), piece(b, end), map(F.lit, SENTINELS)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    chars = lambda c: F.when(F.col("form") != "plain", c)
    return d.select("id", "n", "form", chars(F.col("first")).alias("prefix_chars"), chars(F.col("second") - F.col("first")).alias("middle_chars"), output.alias("output"), chars(a).alias("first_byte"), chars(b).alias("second_byte"))


def restored(output: Column, form: Column) -> Column:
    """The text, from the output and its form alone."""
    part = F.split(output, "|".join(SENTINELS), -1)
    get = lambda k: F.get(part, F.lit(k))
    return F.when(form == "plain", output).when(form == "psm", F.concat(get(1), get(3), get(2))).otherwise(F.concat(get(2), get(3), get(1)))
