"""Chat formatting of reply trees: root-to-leaf paths by iterative self-joins, ranked by score, each a conversation.

A message points to the one it answers. Self-joins of the message table with itself double the distance that each message
looks up (1, 2, 4, … ancestors), so a thread of n messages takes about log2(n) rounds, and a round moves one small row a
message. They sum the scores on the way to the root; a leaf's sum is the score of its path. Chosen paths are then listed by
going back through the same tables from the largest distance to the smallest, which visits each message of a path once.

Turns are formatted where they lie: ``### role: text</turn>`` and a line end. A backslash goes before every backslash, ``###``
and ``</turn>`` inside a text (in a role also before ``:``), so no text can end its turn or begin another, and dropping one
backslash of each pair gives the text back. Turns are then sorted by path and place and gathered into segments of at most
``segment_chars`` code points (or one turn), each with the spans of its turns' texts and the loss mask: the texts of the roles
to be learned. A conversation is its segments in order; no task holds more of one than a segment.

Defined cases: a null text or role is empty, a null score 0; a message without a parent, or whose parent isn't in its
conversation, is a root; of a cycle of replies the message that comes first by id is the root; where several messages share an id, answers
to it go to the first of them by role and text, and each is a message of its own; paths with equal scores rank by their last message; null ids
answer nothing and can't be answered; a null conversation is one of its own; an empty table gives an empty result; other
columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import blocks as B
from quarry.llm.places import placed
from quarry.session import cut

BEGIN, END = "###", "</turn>"
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
_PAIR = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for control in (BEGIN, END, *([":"] if role else [])):
        out = F.replace(out, F.lit(control), F.lit("\\" + control))
    return out


def unescaped(text: str) -> str:
    return _PAIR.sub(r"\1", text)


@dataclass(frozen=True)
class Tree:
    """nodes(key, up, conv, role, text, score): up is the key of the message that is answered, null for a root."""

    nodes: DataFrame


def threads(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Tree:
    """Conversations whose rows, by turn (ties by role, then text), each answer the one before."""
    d = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    d = placed(placed(d, ["conv"], ["turn", "role", "text"]).drop("_n").withColumnRenamed("_place", "_nth"), [], ["conv", "_nth"])
    return Tree(cut(d.select(F.col("_place").alias("key"), F.when(F.col("_nth") > 0, F.col("_place") - 1).alias("up"), "conv", "role", "text", F.lit(0.0).alias("score")), "thread-messages"))


def replies(rows: DataFrame, conv_col: str = "conv_id", id_col: str = "id", parent_col: str = "parent_id", role_col: str = "role", text_col: str = "text", score_col: str = "score") -> Tree:
    """Messages that name the one they answer."""
    d = rows.select(F.col(conv_col).alias("conv"), F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)).alias("score"))
    d = cut(placed(d, [], ["conv", "id", "role", "text"]).withColumnRenamed("_place", "key"), "messages")
    named = d.where("id is not null").groupBy(F.col("conv").alias("_conv"), F.col("id").alias("_id")).agg(F.min("key").alias("up"))
    met = d.join(named, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("parent") == F.col("_id")), "left")
    return _without_cycles(Tree(cut(met.select("key", "up", "conv", "role", "text", "score"), "replies")))


def _double(steps: DataFrame) -> DataFrame:
    """steps(key, up, score, size, least) over twice the distance. Messages that have reached their root wait."""
    going = steps.where("up is not null")
    far = steps.select(F.col("key").alias("_key"), F.col("up").alias("_up"), F.col("score").alias("_score"), F.col("size").alias("_size"), F.col("least").alias("_least"))
    moved = going.join(far, F.col("up") == F.col("_key")).select("key", F.col("_up").alias("up"), (F.col("score") + F.col("_score")).alias("score"), (F.col("size") + F.col("_size")).alias("size"), F.least("least", "_least").alias("least"))
    return moved.unionByName(steps.where("up is null"))


def _steps(tree: Tree, most: int) -> list[DataFrame]:
    """Tables of 1, 2, 4, … steps up, until no message has that many above it, or most steps are taken.

    score and size sum over the messages passed, itself included; least is the smallest key among those above.
    """
    out = [cut(tree.nodes.select("key", "up", "score", F.lit(1).cast("long").alias("size"), F.col("up").alias("least")), "steps")]
    while out[-1].where("up is not null").take(1) and 1 << (len(out) - 1) <= most:
        out.append(cut(_double(out[-1]), f"steps-{1 << len(out)}"))
    return out


def _without_cycles(tree: Tree) -> Tree:
    """The smallest key of each cycle loses its parent. A message is on a cycle if it is above itself."""
    total = tree.nodes.count()
    last = _steps(tree, total)[-1]
    first = last.where("up is not null and least = key").select(F.col("key").alias("_key"))
    if not first.take(1):
        return tree
    d = tree.nodes.join(first, F.col("key") == F.col("_key"), "left")
    return Tree(cut(d.withColumn("up", F.when(F.col("_key").isNull(), F.col("up"))).drop("_key"), "acyclic"))


def paths(tree: Tree, top: int | None = None) -> DataFrame:
    """path (its leaf's key), rank (from 1 within the conversation), path_score, pos (from 0), key, conv, role, text of every message of the chosen paths.

    A path's score is the sum of its messages'. top paths of each conversation are chosen, all by default.
    """
    total = tree.nodes.count()
    steps = _steps(tree, total)
    whole = steps[-1].select("key", "score", "size")
    leaves = tree.nodes.select("key", "conv").join(tree.nodes.where("up is not null").select(F.col("up").alias("key")), "key", "left_anti").join(whole, "key")
    chosen = cut(_ranked(leaves, top), "paths")
    d = chosen.select(F.col("key").alias("path"), "rank", F.col("score").alias("path_score"), "key", (F.col("size") - 1).alias("pos"))
    for k in range(len(steps) - 1, -1, -1):
        up = steps[k].where("up is not null").select(F.col("key").alias("_key"), F.col("up").alias("_up"))
        both = F.array(F.struct("key", "pos"), F.struct(F.col("_up").alias("key"), (F.col("pos") - (1 << k)).alias("pos")))
        d = d.join(up, F.col("key") == F.col("_key"), "left").select("path", "rank", "path_score", F.inline(F.filter(both, lambda x: x["key"].isNotNull())))
    return d.join(tree.nodes.select("key", "conv", "role", "text"), "key").select("path", "rank", "path_score", "pos", "key", "conv", "role", "text")


def _ranked(leaves: DataFrame, top: int | None) -> DataFrame:
    """leaves with rank: by score, then key, within conv."""
    d = cut(leaves.withColumn("_worse", -F.col("score")), "leaves")
    return placed(d, ["conv"], ["_worse", "key"]).withColumn("rank", (F.col("_place") + 1).cast("long")).drop("_place", "_n", "_worse").where(F.lit(True) if top is None else F.col("rank") <= top)


_SEGMENT = "path long, segment long, formatted string, spans array<struct<start:bigint,length:bigint,loss:boolean>>"


def formatted(messages: DataFrame, learn: Sequence[str] = ("assistant",), segment_chars: int = 1 << 18) -> DataFrame:
    """conv, rank, path, segment (ascending along the conversation), formatted and spans of every segment of every path.

    spans are the places of the turns' texts in formatted, in code points, and whether their loss counts.
    """
    head = F.concat(F.lit(f"{BEGIN} "), escaped(F.col("role"), True), F.lit(": "))
    turns = cut(messages.select("conv", "rank", "path_score", "path", "pos", head.alias("head"), escaped(F.col("text")).alias("body"), F.coalesce(F.col("role").isin(*learn), F.lit(False)).alias("loss")), "turns")
    d = turns.select("path", "pos", "head", "body", "loss").repartitionByRange("path", "pos").sortWithinPartitions("path", "pos")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, path, first, parts, spans, at = [], None, 0, [], [], 0

        def ready(least: int) -> Iterator[pa.RecordBatch]:
            if rows and sum(len(r[2]) for r in rows) >= least:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "segment", "formatted", "spans"])
                rows.clear()

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("loss", pa.bool_())]))]
        for b in batches:
            for p, pos, head, body, loss in zip(*(c.to_pylist() for c in b.columns), strict=True):
                turn = f"{head}{body}{END}\n"
                if parts and (p != path or at + len(turn) > segment_chars):
                    rows.append((path, first, "".join(parts), spans))
                    yield from ready(segment_chars)
                    parts, spans, at = [], [], 0
                if not parts:
                    path, first = p, pos
                spans.append({"start": at + len(head), "length": len(body), "loss": loss})
                parts.append(turn)
                at += len(turn)
        if parts:
            rows.append((path, first, "".join(parts), spans))
        yield from ready(0)

    of = turns.where("pos = 0").select(F.col("path").alias("_path"), "conv", "rank", "path_score")
    return d.mapInArrow(B.frugal(gather), _SEGMENT).join(of, F.col("path") == F.col("_path")).select("conv", "rank", "path_score", "path", "segment", "formatted", "spans")


def turns_of(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted segment."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    return out


_READ = "path long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(segments: DataFrame) -> DataFrame:
    """conv and, from the formatted text of each path: n_turns, digests of its turns and of its learned texts, and sizes.

    A digest runs over a path from end to end, so one task reads a path, segment by segment, holding one of them.
    """
    d = segments.select("path", "segment", "formatted", "spans").repartition("path").sortWithinPartitions("path", "segment")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, state, out = None, None, []
        new = lambda: [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
        done = lambda: out.append((path, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
        for b in batches:
            for p, text, spans in zip(*(b.column(c).to_pylist() for c in ("path", "formatted", "spans")), strict=True):
                if p != path:
                    if state:
                        done()
                    path, state = p, new()
                for role, said in turns_of(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for s in spans:
                    if s["loss"]:
                        said = unescaped(text[s["start"] : s["start"] + s["length"]])
                        state[2] += len(said)
                        state[3].update(said.encode())
                state[4] += len(text)
            if len(out) > 10_000:
                yield _batch(out)
                out.clear()
        if state:
            done()
        yield _batch(out)

    of = segments.select(F.col("path").alias("_path"), "conv", "rank").distinct()
    return d.mapInArrow(B.frugal(digests), _READ).join(of, F.col("path") == F.col("_path")).drop("_path", "path")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in _READ.split(", ")])
