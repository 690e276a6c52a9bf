"""Merkle manifest of a dataset with lookup proofs by coordinates.

Every row is a leaf: the digest of its fields, each written as its UTF-8 byte count, ``:`` and its value, or ``-`` for
null. Rows of one group (a language) form a tree, in order of their id: each run of FAN consecutive nodes becomes the
digest of their digests, until one node, the subroot, remains. Subroots in order of their group form one more tree, whose
top is the root. All nodes are kept in a table (tree, level, pos, digest).

A proof is looked up, not walked: from a node's place and the tree's size follow the coordinates of the siblings that it
needs, which are exploded, looked up in the node table and put in order. The node table is joined a page at a time: the 64 nodes
of a level that share the node two levels up, and their 8 parents, hold all that any of them asks for on two levels. What lies
above is the same for the whole page, so the node two levels up asks for it once and passes it down with its page. So a leaf moves
once, no key of a join has more than 64 rows, whatever the size of the tree, and the number of rounds is the tree's height. The
proof folds back to a root by hashing the leaf with its siblings level by level.

Defined cases: a null field is ``-``, which no value gives, so null and empty text differ; a null group is a tree of its own
and the first; null ids come first in their tree; rows with equal ids go by their leaf's digest; equal rows are separate
leaves; a tree of one leaf has the leaf as its subroot and, if it is the only tree, as the root, and an empty proof; an
empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.places import placed
from quarry.session import cut

FAN = 8
BITS = 3  # FAN is 2 ** BITS
PAGE = 2  # levels that a node asks for itself
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_TOP = -1  # the tree of subroots


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    v = value.cast("string")
    return F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))


def leaf(values: Sequence[Column]) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def _hex(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def _down(pos: Column, levels: Column | int) -> Column:
    """The place of the node so many levels above."""
    return F.call_function("shiftright", pos, F.lit(levels) * BITS if isinstance(levels, int) else (levels * BITS).cast("int"))


def height(n: Column) -> Column:
    """Levels above the leaves of a tree with n of them."""
    out = F.lit(0)
    for k in range(64 // BITS):
        out = out + (n > F.lit(FAN**k)).cast("int")
    return out


@dataclass(frozen=True)
class Manifest:
    """leaves(tree, pos, id, leaf, other), nodes(tree, level, pos, n, digest), trees(tree, n, subroot) and the nodes over the trees."""

    leaves: DataFrame
    nodes: list[DataFrame]
    trees: DataFrame
    top: list[DataFrame]


def grow(leaves: DataFrame) -> list[DataFrame]:
    """The levels of all trees, from leaves(tree, pos, n, digest); each level has the columns tree, level, pos, n, digest.

    A level is one aggregation of at most FAN rows a key, and has an eighth of the rows of the one below.
    """
    levels = [leaves.withColumn("level", F.lit(0))]
    most = leaves.agg(F.max(height(F.col("n")))).first()[0] or 0
    for k in range(most):
        run = F.array_sort(F.collect_list(F.struct("pos", "digest")))
        up = levels[-1].where(height(F.col("n")) > k).groupBy("tree", _down(F.col("pos"), 1).alias("up")).agg(run.alias("run"), F.max("n").alias("n"))
        hashed = digest(F.array_join(F.transform("run", lambda x: _hex(x["digest"])), ""))
        levels.append(cut(up.select("tree", F.col("up").alias("pos"), "n", F.unhex(hashed).alias("digest"), F.lit(k + 1).alias("level")), f"nodes-{k + 1}"))
    return levels


def build(docs: DataFrame, fields: Sequence[str] = FIELDS, group_col: str = "lang", id_col: str = "doc_id", other: dict[str, Column] | None = None) -> Manifest:
    """The manifest of docs. other: fields taken from these expressions for a second digest of the leaf, kept where it differs."""
    values = [F.col(f"`{c}`") for c in fields]
    changed = leaf([(other or {}).get(c, v) for c, v in zip(fields, values, strict=True)])
    rows = docs.select(F.col(f"`{group_col}`").alias("group"), F.col(f"`{id_col}`").alias("id"), leaf(values).alias("leaf"), (changed if other else F.lit(None).cast("string")).alias("other"))
    rows = rows.select("group", "id", F.unhex("leaf").alias("leaf"), F.when(F.col("other") != F.col("leaf"), F.unhex("other")).alias("other"))
    rows = placed(cut(rows, "leaves"), ["group"], ["id", "leaf"])
    groups = cut(placed(cut(rows.groupBy("group").agg(F.max("_n").alias("n")), "groups"), [], ["group"]), "trees")
    known = groups.select(F.col("group").alias("of"), F.col("_place").alias("tree"))
    leaves = cut(rows.join(known, F.col("group").eqNullSafe(F.col("of"))).select("tree", F.col("_place").alias("pos"), F.col("_n").alias("n"), "id", "leaf", "other"), "tree-leaves")
    nodes = grow(leaves.select("tree", "pos", "n", F.col("leaf").alias("digest")))
    roots = None
    for level in nodes:
        found = level.where(height(F.col("n")) == F.col("level")).select("tree", "n", "digest")
        roots = found if roots is None else roots.unionByName(found)
    many = groups.count()
    trees = cut(roots.select("tree", "n", F.col("digest").alias("subroot")), "subroots")
    top = grow(trees.select(F.lit(_TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(many).cast("long").alias("n"), F.col("subroot").alias("digest")))
    return Manifest(leaves, nodes, trees, top)


def siblings(pos: Column, n: Column, base: int) -> Column:
    """array<struct<level, at>>: the coordinates that the node at this level (base) and place needs from its tree, for PAGE levels.

    The run's others on each level, from the place and the tree's number of leaves alone.
    """

    def on(level: int) -> Column:
        own = _down(pos, level - base)
        width = F.call_function("shiftright", n + F.lit(FAN**level - 1), F.lit(BITS * level))
        first = own - F.pmod(own, F.lit(FAN))
        run = F.filter(F.sequence(first, F.least(first + (FAN - 1), width - 1)), lambda x: x != own)
        return F.when(height(n) > level, F.transform(run, lambda x: F.struct(F.lit(level).alias("level"), x.alias("at")))).otherwise(F.array().cast("array<struct<level:int,at:bigint>>"))

    return F.flatten(F.array(*[on(base + k) for k in range(PAGE)]))


def _pages(nodes: list[DataFrame], base: int) -> DataFrame:
    """tree, page, low, high: the node table by pages of level base, its digests on that level and on the next."""
    held = nodes[base].select("tree", "level", "pos", _down(F.col("pos"), PAGE).alias("page"), "digest")
    for k in range(base + 1, min(base + PAGE, len(nodes))):
        held = held.unionByName(nodes[k].select("tree", "level", "pos", _down(F.col("pos"), PAGE - (k - base)).alias("page"), "digest"))
    per = held.groupBy("tree", "page").agg(F.array_sort(F.collect_list(F.struct("level", "pos", "digest"))).alias("held"))
    on = lambda level: F.transform(F.filter("held", lambda x: x["level"] == level), lambda x: x["digest"])
    return per.select("tree", "page", *[on(base + k).alias(f"on_{k}") for k in range(PAGE)])


def _met(rows: DataFrame, nodes: list[DataFrame], base: int, above: DataFrame) -> DataFrame:
    """rows(tree, pos, n, …) of level base with steps (siblings left and right of it, level by level to the root) and what above carries.

    above: tree, pos, steps of the level PAGE above.
    """
    up = above.select(F.col("tree").alias("_tree"), F.col("pos").alias("_page"), F.col("steps").alias("_steps"), *[c for c in above.columns if c not in ("tree", "pos", "steps")])
    pages = _pages(nodes, base).join(up, (F.col("tree") == F.col("_tree")) & (F.col("page") == F.col("_page"))).drop("tree", "page")
    d = rows.where(height(F.col("n")) > base).join(pages, (F.col("tree") == F.col("_tree")) & (_down(F.col("pos"), PAGE) == F.col("_page")))
    place = lambda c, k: (c["at"] - F.call_function("shiftleft", F.col("_page"), F.lit(BITS * (PAGE - k)))).cast("int")
    found = F.transform(siblings(F.col("pos"), F.col("n"), base), lambda c: F.struct(c["level"].alias("level"), c["at"].alias("at"), F.coalesce(*[F.when(c["level"] == base + k, F.get(f"on_{k}", place(c, k))) for k in range(PAGE)]).alias("digest")))
    d = d.withColumn("_held", found)

    def step(level: int) -> Column:
        at = _down(F.col("pos"), level - base)
        side = lambda keep: F.array_join(F.transform(F.filter("_held", lambda x: (x["level"] == level) & keep(x["at"])), lambda x: _hex(x["digest"])), "")
        return F.struct(side(lambda x: x < at).alias("left"), side(lambda x: x > at).alias("right"))

    own = F.filter(F.array(*[F.when(height(F.col("n")) > base + k, step(base + k)) for k in range(PAGE)]), lambda x: x.isNotNull())
    return d.withColumn("steps", F.concat(own, "_steps")).drop("_tree", "_page", "_steps", "_held", *[f"on_{k}" for k in range(PAGE)])


def _ways(rows: DataFrame, nodes: list[DataFrame], ends: DataFrame) -> DataFrame:
    """rows(tree, pos, n, …), the leaves of nodes, with steps to the root and what ends carries.

    ends: tree, n, steps that follow the tree's top, and further columns.
    """
    carried = [c for c in ends.columns if c not in ("tree", "n", "steps")]
    last = ends.select("tree", F.lit(0).cast("long").alias("pos"), "steps", *carried, (F.ceil(height(F.col("n")) / F.lit(PAGE)) * PAGE).cast("int").alias("base"))
    at_base = lambda b: last.where(F.col("base") == b).drop("base")
    pages = -(-(len(nodes) - 1) // PAGE)
    above = at_base(pages * PAGE)
    for base in range((pages - 1) * PAGE, 0, -PAGE):
        above = cut(_met(nodes[base].select("tree", "pos", "n"), nodes, base, above).select("tree", "pos", "steps", *carried).unionByName(at_base(base)), f"ways-{base}")
    alone = rows.where(height(F.col("n")) == 0).join(at_base(0).drop("pos"), "tree")
    return alone if not pages else _met(rows, nodes, 0, above).select(*alone.columns).unionByName(alone)


def proofs(m: Manifest) -> DataFrame:
    """id, leaf, other (null where it is the leaf), subroot, root and steps (array<struct<left, right>>, from the leaf up) of every leaf."""
    none = F.array().cast("array<struct<left:string,right:string>>")
    text = [_hex(F.col(c)).alias(c) for c in ("leaf", "other", "subroot", "root")]
    if not m.top[0].take(1):
        return m.leaves.select("id", "leaf", "other", F.col("leaf").alias("subroot"), F.col("leaf").alias("root")).select("id", *text, none.alias("steps"))
    root = m.top[-1].select("tree", "n", none.alias("steps"), F.col("digest").alias("root"))
    over = _ways(m.top[0].select("tree", "pos", "n"), m.top, root).select(F.col("pos").alias("tree"), "steps", "root")
    ends = cut(over.join(m.trees, "tree").select("tree", "n", "steps", "subroot", "root"), "ends")
    return _ways(m.leaves, m.nodes, ends).select("id", *text, "steps")


def fold(start: Column, steps: Column) -> Column:
    """The root that the digest start and the siblings give."""
    return F.aggregate(steps, start, lambda now, s: digest(F.concat(s["left"], now, s["right"])))


def proof_digest(steps: Column) -> Column:
    """The digest of all siblings from the leaf's level to the root's, left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""))
