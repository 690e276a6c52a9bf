"""A search index that is kept up to date in segments.

Each change of pages adds a segment: blocks of postings of the new chunks, the chunks themselves, what the change adds to and
takes from the statistics, and tombstones for the chunks that it replaces, which stay in the blocks of older segments. Statistics are
sums over segments, so search over segments gives what an index built anew would give. Segments are named by a log of
commits: a change is seen whole or not at all. Compaction builds one segment of what is alive.

Defined cases: a page with several changes at once must come as one set of chunks; a page that has no chunks any more is named among the
pages and loses all it had; naming a page that the index never had changes nothing; a chunk without text is found by nothing but counts as a document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import sparse
from quarry.operators.numbering import numbered
from quarry.session import ready
from quarry.sources.snapshots import Log

PARTS = ("blocks", "counts", "sizes", "dead", "chunks")


def page_text() -> Column:
    return X.page_text(*[F.col(c) for c in ("title", "section", "heading_path", "breadcrumb", "text")])


@dataclass(frozen=True)
class SegmentedIndex:
    """chunks have page_id, chunk_number and what text is made of; text is called for the Column that is indexed."""

    spark: SparkSession
    path: str
    text: Callable[[], Column] = page_text

    @property
    def log(self) -> Log:
        return Log(self.spark, self.path)

    def _read(self, manifest: dict | None, part: str) -> DataFrame | None:
        """One part of all segments."""
        if not manifest or not manifest["segments"]:
            return None
        return self.spark.read.parquet(*[f"{self.path.rstrip('/')}/{s}/{part}" for s in manifest["segments"]])

    def _dead(self, manifest: dict) -> DataFrame:
        return self._read(manifest, "dead").groupBy("block").agg(F.flatten(F.collect_list("dead")).alias("dead"))

    def chunks(self, version: int | None = None) -> DataFrame:
        """The chunks that are alive, with their vector_id."""
        return self._alive(self.log.manifest(version))

    def _alive(self, manifest: dict) -> DataFrame:
        d = self._read(manifest, "chunks")
        gone = self._read(manifest, "dead").select(F.explode("ids").alias("vector_id"))
        return d.join(gone, "vector_id", "left_anti").select(d.columns)

    def index(self, version: int | None = None) -> sparse.SparseIndex:
        """What sparse.search needs, as of the newest commit or an earlier one."""
        m = self.log.manifest(version)
        sums = self._read(m, "sizes").agg(F.sum("documents").alias("n"), F.sum("tokens").alias("tokens"))
        corpus = sums.select("n", F.try_divide("tokens", "n").alias("avgdl"))
        counts = self._read(m, "counts").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return sparse.SparseIndex(self._read(m, "blocks"), sparse.weighed(counts, corpus), corpus, self._dead(m))

    def apply(self, chunks: DataFrame, pages: DataFrame, mark: dict | None = None) -> int:
        """Commits chunks as all that their pages have now; pages(page_id) names every page that changed, went or became empty.

        mark is kept in the manifest (the number of a stream's batch, say). Returns the commit's number.
        """
        ready(self.spark)
        named = pages.select("page_id").union(chunks.select("page_id")).distinct()
        return self.log.change(lambda m: self._segment(m, chunks, named, mark))

    def compact(self) -> int:
        """Commits one segment of all that is alive. Chunks keep their vector_id."""
        return self.log.change(lambda m: self._segment(None, self._alive(m), None, m.get("mark"), m["next_id"], m["next_segment"]))

    def _segment(self, m: dict | None, chunks: DataFrame, named: DataFrame | None, mark: dict | None, next_id: int | None = None, number: int | None = None) -> dict:
        m = m or {"segments": [], "next_id": 0, "next_segment": number or 0}
        place = self.log.folder(f"segment-{m['next_segment']}")
        put = lambda d, part: d.write.parquet(f"{place}/{part}")
        back = lambda part: self.spark.read.parquet(f"{place}/{part}")
        put(chunks if next_id is not None else numbered(chunks.drop("vector_id"), ["page_id", "chunk_number"], "vector_id", m["next_id"]), "chunks")
        put(sparse.gather(back("chunks").select(F.col("vector_id").alias("id"), self.text().alias("text")), m["next_segment"]), "blocks")
        blocks = back("blocks")
        counts, sizes = sparse.document_counts(blocks), sparse.sizes(blocks)
        dead = self.spark.createDataFrame([], "block long, dead array<int>, ids array<bigint>")
        if m["segments"] and named is not None:
            gone = self._alive(m).join(named, "page_id", "left_semi").select(F.col("vector_id").alias("id"))
            held = self._read(m, "blocks")
            at = held.select("block", F.posexplode("ids").alias("at", "id")).join(gone, "id")
            put(at.groupBy("block").agg(F.collect_list("at").alias("dead"), F.collect_list("id").alias("ids")), "dead")
            dead = back("dead")
            touched = held.join(dead.select("block"), "block", "left_semi").select(held.columns)
            lost = sparse.postings(touched, dead.select("block", "dead"), kept=False)
            counts = counts.unionByName(lost.groupBy("term").agg((-F.count(F.lit(1))).alias("df")))
            lengths = touched.join(dead.select("block", "dead"), "block").select(F.explode("dead").alias("at"), "lengths").select(F.get("lengths", "at").cast("long").alias("n"))
            sizes = sizes.unionByName(lengths.agg((-F.count(F.lit(1))).alias("documents"), F.coalesce(-F.sum("n"), F.lit(0)).alias("tokens")))
        else:
            put(dead, "dead")
        put(counts.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"), "counts")
        put(sizes.agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")), "sizes")
        after = next_id if next_id is not None else m["next_id"] + back("chunks").count()
        return {"segments": [*m["segments"], place.rsplit("/", 1)[1]], "next_id": after, "next_segment": m["next_segment"] + 1, "mark": mark if mark is not None else m.get("mark")}
