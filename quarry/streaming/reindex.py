"""Incremental re-indexing: a stream of changed pages, each micro-batch cleaned, chunked, embedded and committed as one segment of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators import documents, embedding
from quarry.plans.segments import SegmentedIndex
from quarry.session import cut


def prepared(pages: DataFrame, embedder: embedding.Embedder = embedding.hashing_embedder) -> tuple[DataFrame, DataFrame]:
    """(chunks with embeddings, page_id of every page that was read) of pages(page_id, html, …).

    A page that cannot be read (by its html or its metadata) is not among them, so the index keeps what it had of it. A page
    whose column deleted, if there is one, is true has no chunks.
    """
    gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in pages.columns else F.lit(False)
    d = documents.with_metadata(documents.clean_pages(pages.withColumn("_gone", gone)).drop("html"))
    d = cut(d.where("_gone or (error is null and metadata_error is null)").drop("error", "headings", "custom_fields", "metadata_error", "deleted"), "prepared")
    return embedding.embed(documents.chunk_pages(d.where("not _gone").drop("_gone")), embedder), d.select("page_id")


def newest(pages: DataFrame, by: str | None) -> DataFrame:
    """One row of each page: the last by this column, where a batch holds several."""
    every = F.struct(*[F.col(c) for c in pages.columns])
    order = F.struct(*([F.col(by)] if by else []), F.xxhash64(*[c for c in pages.columns if c != "page_id"]))
    return pages.groupBy(F.col("page_id").alias("_id")).agg(F.max_by(every, order).alias("row")).select("row.*")


def start(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, embedder: embedding.Embedder = embedding.hashing_embedder, format: str = "parquet", changed_at: str | None = None) -> StreamingQuery:
    """Follows the source folder. A batch that is run again after its commit is known by its number and left out.

    changed_at: the column by which the last of several rows of a page is known.
    """
    index = SegmentedIndex(spark, target)

    def write(batch: DataFrame, n: int) -> None:
        mark = (index.log.manifest() or {}).get("mark") or {}
        if mark.get("batch", -1) < n:
            index.apply(*prepared(newest(batch, changed_at), embedder), mark={"batch": n})

    return spark.readStream.format(format).schema(schema).load(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The chunks that the index holds now."""
    return SegmentedIndex(spark, target).chunks()
