"""Collections as a table: list, look up, register, remove; and summaries of a collection's chunks."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SOURCES = ("confluence", "mediawiki")
SCHEMA = "name string, title string, source string, description string, config map<string,string>"


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Settings:
    """Driver-side settings; from_env reads them from environment variables."""

    confluence_base_url: str = ""
    confluence_token: str = field(default="", repr=False)
    confluence_parent_page_id: str = ""
    wiki_api_url: str = ""
    wiki_base_url: str = ""
    wiki_category: str = ""
    wiki_titles: tuple[str, ...] = ()
    wiki_page_limit: int = 50
    use_hybrid: bool = True
    hybrid_alpha: float = 0.5
    top_k: int = 20
    min_score: float = 0.20
    context_k: int = 5

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ if env is None else env)
        out = {}
        for name, f in cls.__dataclass_fields__.items():
            if (v := env.get(name.upper())) not in (None, ""):
                kind = type(f.default)
                out[name] = tuple(x.strip() for x in v.split(",") if x.strip()) if kind is tuple else v.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(v)
        return cls(**out)

    def require(self, *names: str) -> None:
        lacking = [n for n in names if not getattr(self, n)]
        if lacking:
            raise ConfigError(f"these settings are needed: {', '.join(lacking)}")


def listed(registry: DataFrame, indexed: DataFrame, golden: DataFrame) -> DataFrame:
    """The registry, default first, with has_index and has_golden. indexed, golden: a column name."""
    flag = lambda d, c: d.select("name").distinct().withColumn(c, F.lit(True))
    out = registry.join(flag(indexed, "has_index"), "name", "left").join(flag(golden, "has_golden"), "name", "left").fillna(False, ["has_index", "has_golden"])
    return out.orderBy((F.col("name") != "default"), "name")


def or_default(registry: DataFrame) -> DataFrame:
    """The registry, or one with the default collection alone if nothing was ever registered."""
    return registry if registry.take(1) else registry.sparkSession.createDataFrame([("default", "Default", "confluence", "", {})], SCHEMA)


def get(registry: DataFrame, name: str) -> dict:
    row = registry.where(F.col("name") == name).first()
    if row is None:
        raise ConfigError(f"there is no collection {name!r}")
    return row.asDict(recursive=True)


def register(registry: DataFrame, name: str, title: str, source: str, description: str = "", **config: str) -> DataFrame:
    """The registry with this entry, in place of one of the same name."""
    if name == "default":
        raise ConfigError("the name 'default' is reserved")
    if source not in SOURCES:
        raise ConfigError(f"a source is one of {', '.join(SOURCES)}")
    new = registry.sparkSession.createDataFrame([(name, title, source, description, {k: str(v) for k, v in config.items()})], SCHEMA)
    return registry.where(F.col("name") != name).unionByName(new)


def remove(registry: DataFrame, name: str) -> DataFrame:
    if name == "default":
        raise ConfigError("the default collection stays")
    return registry.where(F.col("name") != name)


def source_options(entry: dict, env: dict[str, str] | None = None) -> dict[str, str]:
    """Options for spark.read.format(entry['source']); a token is named by its environment variable, titles by commas."""
    env = dict(os.environ if env is None else env)
    out = {k: v for k, v in (entry.get("config") or {}).items() if k != "token_env" and v is not None}
    token = (entry.get("config") or {}).get("token_env")
    return out | ({"token": env[token]} if token and token in env else {})


def page_summary(chunks: DataFrame) -> DataFrame:
    """page_id, title, status and owner of its first chunk, and its number of chunks."""
    return chunks.groupBy("page_id").agg(*[F.min_by(c, "vector_id").alias(c) for c in ("title", "status", "owner") if c in chunks.columns], F.count(F.lit(1)).alias("chunks"))


def corpus_counts(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("page_id").alias("pages"), (F.count(F.lit(1)) > 0).alias("index_ready"))


def diagnostics(ranked: DataFrame) -> DataFrame:
    """For each question: chunks, pages, mean and least similarity, chunks with a BM25 score."""
    return ranked.groupBy("qid").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("page_id").alias("pages"), F.avg("embedding_score").alias("avg_similarity"), F.min("embedding_score").alias("min_similarity"), F.count_if(F.coalesce("bm25_score", F.lit(0.0)) > 0).alias("bm25_matches"))


def history_top(history: DataFrame, most: int = 200) -> DataFrame:
    """The newest asks first, at most so many."""
    return history.orderBy(F.desc("ts"), F.desc("ask_id")).limit(most)
