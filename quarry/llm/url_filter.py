"""URL filter: path rules first, then a weighted vocabulary found by an Aho-Corasick automaton.

A rule is (verdict, host, path): it fits its host and all subdomains where the url's path starts with the
rule's path; the longest fitting rule decides. A url without a fitting rule is searched for vocabulary terms
(A-Z lower-cased, whole url). A hit counts only if the characters beside it are not letters or digits. One
strict hit, or soft hits of at least ``min_soft`` different terms, block the url.

Defined cases: a null url, or one without ``://``, has an empty host and path and no rule; null and empty urls
are allowed by the vocabulary; repeated rows are judged alike; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The vocabulary. A strict term blocks alone, soft terms only several together.
STRICT = ("adultcam", "bestiality", "camgirl", "camgirls", "escort", "escorts", "hentai", "hookup", "milf", "nude", "nudes", "porn", "porno", "pornstar", "sexcam", "sexchat", "sexy", "webcamsex", "xrated", "xxx")
SOFT = ("adult", "bet", "betting", "bonus", "cash", "casino", "cheap", "dating", "free", "gambling", "jackpot", "loan", "loans", "lottery", "pharma", "pills", "poker", "replica", "slots", "torrent", "viagra", "warez", "win")

Rule = tuple[str, str, str]


def rule_name(rule: Rule) -> str:
    return rule[1] + rule[2]


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as struct<rule, verdict>, else null."""
    out = None
    for r in sorted(rules, key=lambda r: -len(rule_name(r))):
        fits = ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])
        then = F.struct(F.lit(rule_name(r)).alias("rule"), F.lit(r[0]).alias("verdict"))
        out = F.when(fits, then) if out is None else out.when(fits, then)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


_machines: dict = {}


def _machine(strict: tuple[str, ...], soft: tuple[str, ...]):
    if (strict, soft) not in _machines:
        import ahocorasick

        m = ahocorasick.Automaton()
        for kind, terms in ((0, soft), (1, strict)):
            for t in terms:
                m.add_word(t.lower(), (kind, t.lower()))
        m.make_automaton()
        _machines[strict, soft] = m
    return _machines[strict, soft]


def hits(url: str | None, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT) -> tuple[int, int]:
    """(strict hits, different soft terms hit), both with whole-term boundaries."""
    if not url:
        return 0, 0
    low = url.translate(_LOWER)
    n, found = 0, set()
    for end, (kind, term) in _machine(strict, soft).iter(low):
        start = end - len(term)
        if (start < 0 or not low[start].isalnum()) and (end + 1 == len(low) or not low[end + 1].isalnum()):
            if kind:
                n += 1
            else:
                found.add(term)
    return n, len(found)


_LOWER = str.maketrans(UPPER, LOWER)


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = (), strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, min_soft: int = 2, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict (allow or block), strict_hits, soft_terms."""
    strict, soft = tuple(strict), tuple(soft)

    @F.pandas_udf("struct<strict:int,soft:int>")
    def counted(url: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([hits(u, strict, soft) for u in url], columns=["strict", "soft"], dtype="int32")

    host, path = host_path(F.col("_url"))
    d = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    d = d.select("_id", "_url", host.alias("host"), path.alias("path"))
    d = d.withColumn("_r", fitting_rule(F.col("host"), F.col("path"), rules))
    d = d.withColumn("_h", counted("_url"))
    bad = (F.col("_h.strict") > 0) | (F.col("_h.soft") >= min_soft)
    return d.select(
        F.col("_id").alias("id"), "host", "path", F.col("_r.rule").alias("rule"),
        F.coalesce(F.col("_r.verdict"), F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.col("_h.strict").alias("strict_hits"), F.col("_h.soft").alias("soft_terms"),
    )
