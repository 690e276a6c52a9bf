r"""Quality rules as a short-circuit cascade, with DataFrame functions only.

``measure`` takes the statistics of each whole text in one pass. ``order_rules`` estimates each rule's cost and
counts its rejections on a bounded sample, and sorts the rules by rejections per second; ``cascade`` then tests them in
that order in one nested CASE, so a document that an early rule rejects pays for no later one. The order changes the
cost alone: a document is kept if no rule rejects it.

A rule's cost is what it adds to a job that reads the cached sample so often that ``timed_bytes`` go by: the least of several timings, so that
compilation and other work of the machine drop out, less the least of the same job without a rule, so that starting a job
does too. What is under half of that job can't be told from noise and counts as half; costs within a factor of two count as
equal, and equal rules keep the order in which they are listed; so the order does not hang on the clock's noise. Rules read the statistics that are there and count nothing again.

Words are ``[^\x20\x09-\x0D]+``. Defined cases: null and empty texts have no words (all statistics 0) and fail
the base rule; texts under eight words have no windows; a text of any length is measured whole; repeated rows
are judged alike; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import itertools
import math
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """rejects: of the text and its statistics by name (STATISTICS), true where the document is to go."""

    name: str
    rejects: object = field(compare=False)


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _share(text: Column, java_class: str, limit: float) -> Column:
    """Whether characters of the class make up more than the limit of the text."""
    return F.length(F.regexp_replace(text, f"[^{java_class}]+", "")) > F.length(text) * F.lit(limit)


def _lines(text: Column) -> Column:
    return 1 + F.length(text) - F.length(F.translate(text, "\n", ""))


#: Production rules. Thresholds leave ordinary prose of any language alone.
RULES = (
    Rule("base", lambda text, s: base_failed(s["n_words"], s["n_repeat_words"])),
    Rule("long_words", lambda text, s: s["word_chars"] > s["n_words"] * F.lit(25)),
    Rule("short_words", lambda text, s: s["word_chars"] < s["n_words"] * F.lit(2)),
    Rule("symbols", lambda text, s: s["n_symbols"] > s["n_words"] * F.lit(0.1)),
    Rule("lorem", lambda text, s: F.contains(F.lower(text), F.lit("lorem ipsum"))),
    Rule("few_letters", lambda text, s: F.length(F.regexp_replace(text, r"\P{L}+", "")) < s["word_chars"] * F.lit(0.5)),
    Rule("digits", lambda text, s: _share(text, r"0-9", 0.3)),
    Rule("capitals", lambda text, s: _share(text, r"\p{Lu}", 0.5)),
    Rule("bullets", lambda text, s: F.regexp_count(text, F.lit(r"(?m)^[\t ]*[-*•]")) > F.lit(0.9) * _lines(text)),
    Rule("ellipses", lambda text, s: F.regexp_count(text, F.lit(r"(?m)(\.\.\.|…)[\t ]*$")) > F.lit(0.3) * _lines(text)),
)


def _row(docs: DataFrame, wanted: bool) -> list[Column]:
    return [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if wanted else []


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, whole_rows: bool = False) -> DataFrame:
    """id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each whole text, and the row itself if asked for."""
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *_row(docs, whole_rows))
    d = d.withColumn("_words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    d = d.withColumn("n_words", F.size("_words").cast("long"))
    starts = F.sequence(F.lit(1), F.col("n_words").cast("int") - F.lit(window - 1))
    d = d.withColumn("_each", F.transform("_words", lambda w: F.xxhash64(w)))
    hashes = F.when(F.col("n_words") >= window, F.transform(starts, lambda i: F.xxhash64(F.slice("_each", i, window)))).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("_hashes", hashes)
    d = d.withColumn("_lines", F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))))
    return d.select(
        "id", "text", *(["row"] if whole_rows else []), "n_words",
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_hashes")) == F.size("_hashes"), F.lit(0)).otherwise(_covered(F.col("_hashes"), window)).cast("long").alias("n_repeat_words"),
    )


def _covered(hashes: Column, window: int) -> Column:
    """Words that lie in a window whose hash stands in the array twice or more."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    at = lambda xs, i: F.get(xs, i)["h"]
    twice = lambda xs: F.filter(F.transform(xs, lambda x, i: F.when(x["h"].eqNullSafe(at(xs, i - 1)) | x["h"].eqNullSafe(at(xs, i + 1)), x["i"])), lambda p: p.isNotNull())
    positions = F.transform(F.array(pairs), lambda xs: F.array_sort(twice(xs)))
    gaps = F.transform(positions, lambda ps: F.transform(ps, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(ps, i + 1) - p, F.lit(window)))))
    return F.aggregate(F.get(gaps, 0), F.lit(0), lambda a, x: a + x)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def order_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 2000, sample_bytes: int = 16 << 20, timed_bytes: int = 16 << 20, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[Rule, float, float]]:
    """(rule, seconds, rejected share) on the sample, by rejections per cost. The sample orders the rules and decides nothing else.

    The sample is the table's first rows, at most sample_rows of them and those whose texts together take at most sample_bytes.
    """
    spark = docs.sparkSession
    # collect() of a limit reads as few partitions as it needs. Sizes come first, so that the texts that follow are bounded.
    text = F.coalesce(F.col(text_col), F.lit(""))
    sizes = [r["n"] for r in docs.select(F.octet_length(text).alias("n")).limit(sample_rows).collect()]
    within = sum(total <= sample_bytes for total in itertools.accumulate(sizes))
    some = docs.select(text.alias("text")).limit(max(1, within)).collect()
    used = sum(sizes[: len(some)])
    given = spark.createDataFrame(some, "text string").withColumn("id", F.lit(0).cast("long"))
    d = measure(given, "id", "text").select("text", *STATISTICS).cache()
    stats = {c: F.col(c) for c in STATISTICS}
    try:
        rows, passes = d.count(), min(2000, 1 + timed_bytes // max(used, 1))
        # Rows are repeated by a generator, below which the optimizer does not move a rule as it does below a join.
        again = d.select("text", *STATISTICS, F.explode(F.sequence(F.lit(1), F.lit(passes))).alias("pass"))
        tests = [F.col("n_words") < 0, *(r.rejects(F.col("text"), stats) for r in rules)]
        least, counts = _least_times(again, tests, rounds)
    finally:
        d.unpersist()
    shares = {r: n / max(rows * passes, 1) for r, n in zip(rules, counts[1:], strict=True)}
    costs = {r: max(t - least[0], least[0] / 2) / passes for r, t in zip(rules, least[1:], strict=True)}
    value = lambda r: round(math.log2(shares[r] / 2 ** round(math.log2(costs[r])))) if shares[r] else -math.inf
    place = {r: i for i, r in enumerate(rules)}
    # Rules that reject nothing here go last.
    return sorted(((r, costs[r], shares[r]) for r in rules), key=lambda x: (-value(x[0]), place[x[0]]))


def _least_times(rows: DataFrame, tests: list[Column], rounds: int) -> tuple[list[float], list[int]]:
    """The shortest of several timings of each test over the rows, taken in turns after a first one, and how many it holds for."""
    least, counts = [math.inf] * len(tests), [0] * len(tests)
    for k in range(rounds + 1):
        for i, test in enumerate(tests):
            began = time.perf_counter()
            counts[i] = rows.agg(F.count_if(test)).first()[0]  # a new plan each time: an old one would keep its shuffled rows
            least[i] = min(least[i], time.perf_counter() - began) if k else math.inf
    return least, counts


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text", whole_rows: bool = False) -> DataFrame:
    """id, the statistics of ``measure``, base_failed, kept, and the row itself if asked for."""
    # The row number keeps Catalyst from moving rules or filters below the statistics, where each mention would take them again.
    d = measure(docs, id_col, text_col, whole_rows=whole_rows).withColumn("_at", F.monotonically_increasing_id())
    d = d.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    gone, stats = None, {c: F.col(c) for c in STATISTICS}
    for r, _, _ in order_rules(docs, rules, sample_rows, id_col=id_col, text_col=text_col):
        test = F.coalesce(r.rejects(F.col("text"), stats), F.lit(False))
        gone = F.when(test, F.lit(True)) if gone is None else gone.when(test, F.lit(True))
    failed = F.col("base_failed")
    return d.withColumn("kept", ~(failed if gone is None else failed | gone.otherwise(F.lit(False))) & (F.col("_at") >= 0)).drop("text", "_at")


def reject(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns, that the cascade keeps."""
    d = cascade(docs, rules, sample_rows, id_col, text_col, whole_rows=True)
    return d.where("kept").select("row.*")
