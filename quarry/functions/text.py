"""Text functions as Column expressions: tokens, word counts, snippets, Markdown clean-up and field names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import markup

# Words that retrieval ignores.
STOP_WORDS = (
    "what", "is", "are", "the", "a", "an", "of", "to", "in", "on", "for", "with", "who", "how", "where", "when", "which", "why",
    "does", "do", "did", "can", "could", "should", "would", "please", "show", "tell", "me", "about",
)

WORD = r"[\p{L}\p{N}_]+"


def _stops() -> Column:
    return F.array(*[F.lit(w) for w in STOP_WORDS])


def tokens(text: Column) -> Column:
    """Lower-case ASCII letter and digit runs without stop words, duplicates kept; null gives none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda x: ~F.array_contains(_stops(), x))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def word_count(text: Column) -> Column:
    """Unicode word runs."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD))


def split_count(text: Column) -> Column:
    """Words between white space, as page metadata counts them."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def squeeze(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "), F.lit(" "))


def snippet(text: Column, limit: int = 240) -> Column:
    clean = squeeze(text)
    cut = F.concat(F.regexp_replace(F.substring(clean, 1, limit), r" [^ ]*$", ""), F.lit(" ..."))
    return F.when(F.length(clean) <= limit, clean).otherwise(cut)


def tidy_markdown(text: Column) -> Column:
    """Drops carriage returns, then caps blank lines, then trims line ends, in this order; then trims the whole."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit(""))
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"[ \t]+\n", "\n")
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def drop_hidden_tags(html: Column) -> Column:
    """Without script, style and noscript elements and meta tags; other markup stays."""
    out = F.coalesce(html, F.lit(""))
    for tag in ("script", "style", "noscript"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return F.regexp_replace(out, r"(?is)<meta\b[^>]*>", "")


def strip_markdown(text: Column) -> Column:
    """Images to their alternative text, links to their text, emphasis and code unwrapped, pipes unescaped.

    Paired single underscores count as emphasis inside identifiers too: a_b_c gives abc.
    """
    out = F.coalesce(text, F.lit(""))
    for pattern, to in markup.INLINE:
        out = F.regexp_replace(out, "(?d)" + pattern, to.replace("{", "$").replace("}", ""))
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def field_name(text: Column) -> Column:
    out = F.lower(strip_markdown(text))
    out = F.regexp_replace(out, r"[\s-]+", "_")
    return F.btrim(F.regexp_replace(out, r"[^a-z0-9_]", ""), F.lit("_"))


def cell_text(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for mark in markup.BREAKS:
        out = F.replace(out, F.lit(mark), F.lit(" "))
    return F.btrim(F.regexp_replace(strip_markdown(out), r"\s+", " "))


def page_text(title: Column, section: Column, heading_path: Column, breadcrumb: Column, text: Column) -> Column:
    """What the sparse index sees of a chunk: its non-empty fields joined by spaces."""
    some = lambda c: F.nullif(c, F.lit(""))
    path = F.array_join(heading_path, " ")
    return F.concat_ws(" ", some(title), some(section), some(path), some(breadcrumb), some(text))


def match_score(wanted: Column, text: Column) -> Column:
    """Share of the wanted tokens among the text's tokens; 0 without wanted tokens."""
    hit = F.size(F.array_intersect(wanted, token_set(text)))
    return F.when(F.size(wanted) > 0, hit / F.size(wanted)).otherwise(F.lit(0.0))


def keyword_overlap(wanted: Column, text: Column) -> Column:
    """Share of the wanted tokens that stand anywhere inside the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.size(F.filter(wanted, lambda t: F.contains(low, t))) / F.greatest(F.size(wanted), F.lit(1))


def phrase_score(question: Column, text: Column) -> Column:
    """1 if the whole trimmed question stands in the text, else 0."""
    q = F.lower(F.btrim(F.coalesce(question, F.lit(""))))
    return F.when((q != "") & F.contains(F.lower(F.coalesce(text, F.lit(""))), q), F.lit(1.0)).otherwise(F.lit(0.0))
