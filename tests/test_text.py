import pytest
from pyspark.sql import functions as F

from quarry.functions import page_metadata as M
from quarry.functions import text as X


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("What IS the café-Error 42 error?", ["caf", "error", "42", "error"]), (None, []), ("", []), ("the of", [])])
def test_tokens(spark, text, want):
    assert one(spark, X.tokens(F.lit(text).cast("string"))) == want


def test_word_counts(spark):
    assert one(spark, X.word_count(F.lit("Größe_1 – naïve, 日本 x.y"))) == 5
    assert one(spark, X.split_count(F.lit(" a  b c\n"))) == 3


def test_snippet(spark):
    assert one(spark, X.snippet(F.lit(" a\n b\t c "))) == "a b c"
    long = one(spark, X.snippet(F.lit("word " * 100)))
    assert long.endswith("word ...") and len(long) <= 244


def test_blank_lines_are_capped_before_line_ends_are_trimmed(spark):
    assert one(spark, X.tidy_markdown(F.lit("a\n \n \n \nb\r\n"))) == "a\n\n\n\nb"
    assert one(spark, X.tidy_markdown(F.lit("a\n\n\n\n\nb  \nc"))) == "a\n\nb\nc"


@pytest.mark.parametrize("text", ["**a** *b* `c` [t](u) ![i](s)", "a_b_c", r"x \| y", "__w__ plain", ""])
def test_markup_is_stripped_alike_in_sql_and_python(spark, text):
    assert one(spark, X.strip_markdown(F.lit(text))) == M.strip_markdown(text)


@pytest.mark.parametrize(("text", "want"), [("Last Reviewed", "last_reviewed"), ("run_book_url", "runbookurl"), ("**Owner**!", "owner"), ("A - B", "a_b")])
def test_field_names(spark, text, want):
    assert one(spark, X.field_name(F.lit(text))) == M.field_name(text) == want


def test_match_scores(spark):
    q = X.token_set(F.lit("reset the api token"))
    assert one(spark, X.match_score(q, F.lit("API token rotation"))) == pytest.approx(2 / 3)
    assert one(spark, X.match_score(X.token_set(F.lit("what is the")), F.lit("x"))) == 0.0
    assert one(spark, X.keyword_overlap(X.token_set(F.lit("api")), F.lit("Capital"))) == 1.0
    assert one(spark, X.phrase_score(F.lit(" Reset it? "), F.lit("how to reset it?"))) == 1.0
    assert one(spark, X.phrase_score(F.lit("  "), F.lit("x"))) == 0.0
