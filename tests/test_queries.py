"""Every query against its SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from quarry.plans import queries, sql

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _rows(df):
    def plain(x):
        return None if x is None or x != x else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(plain(x) for x in r) for r in df.where(df.notna(), None).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_matches_sql(spark, db, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), db.sql(sql.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(sql.ORACLES)))
def test_queries_without_sql_run(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_imports_the_training_data_subpackage():
    from pathlib import Path

    root = Path(queries.__file__).resolve().parent.parent
    for p in root.rglob("*.py"):
        assert "llm" in p.relative_to(root).parts or "quarry.llm" not in p.read_text(), p


def test_plans_push_down_and_stay_in_the_jvm(spark):
    text = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in text(queries.minmax_norm(spark, SF))
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)]" in text(queries.golden_merge(spark, SF))
    for name in ("rerank_breakdown",):
        assert "CartesianProduct" not in text(queries.queries()[name](spark, SF))
    assert "TakeOrderedAndProject" in text(queries.dense_topk(spark, SF))
