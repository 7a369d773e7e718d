"""Every query with SQL against DuckDB on the small tables."""

import math

import duckdb
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def tidy(rows):
    fix = lambda x: ("nan" if math.isnan(x) else round(x, 5) + 0.0) if isinstance(x, float) else x
    return sorted((tuple(map(fix, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, con, name):
    found = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(want.columns)
    got, expected = tidy(found.select(want.columns).collect()), tidy(want.fetchall())
    assert len(got) == len(expected)
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    found = e.queries()["file_scores"](spark, SF)
    assert found.columns == ["doc_id", "raw_score", "probability", "label", "code_lines"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_scores_shuffle_nothing(spark):
    plan = registry.QUERIES["file_scores"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
