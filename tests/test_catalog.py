"""Queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="needs the tables")


def rows(df):
    cols = sorted(df.columns)
    return sorted(map(tuple, df[cols].astype(object).values.tolist()), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def test_every_oracle_has_a_query():
    from textmatch.plans.catalog import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES)


def test_queries(spark, duck):
    from textmatch.plans.catalog import ORACLES, QUERIES

    for name, f in QUERIES.items():
        got = f(spark, DATA).toPandas()
        if name in ORACLES:
            expected = duck.execute(ORACLES[name]).df()
            assert sorted(got.columns) == sorted(expected.columns), name
            assert rows(got) == rows(expected), name


def test_phrases_are_of_all_kinds(spark):
    from textmatch.plans.catalog import QUERIES

    assert {r["type"] for r in QUERIES["phrase_matches"](spark, DATA).select("type").distinct().collect()} == {"exact", "fuzzy", "proximity", "none"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and "search_slice" in e.oracle_sql()
