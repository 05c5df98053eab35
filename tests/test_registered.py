"""Every registered query against its SQL twin, and the contract of the entry file."""

import pytest

import __spark_entry__ as entry
import check

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return check.duck(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, sf, con):
    state, rows = check.compare(QUERIES[name](spark, sf), SQL.get(name), con)
    assert state.startswith(("ok", "rows-only")) and "TYPES" not in state, state
    if name not in ("sessions_by_user", "cache_hits"):  # empty on the smallest tables
        assert rows > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["item_id", "rank", "doc_id", "score", "answer"]
    assert df.count() > 0


def test_twins_belong_to_queries():
    assert set(SQL) <= set(QUERIES)
