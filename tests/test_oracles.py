"""Every registered query against its oracle SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import verify

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return verify.connect(SF)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    status, _, _, diff = verify.compare(spark, con, SF, entry.queries()[name], entry.oracle_sql().get(name))
    assert status in ("ok", "rows-only"), diff


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"query_id", "rank", "rank_score"} <= set(rows[0].asDict())
