"""Every query that SQL can express, side by side with DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb
import pytest

from takewright.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(records, names, columns):
    """Rows of plain values, sorted; numbers of one value are alike, whole or not, and so is nothing, as null or as not-a-number."""
    at = [names.index(c) for c in columns]

    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return (0, "")
        if isinstance(x, bool):
            return (1, str(x))
        if isinstance(x, int | float | Decimal):
            return (2, repr(float(x)) if abs(x) < 2**53 else str(x))
        return (3, str(x))

    return sorted(tuple(plain(r[i]) for i in at) for r in records)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    wanted = duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    assert rows(found.collect(), found.columns, columns) == rows(wanted.fetchall(), wanted.columns, columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_interval_joins_need_no_nested_loop(spark):
    for name in ("d15_speech_overlap", "d16_supported_rate", "k09_assess_words", "d17_word_at", "i15_warp_time"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan
        assert "Cartesian" not in plan
