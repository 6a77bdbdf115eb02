"""Every registered query against its SQL twin on the smallest scale factor."""

from __future__ import annotations

import check
import pytest

import __spark_entry__ as entry
from flowloom.catalog import QUERIES

SF = "/root/testdata/sf0.001"
# the training-data queries are compared in tests/llm
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    problem = check.compare(spark, con, name, entry.queries()[name], ORACLES[name], SF)
    assert problem is None, problem


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_the_enriched_table(spark):
    df = entry.entry(spark)
    assert "H_L0_01_weight" in df.columns and len(df.columns) == 35
