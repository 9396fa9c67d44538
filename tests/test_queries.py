"""Every query that has SQL gives the same rows as DuckDB."""

import pytest
from conftest import DATA, agrees

from thesaurion.plans import catalogue, files, problems

QUERIES = problems.QUERIES | catalogue.QUERIES | files.QUERIES
ORACLES = problems.ORACLES | catalogue.ORACLES | files.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, duck, name):
    agrees(spark, duck, QUERIES, ORACLES, name)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"weighted_content"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
