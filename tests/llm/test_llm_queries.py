import pytest
from conftest import DATA, agrees

from thesaurion.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, duck, name):
    agrees(spark, duck, QUERIES, ORACLES, name)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    QUERIES[name](spark, DATA).count()


def test_nothing_outside_imports_this_package():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2] / "thesaurion"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "thesaurion.llm" in p.read_text()]
