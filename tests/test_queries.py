import pytest
from oracle import compare

from strandmill.plans.oracles import ORACLES
from strandmill.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    if name in ORACLES:
        compare(spark, data, QUERIES[name], ORACLES[name])
    else:
        df = QUERIES[name](spark, data)
        assert df.columns and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_does_not_import_training():
    import pathlib

    root = pathlib.Path(__file__).parents[1] / "strandmill"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(), p
