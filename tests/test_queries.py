import pytest
from conftest import SMALL

import __spark_entry__ as entry
from tidemark.plans import queries as _registered  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin(spark, duck, same, name):
    same(QUERIES[name](spark, SMALL).toPandas(), duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_twin_runs(spark, name):
    frame = QUERIES[name](spark, SMALL)
    assert frame.columns
    frame.collect()


def test_entry(spark):
    assert entry.entry(spark).count() == 3
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
