"""Every registered query of the engine's own operators gives the rows of its SQL."""

from __future__ import annotations

import pytest
from conftest import SF

from sightline.plans.queries import ORACLES, QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, same_as_duckdb, name):
    same_as_duckdb(QUERIES[name](spark, SF), ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
