"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import database, difference
from checks.oracles import ORACLES
from checks.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, name):
    ours = QUERIES[name](spark, folder).toPandas()
    if name in ORACLES:
        assert difference(ours, database(folder).execute(ORACLES[name]).df()) is None
    else:
        assert len(ours) > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1
