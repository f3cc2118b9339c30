"""Every interval query gives the rows of its SQL."""

import sys

import pytest

import __spark_entry__ as entry
from helpers import same_as_sql
from spanweave.queries import ORACLES, QUERIES


def test_each_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, folder, name):
    same_as_sql(spark, duck, folder, QUERIES[name], ORACLES[name])


def test_the_entry_without_the_training_data_package(monkeypatch):
    """A package that it needs is missing, or the folder is: the interval queries are still there."""
    monkeypatch.setitem(sys.modules, "spanweave.llm.queries", None)
    assert entry.queries().keys() == QUERIES.keys() == entry.oracle_sql().keys()
