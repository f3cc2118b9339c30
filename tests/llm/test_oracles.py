"""Every query that SQL can express gives the rows of its SQL, and all queries have the fixed columns."""

import pytest

from helpers import same_as_sql
from spanweave.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, folder, name):
    same_as_sql(spark, duck, folder, QUERIES[name], ORACLES[name])


def test_one_query_per_operator():
    assert sorted(int(x[2:].split("_")[0]) for x in QUERIES) == list(range(1, 14))
