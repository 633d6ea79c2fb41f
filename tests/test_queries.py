"""Every registered query against DuckDB, or for its shape where SQL can't say it."""

import pytest
from conftest import SMALL
from oracle import answer, rows_of

from modelrank.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert rows_of(QUERIES[name](spark, SMALL).toPandas()) == answer(ORACLES[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_query(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
