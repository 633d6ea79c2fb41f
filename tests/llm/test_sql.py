import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import answer, rows_of  # noqa: E402

from modelrank.llm.queries import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    folder = "/root/testdata/sf0.001"
    assert rows_of(QUERIES[name](spark, folder).toPandas()) == answer(ORACLES[name], folder)
