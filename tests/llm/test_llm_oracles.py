"""Queries of the corpus operators against their SQL."""

import pytest
from compare import same

from docketry.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, name):
    same(spark, name, QUERIES[name], SQL[name], "/root/testdata/sf0.001")
