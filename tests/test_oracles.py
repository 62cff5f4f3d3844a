"""Every registered query of the core against its SQL."""

import pytest
from compare import same

from docketry.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, name):
    same(spark, name, QUERIES[name], SQL[name], SF)
