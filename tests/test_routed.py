"""Queries over routed questions, whose numbers meet labels that are text, against their SQL on the smallest tables."""

import pytest

from causeway.plans.catalogue import ORACLE_SQL, QUERIES
from oracle import connect, difference
from test_queries import TABLES, pytestmark  # noqa: F401


@pytest.mark.parametrize("name", ["cot_confidence", "kg_sources", "route_inverse", "tier_distribution"])
def test_same_rows(spark, name):
    assert difference(QUERIES[name](spark, TABLES), connect(TABLES), ORACLE_SQL[name]) == ""
