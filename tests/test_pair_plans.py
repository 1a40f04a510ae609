"""Plans of queries whose result is one row for a pair."""

import __spark_entry__ as entry
import pytest


@pytest.mark.parametrize("name", ["pair_sim", "fast_sim"])
def test_pairs_are_not_joined_with_their_ends(spark, sf, name):
    """What stands above the kernel does not shuffle the pairs."""
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("FlatMapGroupsInPandas")]
