"""Joins on space are never broadcast, however small Spark believes their inputs: it judges them before rows are spread over buckets."""

import pytest

from sightline import registry
from sightline.operators import spatial as S


@pytest.mark.parametrize(("name", "small"), [("d18_radius_join", 0), ("d9_nearest_cell", 0), ("f39_anchors", 0), ("f44_first_clear_height", 0), ("h29_driven_origins", 0), ("f43_first_clear_offset", 0), ("d6_segments_clear", 1)])
def test_no_broadcast(spark, sf, name, small):
    """Only the solids of the nations may be sent to all, in d6_segments_clear."""
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("BroadcastHashJoin") <= small and "SortMergeJoin" in plan


def test_either_side_may_be_spread(spark):
    a = spark.createDataFrame([(i, i % 7 / 4.0, i // 7 / 4.0) for i in range(60)], "id long, x double, y double")
    b = a.where("id % 5 = 0")
    want = sorted(map(tuple, S.radius_join(a, b, 0.5, ("x", "y")).collect()))
    assert want and want == sorted(map(tuple, S.radius_join(a, b, 0.5, ("x", "y"), spread="right").collect()))


def test_spaced_top_broadcasts_nothing(spark, sf, monkeypatch):
    from sightline.operators import candidates as K

    plans = []
    monkeypatch.setattr(K, "cut", lambda d, cut=K.cut: plans.append(d._jdf.queryExecution().executedPlan().toString()) or cut(d))
    plans.append(registry.queries()["h18_spaced_top"](spark, sf)._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
