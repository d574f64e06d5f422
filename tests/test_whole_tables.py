"""Queries over whole tables, held against plain Python over the same rows."""

import math

import pytest
from pyspark.sql import functions as F

from sightline import registry
from sightline.functions import vectors as V
from sightline.operators import spatial

WHOLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def parts(spark):
    return [(r.p_partkey, r.p_partkey % 40 / 4 + 0.01, r.p_size / 10 + 0.003) for r in spark.read.parquet(f"{WHOLE}/part.parquet").select("p_partkey", "p_size").collect()]


def test_every_part_is_a_ray(spark, parts):
    want = {i: ("near", 2.0) if x <= 4 else ("far", 5.0) for i, x, z in parts if z <= 6 and x <= 9}
    got = registry.queries()["d1_nearest_hit"](spark, WHOLE).collect()
    assert len(got) == len(want) > 320 and {r.ray: (r.owner, r.t) for r in got} == want


def test_every_part_is_a_segment(spark, parts):
    got = registry.queries()["c17_visible"](spark, WHOLE).collect()
    assert len(got) == len(parts) > 320 and {r.ray: r.visible for r in got} == {i: x > 4 for i, x, _ in parts}


def fold(views, baseline, degrees, most):
    """The reference's greedy set, view by view; views are (x, y, z) in order, seen from the origin."""
    kept = []
    for w in views:
        if len(kept) < most and all(math.dist(k, w) >= baseline and sum(a * b for a, b in zip(k, w, strict=True)) <= math.cos(math.radians(degrees)) * math.hypot(*k) * math.hypot(*w) for k in kept):
            kept.append(w)
    return len(kept)


def test_independent_views_want_baseline_and_angle(spark):
    cases = {
        "one line of sight": [(1, 0, 0), (20, 0, 0), (40, 0, 0)],
        "near but turned": [(1, 0, 0), (0, 1, 0)],
        "order decides": [(20, 0, 0), (20, 3, 0), (0, 20, 0), (20, 30, 0)],
        "stops at most": [(20, 0, 0), (0, 20, 0), (0, 0, 20), (-20, 0, 0), (0, -20, 0), (0, 0, -20)],
    }
    rows = [(k, i, *map(float, v)) for k, views in cases.items() for i, v in enumerate(views)]
    df = spark.createDataFrame(rows[::-1], "target string, i int, x double, y double, z double").select("target", "i", V.vec(F.col("x"), F.col("y"), F.col("z")).alias("pos"), V.vec(0.0, 0.0, 0.0).alias("at"))
    got = spatial.greedy_independent(df, target="target", order="i", pos="pos", at="at", baseline=12.0, degrees=12.0, most=5)
    want = {"one line of sight": 1, "near but turned": 1, "order decides": 3, "stops at most": 5}
    assert {k: fold(v, 12, 12, 5) for k, v in cases.items()} == want
    assert {r.target: r.kept for r in got.collect()} == want


def test_independent_views_are_of_all_lineitems(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_discount") * 100).cast("double").alias("y")).collect()
    views = {}
    for r in sorted(rows, key=lambda r: r.o):
        views.setdefault(r.l_suppkey, []).append((r.x, r.y, 0.0))
    got = registry.queries()["d25_independent_views"](spark, sf).collect()
    assert {r.l_suppkey: r.kept for r in got} == {k: fold(v, 12, 12, 5) for k, v in views.items()}


def uncrossed(p, most):
    """Two-opt pair by pair: the order of the points after at most so many swaps, and how many were made."""
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    idx = list(range(len(p)))
    for n in range(most):
        q = [p[k] for k in idx]
        pairs = ((i, j) for i in range(len(q) - 3) for j in range(i + 2, len(q) - 1))
        hit = next(((i, j) for i, j in pairs if side(q[i], q[i + 1], q[j]) * side(q[i], q[i + 1], q[j + 1]) < -1e-12 and side(q[j], q[j + 1], q[i]) * side(q[j], q[j + 1], q[i + 1]) < -1e-12), None)
        if hit is None:
            return idx, n
        i, j = hit
        idx[i + 1 : j + 1] = idx[i + 1 : j + 1][::-1]
    return idx, most


def test_lines_get_all_32_swaps(spark, sf):
    got = registry.queries()["f30_uncross"](spark, sf).toPandas()
    most = 0
    for _, g in got.groupby("user_id"):
        was = g.sort_values(["ts", "event_id"])
        idx, n = uncrossed(was[["x", "y"]].to_numpy(float).tolist(), 32)
        most = max(most, n)
        assert was.event_id.iloc[idx].tolist() == g.sort_values("place").event_id.tolist()
    assert most > 8
