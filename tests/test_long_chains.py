"""Loops whose rounds must not grow with the steps of a path, the picks of lanes or the length of a chain."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import graph as G
from sightline.operators import planning as P


def rounds(monkeypatch, module):
    """A list that gets an entry for each cut of the lineage."""
    seen = []
    monkeypatch.setattr(module, "cut", lambda d, cut=module.cut: seen.append(1) or cut(d))
    return seen


def greedily(cells, lanes, target, least, radius, covered=()):
    """The picks made one by one, in plain Python: cells (id, region, x, y), lanes (region, lane, ax, ay, bx, by_, cells, edge_rank), level."""
    out = []
    for region in sorted({c[1] for c in cells}):
        own = [c for c in cells if c[1] == region]
        sees = {r[1]: {c[0] for c in own if math.hypot(c[2] - min(max(c[2], r[2]), r[4]), c[3] - r[3]) <= radius + 1e-9} - set(covered) for r in lanes if r[0] == region}
        rank = {r[1]: (r[7], r[6], -r[1]) for r in lanes if r[0] == region}
        have, k = sum(c[0] in covered for c in own), 0
        while sees and (have < target * len(own) - 1e-9 or k < least):
            best = max(sees, key=lambda n: (len(sees[n]), *rank[n]))
            new = sees.pop(best)
            if not new and k >= least:
                break
            out.append((region, best, k, len(new)))
            have, k = have + len(new), k + 1
            sees = {n: v - new for n, v in sees.items()}
    return sorted(out)


@pytest.mark.parametrize(("target", "least", "block", "before"), [(0.98, 0, 100_000, False), (0.98, 0, 40, False), (0.6, 0, 40, True), (0.3, 9, 25, False), (1.0, 70, 100_000, True)])
def test_lanes_are_picked_as_one_by_one(spark, target, least, block, before):
    """Overlapping lanes, whose choice depends on their neighbours', in many blocks and in one."""
    dice = random.Random(7)
    cells = [(r * 10_000 + y * 100 + x, r, float(x), float(y)) for r in range(2) for y in range(30) for x in range(12) if dice.random() < 0.8]
    lanes = []
    for r in range(2):
        for y in range(30):
            a = dice.randrange(6)
            lanes.append((r, y, float(a), float(y), float(a + dice.randrange(2, 7)), float(y), dice.randrange(4), -min(y, 29 - y)))
    c = spark.createDataFrame(cells, "id long, region int, x double, y double")
    ln = spark.createDataFrame(lanes, "region int, lane int, ax double, ay double, bx double, by_ double, cells long, edge_rank int")
    done = [x[0] for x in cells[::7]] if before else []
    got = P.cover_by_lanes(c, ln, region="region", lane="lane", radius=1.5, target=target, least=least, block=block, covered=c.where(F.col("id").isin(done)) if before else None)
    assert got.dtypes == [("region", "int"), ("lane", "int"), ("pick", "int"), ("gain", "bigint")]
    assert sorted(map(tuple, got.collect())) == greedily(cells, lanes, target, least, 1.5, done)


def test_many_lanes_take_few_rounds(spark, monkeypatch):
    """120 lanes apart from each other, and 120 that overlap in a chain: before, a job for each."""
    c = spark.createDataFrame([(y * 10 + x, 0, x, y, float(x), float(y)) for y in range(120) for x in range(3)], "id long, region int, ix int, iy int, x double, y double")
    lanes = P.row_lanes(c, region="region", grid=1.0)
    for radius, picks in ((0.75, 120), (1.1, 40)):
        seen = rounds(monkeypatch, P)
        assert P.cover_by_lanes(c, lanes, region="region", lane="lane", radius=radius, target=1.0).count() >= picks
        assert len(seen) < 12


def test_walk_back_doubles(spark, monkeypatch):
    found = spark.createDataFrame([(k, k - 1 if k % 100 else None) for k in range(300)], "node long, previous long")
    seen = rounds(monkeypatch, P)
    got = P.walk_back(found, spark.createDataFrame([(0, 99), (1, 150), (2, 200)], "group long, node long"))
    assert sorted(map(tuple, got.collect())) == sorted([(0, k, 99 - k) for k in range(100)] + [(1, k, 150 - k) for k in range(51)] + [(2, 0, 200)])
    assert len(seen) < 30


@pytest.mark.parametrize("kind", ["long", "string"])
def test_long_chain_of_components(spark, kind):
    """Two chains of 3,000 nodes, given in one direction, and a node alone; links of a task hold few nodes at once."""
    e = spark.createDataFrame([(k, k + 2) for k in range(6000)], "u long, v long").select(F.format_string("%05d", "u").alias("u") if kind == "string" else "u", F.format_string("%05d", "v").alias("v") if kind == "string" else "v")
    few = G.forest(e, most=100)
    assert few.count() < 6000 * 1.1
    got = G.components(few, rounds=14)
    assert got.count() == 6002 and got.select("root").distinct().count() == 2
    assert got.where(F.col("node").cast("int") % 2 != F.col("root").cast("int")).isEmpty()


def test_complete_plan_takes_few_rounds(spark, monkeypatch):
    """90 rows to sweep: before, a job for each, and the edges of all cells were made twice."""
    from sightline.operators import composites as C

    cells = spark.createDataFrame([(y * 10 + x, x, y, float(x), float(y), 0.0) for y in range(90) for x in range(4)], "id long, ix int, iy int, x double, y double, z double")
    limits = P.Limits(grid=1.0, least_area=4.0, cover_radius=0.5, lane_gap=1.1, stitch_distance=1.6, stitch_degrees=100.0)
    made = []
    monkeypatch.setattr(G, "grid_edges", lambda *a, f=G.grid_edges, **b: made.append(1) or f(*a, **b))
    seen = rounds(monkeypatch, P)
    s = C.complete_plan(cells, limits)["stats"].first()
    assert (s.cells, s.lanes, s.covered, s.regions) == (360, 89, 356, 1) and s.lines >= 1
    assert len(made) == 1 and len(seen) < 60
