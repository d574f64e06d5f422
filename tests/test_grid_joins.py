"""Grids' cells and edges grow with the table: they are merged, and only the heads of linked ranges meet in the rounds of components."""

import random

from pyspark.sql import functions as F

from sightline.operators import graph as G
from sightline.operators import planning as P
from sightline.plans.planning_queries import terraces


def test_grids_broadcast_nothing(spark, sf, monkeypatch):
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    plans = []
    monkeypatch.setattr(G, "cut", lambda d, cut=G.cut: plans.append(plan(d)) or cut(d))
    c = terraces(spark, sf)
    e = G.grid_edges(c, max_rise=0.38)
    flat = G.flat_edges(G.restrict(e, c), c, 0.1)
    rows = c.groupBy("iy").agg(F.min("x").alias("ax"), F.max("x").alias("bx")).select("ax", F.col("iy").cast("double").alias("ay"), "bx", F.col("iy").cast("double").alias("by_"))
    plans += [plan(d) for d in (e, flat, G.components_of(c, flat), P.covered_cells(c, rows, radius=0.75))]
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_grid_edges_keep_their_rise(spark, sf):
    c = terraces(spark, sf)
    z = {r.id: r.z for r in c.collect()}
    got = G.grid_edges(c, max_rise=0.38, keep=["rise"]).collect()
    assert got and all(abs(abs(z[r.src] - z[r.dst]) - r.rise) < 1e-12 for r in got)
    assert sorted((r.src, r.dst) for r in got) == sorted((r.dst, r.src) for r in got) == sorted((r.src, r.dst) for r in G.grid_edges(c, max_rise=0.38).collect())


def test_only_heads_meet_in_rounds(spark, monkeypatch):
    """Long chains, small groups and nodes alone, linked in four ranges; before, every node was in every round."""
    dice = random.Random(5)
    edges = [(k, k + 2) for k in range(2000)] + [(k, k + dice.randrange(1, 400)) for k in range(3000, 3600) if dice.random() < 0.3]
    nodes = range(4200)
    up = list(nodes)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for u, v in edges:
        u, v = root(u), root(v)
        up[max(u, v)] = min(u, v)
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    met = []
    monkeypatch.setattr(G, "components", lambda e, f=G.components: met.append(e.count()) or f(e))
    try:
        got = {r.node: r.root for r in G.components_of(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "src long, dst long")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    assert got == {n: root(n) for n in nodes}
    assert len(met) == 1 and 0 < met[0] < 600
