"""Graph loops and greedy picks against plain versions on small grids."""

import heapq
import random

from pyspark.sql import functions as F

from sightline.operators import graph as G
from sightline.operators import select as H


def grid(spark, w=9, h=7, holes=(3, 12, 21, 30, 39, 4, 13)):
    rows = [(y * w + x, x, y, float(x), float(y), 0.1 * (x // 4)) for y in range(h) for x in range(w) if y * w + x not in holes]
    return rows, spark.createDataFrame(rows, "id long, ix long, iy long, x double, y double, z double")


def plain_edges(rows, reach=2.3, rise=0.36):
    steps = {s for o in G.HALF_OFFSETS for s in (o, (-o[0], -o[1]))}
    out = {}
    for a in rows:
        for b in rows:
            if (b[1] - a[1], b[2] - a[2]) in steps and ((a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2) ** 0.5 <= reach + 1e-9 and abs(a[5] - b[5]) <= rise + 1e-9:
                out[a[0], b[0]] = ((a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2 + (a[5] - b[5]) ** 2) ** 0.5
    return out


def dijkstra(edges, seeds):
    dist, q = {s: 0.0 for s in seeds}, [(0.0, s) for s in seeds]
    near = {}
    for (a, b), c in edges.items():
        near.setdefault(a, []).append((b, c))
    while q:
        d, a = heapq.heappop(q)
        if d > dist[a]:
            continue
        for b, c in near.get(a, []):
            if d + c < dist.get(b, 1e18) - 1e-12:
                dist[b] = d + c
                heapq.heappush(q, (d + c, b))
    return dist


def test_edges_distances_and_routes(spark):
    rows, df = grid(spark)
    want = plain_edges(rows)
    e = G.grid_edges(df).cache()
    got = {(r.src, r.dst): r.cost for r in e.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    seeds = spark.createDataFrame([(0,), (62,)], "node long")
    found = G.shortest(e, seeds)
    dist = {r.node: r.distance for r in found.collect()}
    plain = dijkstra(want, [0, 62])
    assert dist.keys() == plain.keys() and all(abs(dist[k] - plain[k]) < 1e-9 for k in plain)
    path = G.route(found, 31)
    assert path[0] in (0, 62) and path[-1] == 31 and abs(sum(want[a, b] for a, b in zip(path, path[1:])) - plain[31]) < 1e-9
    assert G.route(found, 999) == []
    hops = {r.node: r.hops for r in G.reachable(e, seeds).collect()}
    assert hops.keys() == plain.keys()
    a, b, n = G.diameter(e, 31)
    assert abs(dijkstra(want, [a])[b] - n) < 1e-9


def test_components_and_regions(spark):
    rows, df = grid(spark, holes=tuple(range(4, 63, 9)))  # a wall
    e = G.grid_edges(df, offsets=((1, 0), (0, 1)))
    c = G.components_of(df, e).collect()
    left = {r.node for r in c if r.root == 0}
    assert {r.root for r in c} == {0, 5} and all((n % 9 < 4) == (n in left) for n in [r.node for r in c])
    reg = G.regions(df, e, tolerance=0.05, least_cells=3).orderBy("region").collect()
    assert [r.root for r in reg] == [0, 5, 8] and [r.cells for r in reg] == [28, 21, 7]
    grown = G.grow_labels(e, spark.createDataFrame([(0, 0), (27, 3), (5, 5)], "node long, label long")).collect()
    assert {r.label for r in grown if r.node % 9 < 4} == {0, 3} and all(r.label == 5 for r in grown if r.node % 9 > 4)
    assert G.uncovered(df, e, df.where("ix <> 1"), 2).collect()[0].size == 7
    assert G.components_of(df.limit(0), e.limit(0)).count() == 0


def plain_cover(sets, budget):
    left = {k: set(v) for k, v in sets.items()}
    out = []
    for _ in range(budget):
        k = min(left, key=lambda c: (-len(left[c]), c))
        if not left[k]:
            break
        out.append((k, len(left[k])))
        gone = set(left[k])
        left = {c: v - gone for c, v in left.items() if c != k}
    return out


def test_greedy_cover_and_repair(spark):
    rng = random.Random(3)
    sets = {c: {rng.randrange(60) for _ in range(rng.randrange(1, 14))} for c in range(20)}
    obs = spark.createDataFrame([(c, v) for c, vs in sets.items() for v in vs], "c long, v long")
    got = [(r.candidate, int(r.gain)) for r in H.greedy_cover(obs, candidate="c", cell="v", budget=7).orderBy("pick").collect()]
    assert got == plain_cover(sets, 7)
    now, covered = H.swap_repair(obs, [0, 1, 2, 3], candidate="c", cell="v")
    assert covered == len(set().union(*(sets[c] for c in now))) >= len(set().union(*(sets[c] for c in range(4))))
    assert H.greedy_cover(obs.limit(0), candidate="c", cell="v", budget=3).count() == 0


def test_spread_out_points(spark):
    rng = random.Random(5)
    pts = [(0, i, rng.random(), rng.random()) for i in range(60)]
    df = spark.createDataFrame(pts, "g long, id long, x double, y double")
    picks, d = [0], {}
    while len(picks) < 8:
        d = {i: min((pts[i][2] - pts[k][2]) ** 2 + (pts[i][3] - pts[k][3]) ** 2 for k in picks) for i in range(60)}
        picks.append(min(d, key=lambda i: (-d[i], i)))
    assert [r.id for r in H.farthest_points(df, group="g", id="id", axes=["x", "y"], count=8).orderBy("pick").collect()] == picks
    assert [r.id for r in H.farthest_points_large(df, id="id", axes=["x", "y"], count=8).orderBy("pick").collect()] == picks
    kept = []
    for p in pts:
        if all((p[2] - k[2]) ** 2 + (p[3] - k[3]) ** 2 >= 0.09 for k in kept):
            kept.append(p)
    assert sorted(r.id for r in H.diverse_sequence(df, group="g", order=["id"], axes=["x", "y"], distance=0.3, most=99).collect()) == [k[1] for k in kept]


def test_diverse_views(spark):
    """Near rows that look elsewhere stay; near ones that look the same way go."""
    import math

    rows = [(0, i, (i * 7 % 10) / 10, 0.0, math.cos(i % 4), math.sin(i % 4)) for i in range(40)]
    df = spark.createDataFrame(rows, "g int, id int, x double, y double, fx double, fy double")
    kept = []
    for r in rows:
        if not any(abs(k[2] - r[2]) <= 0.25 and k[4] * r[4] + k[5] * r[5] >= math.cos(math.radians(30)) for k in kept):
            kept.append(r)
    got = H.diverse_sequence(df, group="g", order=["id"], axes=["x", "y"], distance=0.25, most=99, forward=["fx", "fy"], degrees=30.0)
    assert sorted(r.id for r in got.collect()) == [k[1] for k in kept] and 4 < len(kept) < 40


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Distances settle block by block and a route doubles; a step a round took as many jobs as there are nodes."""
    made = []
    monkeypatch.setattr(G, "cut", lambda d, cut=G.cut: made.append(1) or cut(d))
    one = spark.range(299).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), (1.0 + F.col("id") % 2).alias("cost"))
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost")).unionByName(spark.createDataFrame([(0, 2, 3.0), (2, 0, 3.0)], "src long, dst long, cost double"))
    found = G.shortest(both, spark.createDataFrame([(0,), (1000,)], "node long"), block=100)
    got = {r.node: (r.distance, r.previous) for r in found.collect()}
    assert len(got) == 301 and got[299] == (448.0, 298) and got[2] == (3.0, 0) and got[0] == (0.0, None) and got[1000] == (0.0, None)
    assert G.route(found, 299) == [0, *range(2, 300)] and G.route(found, 5000) == [] and G.route(found, 0) == [0]
    assert len(made) < 40
