"""Routes, solids and images against plain versions on small fixtures."""

import math
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from sightline.functions import vectors as V
from sightline.operators import graph as G
from sightline.operators import pixels, planning, resume, volumes


def lines(spark, rows):
    return spark.createDataFrame([(k, i, float(x), float(y)) for k, pts in rows.items() for i, (x, y) in enumerate(pts)], "line int, ord int, x double, y double")


def taken(df, key="line"):
    out = {}
    for r in df.orderBy(key, "ord").collect():
        out.setdefault(r[key], []).append((round(r.x, 9), round(r.y, 9)))
    return out


def plain_stitch(rows, distance, degrees):
    work = {k: list(v) for k, v in rows.items() if len(v) > 1}
    limit = math.radians(degrees)
    while True:
        best = None
        for a in sorted(work):
            for b in sorted(work):
                if b <= a:
                    continue
                for ra in (False, True):
                    for rb in (False, True):
                        u, v = (work[a][::-1] if ra else work[a]), (work[b][::-1] if rb else work[b])
                        gap = math.dist(u[-1], v[0])
                        d, e = (u[-1][0] - u[-2][0], u[-1][1] - u[-2][1]), (v[1][0] - v[0][0], v[1][1] - v[0][1])
                        turn = math.acos(max(-1, min(1, (d[0] * e[0] + d[1] * e[1]) / (math.hypot(*d) * math.hypot(*e)))))
                        if gap <= distance and turn <= limit + 1e-12:
                            c = (round(gap + distance * turn / limit, 9), a, b, ra, rb)
                            best = min(best, c) if best else c
        if not best:
            return work
        _, a, b, ra, rb = best
        u, v = (work[a][::-1] if ra else work[a]), (work[b][::-1] if rb else work[b])
        work[a] = u + (v[1:] if math.dist(u[-1], v[0]) <= 1e-6 else v)
        del work[b]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_stitched(spark, seed):
    rnd = random.Random(seed)
    rows = {}
    for k in range(18):
        x, y, a = rnd.uniform(0, 6), rnd.uniform(0, 6), rnd.uniform(0, 6.28)
        rows[k] = [(round(x + i * 0.7 * math.cos(a), 6), round(y + i * 0.7 * math.sin(a), 6)) for i in range(rnd.randint(1, 4))]
    got = taken(planning.stitched(lines(spark, rows).withColumn("g", F.lit(0)), group="g", key="line", order="ord", distance=1.25, degrees=65.0))
    want = plain_stitch(rows, 1.25, 65.0)
    assert got == {k: [(round(x, 9), round(y, 9)) for x, y in v] for k, v in want.items()} and len(want) < 17


def test_smoothing_stops_at_an_obstacle(spark):
    corner = [(0, 0), (4, 0), (4, 4)]
    walls = spark.createDataFrame([(3.55, 0.45)], "x double, y double")
    got = planning.smoothed(lines(spark, {1: corner, 2: [(x + 10, y) for x, y in corner], 3: [(0, 9), (1, 9)]}), walls, key="line", order="ord", iterations=2, reach=0.4)
    passes = {r.line: r.passes for r in got.select("line", "passes").distinct().collect()}
    n = {k: len(v) for k, v in taken(got).items()}
    assert passes == {1: 0, 2: 2, 3: 0} and n == {1: 3, 2: 12, 3: 2}


def test_resampled(spark):
    got = taken(planning.resampled(lines(spark, {1: [(0, 0), (1, 0), (1, 1)]}), key="line", order="ord", spacing=0.75))
    assert got[1] == [(0, 0), (0.75, 0), (1, 0.5), (1, 1)]


def test_isolines_of_a_cone(spark):
    """Contours of a distance field: one closed ring, every point at the level's radius or nearly."""
    n = 21
    field = spark.createDataFrame([(i, j, math.hypot(i - 10, j - 10)) for i in range(n) for j in range(n)], "ix int, iy int, value double")
    got = planning.isolines(field, 6.2).collect()
    assert len({r.line for r in got}) == 1 and all(r.closed for r in got)
    assert all(abs(math.hypot(r.x - 10, r.y - 10) - 6.2) < 0.05 for r in got)
    ring = sorted(got, key=lambda r: r.ord)
    assert max(math.dist((a.x, a.y), (b.x, b.y)) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) < 1.5
    ridge = spark.createDataFrame([(i, j, float(i)) for i in range(5) for j in range(4)], "ix int, iy int, value double")
    line = planning.isolines(ridge, 2.5).orderBy("ord").collect()
    assert [(r.x, r.closed) for r in line] == [(2.5, False)] * 4


def test_cover_by_lanes(spark):
    """Greedy picks against a plain loop over sets."""
    rnd = random.Random(7)
    cells = [(i, i % 10, i // 10, float(i % 10), float(i // 10), i // 50) for i in range(100) if rnd.random() < 0.85]
    c = spark.createDataFrame(cells, "id int, ix int, iy int, x double, y double, region int")
    lanes = planning.row_lanes(c, region="region", grid=1.0).cache()
    got = sorted((r.region, r.pick, r.lane, r.gain) for r in planning.cover_by_lanes(c, lanes, region="region", lane="lane", radius=1.1, target=0.9).collect())
    want = []
    for g in (0, 1):
        own = [r for r in cells if r[5] == g]
        rows = {r.lane: r for r in lanes.collect() if r.region == g}
        near = {k: {x[0] for x in own if math.hypot(max(r.ax - x[3], 0, x[3] - r.bx), x[4] - r.ay) <= 1.1 + 1e-9} for k, r in rows.items()}
        have, pick = set(), 0
        while len(have) < 0.9 * len(own) - 1e-9:
            best = max(rows, key=lambda k: (len(near[k] - have), rows[k].edge_rank, rows[k].cells, -k))
            gain = len(near[best] - have)
            if not gain:
                break
            want.append((g, pick, best, gain))
            have |= near[best]
            rows.pop(best)
            pick += 1
    assert got == sorted(want)


def terrace(spark, width=3, step=0.15):
    cells = []
    n = round(2.4 / step)
    for ix in range(8 + n + 8):
        for iy in range(6):
            z = min(max(0, ix - 7) * step, 2.4)
            if z in (0, 2.4) or iy < width:
                cells.append((ix * 100 + iy, ix, iy, float(ix), float(iy), round(z, 6)))
    return spark.createDataFrame(cells, "id int, ix int, iy int, x double, y double, z double")


@pytest.mark.parametrize(("step", "kind"), [(0.15, "RAMP"), (0.3, "STAIR")])
def test_connectors(spark, step, kind):
    """A slope between two floors is one ramp or stair with a straight centre line; it makes the upper floor reachable."""
    limits = planning.Limits(grid=1.0, least_area=4.0)
    c = terrace(spark, step=step)
    e = G.grid_edges(c, offsets=((1, 0), (0, 1)), max_rise=0.38)
    level = G.components_of(c, G.flat_edges(e, c, 0.1)).where("size >= 4")
    m = level.select(F.col("node").alias("id"), F.col("root").alias("region"))
    r = m.join(c, "id").groupBy("region").agg(F.avg("z").alias("mean_z"), F.count(F.lit(1)).cast("double").alias("area"))
    found, line = planning.connectors(c, e, m, r, limits)
    got = found.collect()
    assert [x.kind for x in got] == [kind] and len(got[0].regions) == 2 and abs(got[0].rise - 2.4) < 1e-9
    z = [x.z for x in line.orderBy("ord").collect()]
    assert z == sorted(z) and z[0] == 0 and z[-1] == 2.4
    seed = spark.createDataFrame([(0,)], "node int")
    assert planning.reachable_regions(e, m, found, seed).count() == 2
    assert planning.reachable_regions(e, m, found.limit(0), seed).count() == 1


def test_structural_supports(spark):
    """A narrow joiner between two floors stays, a shelf that touches one floor goes."""
    c = terrace(spark, step=0.3).unionByName(spark.createDataFrame([(9000 + k, k, 6, float(k), 6.0, 0.3) for k in range(3)], "id int, ix int, iy int, x double, y double, z double"))
    e = G.grid_edges(c, offsets=((1, 0), (0, 1)), max_rise=0.38)
    kept = {r.id for r in planning.structural_supports(c, e, step=1.0, least_area=9.0).collect()}
    every = {r.id for r in c.collect()}
    assert every - kept == {9000, 9001, 9002}


def test_walkable_plan(spark):
    limits = planning.Limits(grid=1.0, least_area=4.0, cover_radius=0.5, lane_gap=1.1, stitch_distance=1.6, stitch_degrees=100.0)
    s = planning.walkable_plan(terrace(spark), limits)["stats"].first()
    assert s.regions == 2 and s.reached == 2 and s.connectors == 1 and s.covered >= 0.98 * s.cells and 0 < s.lines <= s.lanes


def test_segments_inside_and_collisions(spark):
    """A segment that leaves and enters again isn't inside; points in, near and far."""
    one = spark.range(1)
    two = F.concat(volumes.wall(F.lit("u"), V.vec(0, 0, 0), V.vec(1, 1, 1)))
    tris = one.select(F.posexplode(two).alias("tri", "w")).select("tri", "w.owner", "w.a", "w.b", "w.c")
    seg = spark.createDataFrame([(1, 0.11, 0.89), (2, 0.5, 1.5), (3, -0.4, 1.4)], "id int, p double, q double").select("id", V.vec(F.col("p"), 0.43, 0.37).alias("a"), V.vec(F.col("q"), 0.47, 0.41).alias("b"))
    got = {r.id: r.inside for r in volumes.segments_inside(seg, tris, cell=0.5, reach=2.0).collect()}
    assert got == {1: True, 2: False, 3: False}
    pts = spark.createDataFrame([(1, 0.5), (2, 1.1), (3, 1.4)], "id int, p double").select("id", V.vec(F.col("p"), 0.43, 0.37).alias("p"))
    assert sorted(r.id for r in volumes.collides(pts, tris, cell=0.5, reach=2.0, radius=0.2).collect()) == [1, 2]


def test_pushed_out(spark):
    one = spark.range(1)
    tris = one.select(F.posexplode(volumes.wall(F.lit("w"), V.vec(0, -5, -5), V.vec(1, 5, 5))).alias("tri", "w")).select("tri", "w.owner", "w.a", "w.b", "w.c")
    cams = spark.createDataFrame([(1, 1.05), (2, 3.0)], "id int, p double").select("id", V.vec(F.col("p"), 0.0, 0.0).alias("p"))
    got = {r.id: r for r in volumes.pushed_out(cams, tris, cell=1.0, clearance=0.4, search=1.0, rounds=4).collect()}
    assert got[2].pushes == 0 and got[1].pushes > 0 and got[1].nearest >= 0.2


def test_png(spark):
    rows = spark.createDataFrame([("a", 1, 0, 255), ("a", 2, 1, 7), ("b", 0, 1, 60000)], "g string, u int, v int, w int")
    for bits, want in ((8, {"a": [[0, 255, 0], [0, 0, 7]]}), (16, {"b": [[0, 0, 0], [60000, 0, 0]]})):
        for r in pixels.images(rows.where(F.col("g").isin(list(want))), group=["g"], value="w", width=3, height=2, bits=bits).collect():
            raw = bytes(r.content)
            at = raw.index(b"IDAT")
            body = zlib.decompress(raw[at + 4 : at + 4 + struct.unpack(">I", raw[at - 4 : at])[0]])
            size = 1 + 3 * bits // 8
            got = [list(struct.unpack(">3H" if bits == 16 else "3B", body[k * size + 1 : (k + 1) * size])) for k in range(2)]
            assert got == want[r.g]


def test_steps_go_on_where_they_stopped(tmp_path):
    seen = []

    def work(name, units):
        def one(k):
            seen.append((name, k))
            if name == "b" and k == 1 and len(seen) < 5:
                raise RuntimeError("lost")
            return k == units - 1

        return name, one

    stages = [work("a", 2), work("b", 3)]
    path = str(tmp_path / "state.json")
    runner = resume.StepRunner(path, stages, {"x": 1})
    with pytest.raises(RuntimeError):
        while runner.step():
            pass
    again = resume.StepRunner(path, stages, {"x": 1})
    assert again.state["error"].startswith("RuntimeError")
    while again.step():
        pass
    assert again.finished and seen == [("a", 0), ("a", 1), ("b", 0), ("b", 1), ("b", 1), ("b", 2)]
    assert not resume.StepRunner(path, stages, {"x": 2}).finished


def test_progress_and_gate(spark, tmp_path):
    p = str(tmp_path / "progress.json")
    assert resume.save_progress(p, {"s": 1}, [3, 1, 3, 99], 10, 1.5)
    assert resume.load_progress(p, {"s": 1}, 10)["done"] == [1, 3] and resume.load_progress(p, {"s": 2}, 10) is None
    resume.gate(spark.createDataFrame([], "message string"))
    with pytest.raises(ValueError, match="a; b; c; d; e; and more"):
        resume.gate(spark.createDataFrame([(x,) for x in "fedcba"], "message string"))


def test_affinity_chain(spark):
    """The chain by overlap, nearness and continuity against a plain loop."""
    from sightline.operators import candidates

    rnd = random.Random(3)
    nodes = [(k % 2, k, rnd.randint(0, 9), 0.7, rnd.random() * 3, rnd.random() * 3, 0.0, math.cos(a := rnd.random()), 0.0, 0.0, math.sin(a)) for k in range(16)]
    edges = [(a, b, round(rnd.random(), 3)) for a in range(16) for b in range(a) if rnd.random() < 0.4]
    n = spark.createDataFrame(nodes, "g int, id int, along int, step double, x double, y double, z double, qw double, qx double, qy double, qz double")
    e = spark.createDataFrame(edges, "a int, b int, ratio double")
    ratio = {frozenset(x[:2]): x[2] for x in edges}
    for g in (0, 1):
        own = {x[1]: x for x in nodes if x[0] == g}
        at = min(own, key=lambda k: (own[k][2], k))
        want, left = [at], set(own) - {at}
        while left:
            def key(k, at=at):
                r, d = ratio.get(frozenset((at, k)), 0.0), math.dist(own[at][4:7], own[k][4:7])
                q = abs(sum(a * b for a, b in zip(own[at][7:], own[k][7:], strict=True)))
                return (round(0.5 * r + 0.3 / (1 + d / 0.7) + 0.2 * (1 - 2 * math.acos(min(1, q)) / math.pi), 12), r, -d, k)

            at = max(left, key=key)
            left.discard(at)
            want.append(at)
        got = [r.id for r in candidates.affinity_chain(n, e, group="g").where(F.col("g") == g).orderBy("position").collect()]
        assert got == want


def test_spaced_top_and_doorways(spark):
    from sightline.operators import candidates

    rnd = random.Random(5)
    rows = [(k % 3, k, rnd.random() * 4, rnd.random() * 4, rnd.randint(0, 5)) for k in range(120)]
    df = spark.createDataFrame(rows, "g int, id int, x double, y double, s int")
    got = sorted((r.g, r.id) for r in candidates.spaced_top(df, group="g", order=[F.desc("s"), "id"], axes=["x", "y"], apart=1.0, most=6).collect())
    want = []
    for g in range(3):
        kept = []
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[4], r[1])):
            if len(kept) < 6 and all(math.dist(r[2:4], k[2:4]) >= 1.0 for k in kept):
                kept.append(r)
        want += [(g, r[1]) for r in kept]
    assert got == sorted(want)
    doors = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0)], "id int, x double, y double, dx double, dy double")
    cells = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.3, 0.0)], "id int, x double, y double")
    served = [(r.tier, r.cell) for r in candidates.doorway_origins(doors, cells, tiers=((0, 0), (0.05, 0), (0.1, 0)), reach=1.0).orderBy("tier").collect()]
    assert served == [(0, 1), (1, 2)]


def test_detail_counts(spark):
    from sightline.operators import candidates

    def counts(rows):
        df = spark.createDataFrame([(k, b, m, 1.0, 0.0, float(k), 0.0, 0.0) for k, (b, m) in enumerate(rows)], "id int, b int, m int, len double, gain double, x double, y double, z double")
        return [r.n for r in candidates.detail_counts(df, base="b", minimum="m", length="len", gain="gain", key="id").orderBy("id").collect()]

    assert counts([(4, 1), (2, 1)]) == [4, 2]
    assert counts([(9, 1), (0, 3), (3, 2)]) == [6, 3, 3]
    assert counts([(2, 5), (0, 5), (0, 1)]) == [1, 0, 1] and sum(counts([(5, 4), (1, 4), (0, 1)])) == 6


def test_repaired_neighbours(spark):
    from sightline.operators import candidates

    groups = spark.createDataFrame([(0, "a0", 5, True, 0.0), (0, "a1", 5, False, 0.1), (1, "b0", 5, True, 0.0), (2, "c0", 5, True, 0.0)], "origin int, candidate string, observations int, is_base boolean, pitch double")
    links = [("a1", "b0"), ("a1", "c0"), ("b0", "c0")]
    edges = spark.createDataFrame([(a, b, 0.5) for x, y in links for a, b in ((x, y), (y, x))], "a string, b string, ratio double")
    first = groups.where("is_base").select("origin", "candidate")
    got = {r.origin: r.candidate for r in candidates.repaired_neighbours(first, groups, edges, strong=0.3).collect()}
    assert got == {0: "a1", 1: "b0", 2: "c0"}
