"""Stations, layers, pockets, loops, brushing, exports and batches against small cases worked by hand."""

import json
import math
import sys

import pytest
from pyspark.sql import functions as F

from sightline.functions import vectors as V
from sightline.operators import graph as G
from sightline.operators import meshes as M
from sightline.operators import tracing as T
from sightline.operators import validate as Q
from sightline.operators.order import placed
from sightline.operators.quota import systematic_sample
from sightline.operators.spatial import knn_to_queries
from sightline.sources import exports as X
from sightline.streaming import recorder as R

LINE = "line int, ord int, x double, y double, z double, step double"


def test_placed(spark):
    rows = [(i * 7 % 50, float(i % 4)) for i in range(50)] + [(None, 2.0)]
    df = spark.createDataFrame(rows, "k int, w double").repartition(5)
    got = sorted(placed(df, ["k"], total="w").collect(), key=lambda r: r.place)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.k for r in got] == [k for k, _ in want] and [r.place for r in got] == list(range(1, 52))
    assert [r.before for r in got] == [sum(w for _, w in want[:i]) for i in range(51)]
    assert {(r.rows, r.whole) for r in got} == {(51, sum(w for _, w in want))}
    assert placed(df.limit(0), ["k"], total="w").count() == 0
    # the rows come back once each, equal keys too
    assert placed(spark.range(9).select((F.col("id") % 2).alias("k")), ["k"]).select("place").distinct().count() == 9


def test_systematic_sample_within_groups(spark):
    df = spark.createDataFrame([(g, i, 1.0 + i % 3) for g in range(3) for i in range(40)] + [(9, 0, 0.0), (9, 1, 0.0)], "g int, i int, w double")
    got = {(r.g, r.i): r.taken for r in systematic_sample(df, weight="w", order=["i"], count=17, within=["g"]).collect()}
    for g in range(3):
        run, total = 0.0, sum(1.0 + i % 3 for i in range(40))
        for i in range(40):
            w = 1.0 + i % 3
            assert got[g, i] == math.floor((run + w) / total * 17 + 0.5) - math.floor(run / total * 17 + 0.5)
            run += w
    assert got[9, 0] == got[9, 1] == 0


def test_knn_in_blocks(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(60)], "id int, v array<double>")
    q = rows.where("id % 5 = 0")
    one = knn_to_queries(q, rows, query="id", row="id", vector="v", k=3)
    many = knn_to_queries(q, rows, query="id", row="id", vector="v", k=3, block=4)
    assert sorted(one.collect()) == sorted(many.collect()) and one.count() == 36


def test_planned_stations(spark):
    bend = [(0, 0, 0.0, 0.0, 0.0, 1.0), (0, 1, 4.0, 0.0, 0.0, 1.0), (0, 2, 4.0, 4.0, 0.0, 1.0)]
    point = [(1, 0, 5.0, 5.0, 0.0, 1.0), (1, 1, 5.0, 5.0, 0.0, 1.0)]
    slope = [(2, 0, 0.0, 0.0, 0.0, 2.0), (2, 1, 3.0, 0.0, 0.0, 2.0), (2, 2, 6.0, 0.0, 3.0, 2.0)]
    df = spark.createDataFrame(bend + point + slope, LINE)
    counts = spark.createDataFrame([(0, 3), (1, 4), (2, 2)], "line int, n int")
    got = T.planned_stations(df, counts, key="line", order="ord", degrees=30.0, least=0.2).collect()
    at = lambda k: {round(r.distance, 4): r.critical for r in got if r.line == k}
    assert at(1) == {0.0: True}
    a = at(0)
    # the corner at 4 is the middle too, half a step around it, whole steps on the straight legs
    assert a[0.0] and a[4.0] and a[8.0] and not a[3.5] and not a[4.5] and not a[1.0] and not a[2.0] and not a[3.0]
    # at the corner the step is cut by a right angle over a probe of 0.35 to both sides
    assert round(4.0 + 1 / (1 + 0.75 * (math.pi / 2) / 0.7), 4) in a
    b = at(2)
    assert b[3.0] and b[round(3 + math.sqrt(18), 4)]


def test_spacing_factors_follow_the_stations(spark):
    df = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 4.0, 0.0, 0.0), (0, 2, 4.0, 4.0, 0.0)], "line int, ord int, x double, y double, z double")
    st = spark.createDataFrame([(0, 0, 0.0, 1.0), (0, 1, 2.0, 1.0), (0, 2, 4.0, 1.0), (0, 3, 99.0, 1.0)], "line int, station int, distance double, step double")
    got = {r.station: r.factor for r in T.spacing_factors(df, st, key="line", order="ord").collect()}
    assert [round(got[k], 9) for k in range(4)] == [1.0, 1.0, round(1 / (1 + 0.75 * (math.pi / 2) / 0.7), 9), 1.0]


def test_trace_layers(spark):
    df = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 10.0, 0.0, 0.0)], "line int, ord int, x double, y double, z double")
    wall = spark.createDataFrame([(5.0, 0.0, 1.5)], "x double, y double, z double")
    got = {(r.layer, r.clear, r.first, r.last) for r in T.trace_layers(df, wall, [("low", 0.5), ("eye", 1.5)], key="line", order="ord", spacing=1.0, reach=0.5, least=2).collect()}
    assert got == {("low", True, 1, 12), ("eye", True, 1, 5), ("eye", False, 6, 6), ("eye", True, 7, 12)}


def test_pocket_routes(spark):
    """A long corridor and a short spur are found, walls and specks are not."""
    cells = spark.createDataFrame([(y * 100 + x, x, y, float(x), float(y), 0.0) for y in range(8) for x in range(12)], "id int, ix int, iy int, x double, y double, z double")
    edges = G.grid_edges(cells, offsets=((1, 0), (0, 1)))
    miss = [200 + x for x in range(12)] + [600 + x for x in range(4)] + [9, 409]
    got = T.pocket_routes(cells, edges, spark.createDataFrame([(i,) for i in miss], "id int"), radius=0.1).collect()
    assert {r.id for r in got} == set(miss[:16])
    assert {r.pocket for r in got if r.id < 300} == {1} and {r.pocket for r in got if r.id >= 600} == {2}
    long = {}
    for r in got:
        long.setdefault(r.route, []).append((r.ord, r.x))
    assert all(abs(b[1] - a[1]) == 1 for line in long.values() for a, b in zip(sorted(line), sorted(line)[1:], strict=False))
    assert max(abs(line[0][1] - line[-1][1]) for line in (sorted(v) for v in long.values())) <= 4
    assert T.pocket_routes(cells, edges, spark.createDataFrame([(9,)], "id int"), radius=0.1).count() == 0


def rings(n, pair):
    turn = [2 * math.pi * i / n for i in range(n)]
    main = [(pair, "main", i, 2 * math.cos(a), 2 * math.sin(a), 0.0) for i, a in enumerate(turn)]
    other = [(pair, "other", i, 6 + 2 * math.cos(a), 2 * math.sin(a), 0.0) for i, a in enumerate(turn)]
    return main + other + [(pair, "bridge", i, x, 0.0, 0.0) for i, x in enumerate((2.0, 3.0, 4.0))]


def test_spliced_loops(spark):
    df = spark.createDataFrame(rings(24, 0) + rings(8, 1), "pair int, part string, ord int, x double, y double, z double")
    entries = spark.createDataFrame([(0, 0, 12), (1, 0, 4)], "pair int, entry int, other_entry int")
    none = spark.createDataFrame([], "x double, y double")
    got = T.spliced_loops(df, entries, none, reach=0.2).orderBy("ord").collect()
    assert {r.pair for r in got} == {0}
    p = [(r.x, r.y) for r in got]
    assert p[0] == p[-1] == (2.0, 0.0) and max(x for x, _ in p) == 8.0
    jumps = [i for i, (a, b) in enumerate(zip(p, p[1:], strict=False)) if math.dist(a, b) > 1.001]
    assert len(jumps) == 1
    a, b = p[jumps[0]], p[jumps[0] + 1]
    mid = spark.createDataFrame([((a[0] + b[0]) / 2, (a[1] + b[1]) / 2)], "x double, y double")
    other = T.spliced_loops(df, entries, mid, reach=0.05).orderBy("ord").collect()
    assert [(r.x, r.y) for r in other] != p
    walls = spark.createDataFrame([(3.0, y / 10) for y in range(-30, 31)], "x double, y double")
    assert T.spliced_loops(df, entries, walls, reach=0.2).count() == 0


def test_sampled_parts_rerun_alike(spark):
    up = (0.0, 0.0, 1.0)
    row = (0, 1, 5, (0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), up, up, up, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.5, None)
    v = "struct<x:double,y:double,z:double>"
    df = spark.createDataFrame([row], f"part int, tri int, material int, a {v}, b {v}, c {v}, na {v}, nb {v}, nc {v}, ua double, va double, ub double, vb double, uc double, vc double, area double, variation double")
    counts = spark.createDataFrame([(0, 500)], "part int, n int")
    one = M.sampled_parts(df, counts, seed=3, curvature=1.0, texture=1.0).collect()
    assert sorted(one) == sorted(M.sampled_parts(df, counts, seed=3, curvature=1.0, texture=1.0).collect()) and len(one) == 500
    assert all(r.p.x >= 0 and r.p.y >= 0 and r.p.x + r.p.y <= 1 + 1e-12 for r in one)
    assert abs(sum(r.p.x for r in one) / 500 - 1 / 3) < 0.05 and abs(sum(r.p.y for r in one) / 500 - 1 / 3) < 0.05
    assert sorted(one) != sorted(M.sampled_parts(df, counts, seed=4).collect())


def test_reconciled_keeps_scores(spark):
    v = "struct<x:double,y:double,z:double>"
    tri = spark.createDataFrame([(0, "o", (0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), 0.0, 1.0, 1.0)], f"tri int, owner string, a {v}, b {v}, c {v}, va double, vb double, vc double")
    targets = spark.createDataFrame([(1, (0.25, 0.25, 0.1), None), (2, (0.25, 0.25, 0.1), 1.0), (3, (9.0, 9.0, 9.0), None)], f"id int, p {v}, score double")
    got = {r.id: (r.score, r.weak) for r in M.reconciled(targets, tri, cell=1.0, reach=0.5).collect()}
    assert got[1] == (pytest.approx(0.5), True) and got[2] == (1.0, False) and got[3] == (None, None)


def test_finished_stroke(spark):
    sel = lambda *i: spark.createDataFrame([(x,) for x in i], "id int")
    h = spark.createDataFrame([], "stroke long, id int, added boolean")
    h = Q.finished_stroke(h, sel(1, 2), sel(2, 3))
    assert sorted(h.collect()) == [(1, 1, False), (1, 3, True)]
    assert sorted(Q.finished_stroke(h, sel(4), sel(4)).collect()) == sorted(h.collect())
    assert sorted(Q.finished_stroke(h, sel(), sel(7), keep=1).collect()) == [(2, 7, True)]


def test_merge_and_export(spark, tmp_path):
    from sightline.sources import ply

    one = lambda i: spark.createDataFrame([(i, 1.0, 2.0, float(i), 0.5, 0.5, 0.5, 0.5, 2.0)], "id int, x double, y double, z double, r double, g double, b double, alpha double, spacing double").withColumns({n: V.vec(*[F.lit(float(k == j)) for k in range(3)]) for j, n in enumerate(("tangent", "bitangent", "normal"))})
    got = X.merge_and_export([one(0), one(1)], str(tmp_path / "out"), unit_metres=0.5, table=str(tmp_path / "table"))
    assert got["count"] == 2 and json.load(open(got["metadata"]))["world_unit_to_meters"] == 0.5
    back = ply.read(spark, got["ply"]).orderBy("id").collect()
    assert [r.z for r in back] == [0.0, 1.0] and back[0].rot_0 == 1.0 and back[0].scale_0 == 0.0 and back[0].nz == 1.0
    with pytest.raises(ValueError):
        X.splats([])
    assert X.save_sequence({"b": 1, "a": [2]}, str(tmp_path / "s" / "seq.json")) == '{"a":[2],"b":1}' and json.load(open(tmp_path / "s" / "seq.json")) == {"a": [2], "b": 1}


def test_run_batch(tmp_path):
    result, log = tmp_path / "r.json", tmp_path / "l.txt"
    write = lambda body, text, code: [sys.executable, "-c", f"open({str(result)!r}, 'w').write({json.dumps(body)!r}); print({text!r}); raise SystemExit({code})"]
    run = lambda c: R.run_batch(c, log=str(log), result=str(result), start=1, attempt=0, patterns={"memory": "out of memory"}, pause=0.05)
    good = {"verified": True, "state": "done", "start": 1, "end": 5, "next_start": 6}
    a = run(write(good, "fine", 0))
    assert a["success"] and a["end"] == 5 and a["peak_bytes"] > 0 and a["faults"] == []
    assert not run(write(good, "CUDA Out of Memory", 0))["success"]
    assert not run(write({**good, "verified": False}, "fine", 0))["success"]
    assert run(write(good, "fine", 3))["return_code"] == 3
    # an old result does not stand in for a missing one
    b = run([sys.executable, "-c", "pass"])
    assert not b["success"] and not b["verified"] and b["start"] == 0


def test_stop_recording(spark, tmp_path):
    points = spark.createDataFrame([("a", i, float(i), float(i % 2), 0.0) for i in range(6)], R.OUT)
    points.write.parquet(str(tmp_path / "in"))
    stream = R.record(spark.readStream.schema(R.OUT).parquet(str(tmp_path / "in")), 0.5)
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    got = R.stop_recording(q, spark, str(tmp_path / "out")).orderBy("seq").collect()
    assert not q.isActive and [r.seq for r in got] == list(range(6)) and [r.y for r in got] == [0.0, 0.5, 0.5, 0.5, 0.5, 1.0]
