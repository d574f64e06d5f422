import math

import pytest
from pyspark.sql import functions as F

from sightline.operators import coverage, paths, quota, validate
from sightline.sources import colmap, manifest, ply
from sightline.streaming import recorder


def test_ply_round_trip(spark, tmp_path):
    df = spark.range(1000).select("id", *[(F.col("id") * (i + 1) / 7).alias(c) for i, c in enumerate(ply.SPLAT_COLUMNS)]).repartition(5)
    path = str(tmp_path / "s.ply")
    assert ply.write(df, path) == 1000
    back = ply.read(spark, path).orderBy("id").collect()
    want = df.select("id", *[F.col(c).cast("float") for c in ply.SPLAT_COLUMNS]).orderBy("id").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in want]
    assert ply.write(df.limit(0), path) == 0


def test_colmap_lines(spark, tmp_path):
    cams = spark.createDataFrame([(5, 640, 480, 500.0), (2, 320, 240, 250.0), (7, 640, 480, 500.0)], "n long, width int, height int, fx double").withColumns({"fy": F.col("fx"), "cx": F.col("width") / 2, "cy": F.col("height") / 2})
    c = colmap.with_profile(cams, ["width", "height", "fx", "fy", "cx", "cy"], "n")
    assert {r.n: r.camera_id for r in c.collect()} == {2: 1, 5: 2, 7: 2}
    lines = [r.value for r in colmap.camera_lines(c).orderBy("camera_id").collect()]
    assert lines[0] == "1 PINHOLE 320 240 250.0000000000 250.0000000000 160.0000000000 120.0000000000" and len(lines) == 2
    pts = spark.createDataFrame([(i, i / 2, 0.0, 1.0, 1, 2, 3) for i in range(50)], "point_id long, x double, y double, z double, r int, g int, b int").repartition(4)
    colmap.write_lines(colmap.point_lines(pts), ["point_id"], str(tmp_path / "points"))
    assert [int(x.split()[0]) for f in sorted((tmp_path / "points").glob("part-*")) for x in f.read_text().splitlines()] == list(range(50))


def test_manifest(spark, tmp_path):
    p = str(tmp_path / "m.json")
    assert manifest.read_json(p, {"a": 0}) == {"a": 0}
    manifest.write_json(p, {"b": [1, "é"]})
    assert manifest.read_json(p) == {"b": [1, "é"]}
    assert manifest.fingerprint({"x": 1, "y": 2}) == manifest.fingerprint({"y": 2, "x": 1}) and len(manifest.short_signature(1)) == 16
    s = str(tmp_path / "snap")
    assert manifest.load_snapshot(spark, s, 1) is None
    manifest.save_snapshot(spark.range(3), s, {"config": 1})
    assert manifest.load_snapshot(spark, s, {"config": 1}).count() == 3 and manifest.load_snapshot(spark, s, {"config": 2}) is None


def test_recorder_goes_on_where_it_stopped(spark, tmp_path):
    pytest.importorskip("pandas")
    pts = [("a", i, i * 0.4, 0.0, 0.0) for i in range(30)] + [("b", i, 0.0, math.sin(i), 0.0) for i in range(20)]
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    kept: dict = {}
    for part in (0, 1):
        rows = [p for p in pts if (p[1] >= 12) == bool(part)]
        spark.createDataFrame(rows, recorder.OUT).coalesce(1).write.mode("append").parquet(src)
        recorder.run_available(recorder.record(spark.readStream.schema(recorder.OUT).parquet(src), 1.0), out, cp)
    for k, s, *p in sorted(pts):
        if not kept.get(k) or math.dist(p, kept[k][-1][1]) >= 1.0:
            kept.setdefault(k, []).append((s, p))
    got = sorted((r.key, r.seq) for r in spark.read.parquet(out).collect())
    assert got == sorted((k, s) for k, v in kept.items() for s, _ in v)


def test_chunks_and_supervisor(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    spark.range(10).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema("id long").parquet(src)
    recorder.commit_chunks(stream(), cp, out, lambda b: b.withColumn("done", F.lit(True)))
    spark.range(10, 15).write.mode("append").parquet(src)
    recorder.commit_chunks(stream(), cp, out, lambda b: b.withColumn("done", F.lit(True)))
    assert sorted(r.id for r in recorder.read_chunks(spark, out).collect()) == list(range(15))
    ran, bad = [], {5}

    def job(a, b):
        if b - a > 2 and bad & set(range(a, b)):
            raise RuntimeError("too large")
        ran.append((a, b))

    assert recorder.supervise(job, 12, 4) == [(0, 4), (4, 6), (6, 8), (8, 12)]


def test_conservation(spark):
    w = spark.createDataFrame([(i, float(i * i % 17)) for i in range(23)], "k long, w double")
    for total in (0, 1, 22, 23, 100, 997):
        assert quota.largest_remainder(w, weight="w", total=total, key="k").agg(F.sum("share")).first()[0] == total
        assert quota.at_least_one(w, weight="w", total=total, key="k").agg(F.sum("share")).first()[0] == total
    assert quota.systematic_sample(w, weight="w", order=["k"], count=50).agg(F.sum("taken")).first()[0] == 50


def test_images(spark):
    rows = [(1, bytearray(b"\x89PNG\r\n\x1a\n....")), (2, bytearray(b"\xff\xd8..\xff\xd9")), (3, bytearray(b"\x76\x2f\x31\x01")), (4, bytearray(b"\xff\xd8..")), (5, None)]
    df = spark.createDataFrame(rows, "i int, c binary").select("i", validate.image_kind(F.col("c")).alias("k"))
    assert [r.k for r in df.orderBy("i").collect()] == ["png", "jpeg", "exr", None, None]


def test_merge_keeps_the_first_of_equals(spark):
    a = spark.createDataFrame([(1, 5.0), (2, 3.0)], "k long, m double")
    b = spark.createDataFrame([(1, 5.0), (2, 2.0), (3, 9.0)], "k long, m double")
    assert sorted(map(tuple, coverage.merge_first_wins([a, b], ["k"], "m").collect())) == [(1, 5.0, 0), (2, 2.0, 1), (3, 9.0, 1)]


def test_subtraction_complements_the_cuts(spark):
    whole = spark.createDataFrame([("a", 0.0, 10.0), ("b", 0.0, 5.0)], "k string, lo double, hi double")
    cuts = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.5, 4.0), ("a", 9.0, 12.0), ("a", 20.0, 30.0)], "k string, lo double, hi double")
    got = sorted(map(tuple, paths.subtract_intervals(whole, cuts, key="k").collect()))
    assert got == [("a", 0.0, 1.0), ("a", 4.0, 9.0), ("b", 0.0, 5.0)]
