"""Scalar and spatial queries over proxies: part as points, lineitem as normals and views, embeddings as vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import vectors as V
from sightline.operators import spatial as S
from sightline.plans.coverage_queries import t


def points(s, d) -> DataFrame:
    return t(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 40 / 4.0).alias("x"), (F.floor(F.col("p_partkey") / 40) / 4.0).alias("y"), (F.col("p_size") / 10.0).alias("z"))


POINTS = "(select p_partkey as id, p_partkey % 40 / 4.0::double as x, p_partkey // 40 / 4.0::double as y, p_size / 10.0::double as z from part)"


def vecs(s, d) -> DataFrame:
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", V.vec(F.col("l_linenumber") - 4, F.col("l_suppkey") % 7 - 3, F.col("l_quantity") % 9 - 4).alias("n"))


VECS = "(select *, (l_linenumber - 4)::double as nx, (l_suppkey % 7 - 3)::double as ny, (l_quantity::bigint % 9 - 4)::double as nz from lineitem)"
UNIT = f"(select *, case when l > 1e-12 then nx * (1 / l) else 1 end as ux, case when l > 1e-12 then ny * (1 / l) else 0 end as uy, case when l > 1e-12 then nz * (1 / l) else 0 end as uz from (select *, sqrt(nx * nx + ny * ny + nz * nz) as l from {VECS}))"
_BIN = "cast(round_even(((atan2(uy, ux) + 2 * pi()) - floor((atan2(uy, ux) + 2 * pi()) / (2 * pi())) * 2 * pi()) / radians(15), 0) as bigint)"


def c3(s, d):
    u = vecs(s, d).withColumn("u", V.normalize(F.col("n")))
    return u.groupBy(V.surface_category(F.col("u")).alias("category")).agg(F.count(F.lit(1)).alias("cells"))


def c1(s, d):
    p = points(s, d)
    k = V.surface_key(F.lit("part"), F.col("id") % 8, V.vec(F.col("x"), F.col("y"), F.col("z")), V.vec(F.col("id") % 3 - 1, 0.0, 1.0), 0.5)
    return p.select(k.alias("k")).groupBy("k.face", "k.px", "k.py", "k.pz", "k.nx").agg(F.count(F.lit(1)).alias("n"))


def d18(s, d):
    pairs = S.radius_join(points(s, d), points(s, d), 1.5).where("l_id <> r_id")
    return pairs.groupBy(F.col("l_id").alias("id")).agg(F.count(F.lit(1)).alias("views"), F.round(F.min("distance2"), 9).alias("nearest2"))


def d9(s, d):
    return S.nearest(S.radius_join(points(s, d), points(s, d), 0.5, ("x", "y")).where("l_id <> r_id"), "l_id", ["distance2", F.desc("r_z"), "r_id"]).select(F.col("l_id").alias("id"), F.col("r_id").alias("nearest"), F.round("distance2", 9).alias("d2"))


def d10(s, d):
    e = t(s, d, "embeddings")
    return S.knn_to_queries(e.where("vec_id % 50 = 0"), e, query="vec_id", row="vec_id", vector="embedding", k=8)


def c21(s, d):
    v = t(s, d, "lineitem").select("l_partkey", V.vec(F.col("l_linenumber") / 10.0, F.col("l_suppkey") % 5 / 10.0, 1.0).alias("o"), V.vec(0.0, 0.0, 0.0).alias("p"))
    return S.adequate(v, target="l_partkey", pos="o", at="p")


def d25(s, d):
    v = t(s, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), V.vec(F.col("l_quantity"), F.col("l_discount") * 100, 0.0).alias("pos"), V.vec(0.0, 0.0, 0.0).alias("at"))
    return S.greedy_independent(v, target="l_suppkey", order="o", pos="pos", at="at", baseline=12.0, degrees=12.0, most=5)


def d22(s, d):
    px = t(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 11 / 10.0).alias("r"), (F.col("p_size") / 50.0).alias("g"), (F.col("p_partkey") % 7 / 6.0).alias("b"))
    lg = t(s, d, "nation").select(F.col("n_nationkey").alias("position"), (F.col("n_nationkey") % 5 / 4.0).alias("r"), (F.floor(F.col("n_nationkey") / 5) / 4.0).alias("g"), F.lit(0.5).alias("b"))
    return S.nearest_colour(px, lg)


def boxes(s):
    """Two walls as triangles: at y = 2 for x in 0..4, at y = 5 for x in 0..9."""
    rows = []
    for owner, y, x in (("near", 2.0, 4.0), ("far", 5.0, 9.0)):
        a, b, c, e = ([0.0, y, 0.0], [x, y, 0.0], [x, y, 6.0], [0.0, y, 6.0])
        rows += [(2 * len(rows), owner, a, b, c), (2 * len(rows) + 1, owner, a, c, e)]
    df = s.createDataFrame(rows, "tri int, owner string, a array<double>, b array<double>, c array<double>")
    return df.select("tri", "owner", *[V.vec(F.col(v)[0], F.col(v)[1], F.col(v)[2]).alias(v) for v in "abc"])


def d1(s, d):
    rays = points(s, d).select(F.col("id").alias("ray"), V.vec(F.col("x") + 0.01, F.lit(0.0), F.col("z") + 0.003).alias("o"), V.vec(0.0, 1.0, 0.0).alias("d"))
    return S.nearest_hit(rays, boxes(s), cell=1.0, reach=8.0).select("ray", "owner", F.round("t", 6).alias("t"))


def c17(s, d):
    seg = points(s, d).select(F.col("id").alias("ray"), V.vec(F.col("x") + 0.01, F.lit(0.0), F.col("z") + 0.003).alias("o"), V.vec(F.col("x") + 0.01, F.lit(5.0), F.col("z") + 0.003).alias("target"))
    return S.visible(seg, boxes(s), cell=1.0, reach=8.0, tolerance=5e-4)


def d30(s, d):
    o = t(s, d, "orders").select("o_orderkey", "o_totalprice")
    new = o.where("o_orderkey % 10 <> 3").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 5, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).unionByName(o.limit(0))
    return S.snapshot_diff(o.where("o_orderkey % 10 <> 7"), new, "o_orderkey", "o_totalprice")


QUERIES = {
    "c1_surface_key": c1,
    "c2_origin_key": lambda s, d: points(s, d).select(V.origin_key(V.vec(F.col("x"), F.col("y"), F.col("z")), 0.3).alias("k")).groupBy("k.x", "k.y", "k.z").agg(F.count(F.lit(1)).alias("n")),
    "c3_surface_category": c3,
    "c4_direction_bin": lambda s, d: vecs(s, d).select(V.direction_bin(V.normalize(F.col("n"))).alias("b")).groupBy("b.yaw", "b.pitch").agg(F.count(F.lit(1)).alias("n")),
    "c8_horizontal_clearance": lambda s, d: t(s, d, "lineitem").groupBy("l_partkey").agg(F.least(F.min("l_quantity"), F.lit(10.0)).alias("clearance")),
    "c13_in_oriented_box": lambda s, d: points(s, d).select("id", ((F.abs((F.col("x") - 5) * 0.8 + (F.col("y") - 5) * 0.6) <= 2) & (F.abs((F.col("y") - 5) * 0.8 - (F.col("x") - 5) * 0.6) <= 3)).alias("inside")),
    "c17_visible": c17,
    "c21_adequate": c21,
    "c24_projection": lambda s, d: points(s, d).select("id", V.project(V.vec(F.col("x"), F.col("y"), F.col("z")), [[1, 0, 0, -5], [0, 0, -1, 2], [0, 1, 0, -1]], 800.0, 800.0, 320.0, 240.0).alias("p")).select("id", F.round("p.u", 6).alias("u"), F.round("p.v", 6).alias("v"), "p.valid"),
    "c27_intrinsics": lambda s, d: t(s, d, "part").select("p_partkey", V.intrinsics(F.col("p_size") * 20.0, F.lit(480.0), F.lit(24.0), F.lit(36.0), F.lit(1.25)).alias("i")).select("p_partkey", *[F.round(f"i.{c}", 6).alias(c) for c in ("fx", "fy", "cx", "cy")]),
    "c30_group_hue": lambda s, d: t(s, d, "part").select("p_partkey", F.round(V.group_hue(F.col("p_partkey")), 6).alias("hue")),
    "c31_palette": lambda s, d: t(s, d, "lineitem").groupBy(V.palette(F.col("l_discount") * 10).alias("colour")).agg(F.count(F.lit(1)).alias("n")),
    "c32_splat_columns": lambda s, d: t(s, d, "part").select("p_partkey", F.round(F.ln(F.lit(0.5) * F.col("p_size")), 9).alias("log_scale"), F.round(F.ln(F.lit(0.025) * F.col("p_size")), 9).alias("log_thickness"), F.round((V.clamp(F.col("p_size") / 50.0, 1e-4, 1 - 1e-4)), 9).alias("alpha"), F.round(F.ln(V.clamp(F.col("p_size") / 50.0, 1e-4, 1 - 1e-4) / (1 - V.clamp(F.col("p_size") / 50.0, 1e-4, 1 - 1e-4))), 6).alias("logit"), F.round((F.col("p_size") / 50.0 - 0.5) / 0.28209479177387814, 9).alias("dc")),
    "c37_segment_key": lambda s, d: t(s, d, "events").groupBy(F.when(F.col("event_type") == "view", "POLAR").when(F.col("event_type") == "click", "BRIDGE").when(F.col("value") > 50, "COVERAGE").otherwise("BASE").alias("kind")).agg(F.count(F.lit(1)).alias("n")),
    "c39_look_angles": lambda s, d: points(s, d).select("id", V.look_angles(V.vec(5.0, 5.0, 2.5), V.vec(F.col("x"), F.col("y"), F.col("z"))).alias("a")).select("id", F.round("a.yaw", 9).alias("yaw"), F.round("a.pitch", 9).alias("pitch")),
    "c22_exclusions": lambda s, d: points(s, d).where("not (x between 2 and 4 and y between 1 and 3)").select("id"),
    "b14_depth_millimetres": lambda s, d: t(s, d, "lineitem").groupBy(V.depth_to_millimetres(F.col("l_quantity") * 1.75, F.col("l_returnflag") != "N").alias("depth")).agg(F.count(F.lit(1)).alias("n")),
    "b15_normal_16bit": lambda s, d: t(s, d, "lineitem").groupBy(V.normal_to_16bit(F.col("l_discount") * 20 - 1).alias("code")).agg(F.count(F.lit(1)).alias("n")),
    "d1_nearest_hit": d1,
    "d9_nearest_cell": d9,
    "d10_knn": d10,
    "d18_radius_join": d18,
    "d22_nearest_colour": d22,
    "d25_independent_views": d25,
    "d30_snapshot_diff": d30,
    "k_names": lambda s, d: t(s, d, "part").select("p_partkey", V.safe_name(F.concat(F.col("p_name"), F.lit(" #/x"))).alias("safe"), V.slug(F.col("p_brand")).alias("slug"), V.numbered("frame_", F.col("p_partkey"), 6).alias("stem"), V.trailing_number(F.col("p_brand")).alias("number")),
    "k_durations": lambda s, d: t(s, d, "part").select("p_partkey", V.duration(F.col("p_partkey") * 37.5).alias("elapsed")),
}
SQL = {
    "c1_surface_key": f"select id % 8 as face, cast(floor(x / 0.5 + 0.5) as bigint) as px, cast(floor(y / 0.5 + 0.5) as bigint) as py, cast(floor(z / 0.5 + 0.5) as bigint) as pz, (id % 3 - 1) * 8 as nx, count(*) as n from {POINTS} group by 1, 2, 3, 4, 5",
    "c2_origin_key": f"select cast(round_even(x / 0.3::double, 0) as bigint) as x, cast(round_even(y / 0.3::double, 0) as bigint) as y, cast(round_even(z / 0.3::double, 0) as bigint) as z, count(*) as n from {POINTS} p group by 1, 2, 3",
    "c3_surface_category": f"select case when uz >= cos(radians(25)) then 'floor' when uz <= -cos(radians(25)) then 'ceiling' when abs(uz) <= sin(radians(25)) then 'vertical' when abs(uz) < cos(radians(25)) then 'slanted' else 'other' end as category, count(*) as cells from {UNIT} group by 1",
    "c4_direction_bin": f"select {_BIN} as yaw, cast(round_even(asin(least(greatest(uz, -1), 1)) / radians(15), 0) as bigint) as pitch, count(*) as n from {UNIT} group by 1, 2",
    "c8_horizontal_clearance": "select l_partkey, least(min(l_quantity), 10.0) as clearance from lineitem group by 1",
    "c13_in_oriented_box": f"select id, abs((x - 5) * 0.8::double + (y - 5) * 0.6::double) <= 2 and abs((y - 5) * 0.8::double - (x - 5) * 0.6::double) <= 3 as inside from {POINTS}",
    "c17_visible": f"select id as ray, not (x + 0.01 <= 4) as visible from {POINTS}",
    "c21_adequate": "with v as (select l_partkey, l_linenumber / 10.0::double as x, l_suppkey % 5 / 10.0::double as y, row_number() over () as i from lineitem) select l_partkey, coalesce(bool_or(ok), false) as adequate from (select a.l_partkey, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) >= 0.12 and acos(least(1, greatest(-1, (a.x * b.x + a.y * b.y + 1) / (sqrt(a.x * a.x + a.y * a.y + 1) * sqrt(b.x * b.x + b.y * b.y + 1))))) >= radians(12) as ok from v a join v b using (l_partkey)) group by 1",
    "c24_projection": f"select id, case when y - 1 > 1e-9 then round(800 * (x - 5) / (y - 1) + 320, 6) end as u, case when y - 1 > 1e-9 then round(800 * (2 - z) / (y - 1) + 240, 6) end as v, y - 1 > 1e-9 as valid from {POINTS}",
    "c27_intrinsics": "select p_partkey, round(f, 6) as fx, round(f / 1.25, 6) as fy, round(p_size * 20.0::double / 2, 6) as cx, 240.0::double as cy from (select *, case when p_size * 20.0::double >= 600 then p_size * 20.0::double * 24 / 36 else 600.0::double * 24 / 36 end as f from part)",
    "c30_group_hue": "select p_partkey, round(p_partkey * 0.618033988749895::double - floor(p_partkey * 0.618033988749895::double), 6) as hue from part",
    "c31_palette": "select case when l_discount * 10 < 1 / 3.0::double then 'red' when l_discount * 10 < 2 / 3.0::double then 'yellow' else 'green' end as colour, count(*) as n from lineitem group by 1",
    "c32_splat_columns": "select p_partkey, round(ln(0.5::double * p_size), 9) as log_scale, round(ln(0.025::double * p_size), 9) as log_thickness, round(a, 9) as alpha, round(ln(a / (1 - a)), 6) as logit, round((p_size / 50.0::double - 0.5) / 0.28209479177387814::double, 9) as dc from (select *, least(greatest(p_size / 50.0::double, 1e-4::double), 1 - 1e-4::double) as a from part)",
    "c37_segment_key": "select case when event_type = 'view' then 'POLAR' when event_type = 'click' then 'BRIDGE' when value > 50 then 'COVERAGE' else 'BASE' end as kind, count(*) as n from events group by 1",
    "c39_look_angles": f"select id, case when r > 1e-9 then round(atan2(y - 5, x - 5), 9) else 0 end as yaw, case when r > 1e-9 then round(asin(least(1, greatest(-1, (z - 2.5) / r))), 9) else 0 end as pitch from (select *, sqrt((x - 5) ** 2 + (y - 5) ** 2 + (z - 2.5) ** 2) as r from {POINTS})",
    "c22_exclusions": f"select id from {POINTS} where not (x between 2 and 4 and y between 1 and 3)",
    "b14_depth_millimetres": "select case when l_returnflag <> 'N' then least(greatest(floor(l_quantity * 1.75::double * 1000 + 0.5), 0), 65535)::int else 0 end as depth, count(*) as n from lineitem group by 1",
    "b15_normal_16bit": "select floor(least(greatest((l_discount * 20 - 1 + 1) / 2, 0), 1) * 65535 + 0.5)::int as code, count(*) as n from lineitem group by 1",
    "d1_nearest_hit": f"select id as ray, case when x + 0.01 <= 4 then 'near' else 'far' end as owner, case when x + 0.01 <= 4 then 2.0::double else 5.0::double end as t from {POINTS} where z + 0.003 <= 6 and x + 0.01 <= 9",
    "d9_nearest_cell": f"select id, nearest, round(d2, 9) as d2 from (select a.id, b.id as nearest, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 as d2, row_number() over (partition by a.id order by (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.z desc, b.id) as n from {POINTS} a, {POINTS} b where b.id <> a.id and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.25) where n = 1",
    "d10_knn": "select q, r, rank, round(d2, 6) as d2 from (select q, r, d2, cast(row_number() over (partition by q order by d2, r) as int) as rank from (select a.vec_id as q, b.vec_id as r, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))) as d2 from embeddings a, embeddings b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id)) where rank <= 8",
    "d18_radius_join": f"select a.id, count(*) as views, round(min((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 9) as nearest2 from {POINTS} a, {POINTS} b where b.id <> a.id and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 2.25 group by 1",
    "d22_nearest_colour": "with p as (select p_partkey as id, p_partkey % 11 / 10.0::double as r, p_size / 50.0::double as g, p_partkey % 7 / 6.0::double as b from part), q as (select n_nationkey as position, n_nationkey % 5 / 4.0::double as r, n_nationkey // 5 / 4.0::double as g, 0.5::double as b from nation), x as (select p.id, q.position, pow(p.r - q.r, 2) + pow(p.g - q.g, 2) + pow(p.b - q.b, 2) as d2 from p, q) select id, case when min(d2) < 0.04 then arg_min(position, (d2, position)) + 1 else -1 end as value from x group by 1",
    "d30_snapshot_diff": "select o_orderkey, case when k = 7 then 'added' when k = 3 then 'removed' else 'changed' end as change from (select o_orderkey, o_orderkey % 10 as k from orders) where k in (3, 5, 7)",
    "k_names": "select p_partkey, trim(regexp_replace(p_name || ' #/x', '[^A-Za-z0-9_.-]+', '_', 'g'), '_') as safe, trim(lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', '-', 'g')), '-') as slug, 'frame_' || lpad(p_partkey::varchar, 6, '0') as stem, regexp_extract(p_brand, '([0-9]+)$', 1) as number from part",
    "k_durations": "select p_partkey, (s // 3600)::varchar || ':' || lpad((s % 3600 // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') as elapsed from (select p_partkey, floor(p_partkey * 37.5::double)::bigint as s from part)",
}
