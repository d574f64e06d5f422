"""Camera queries over supplier as cameras, nation as configurations and part as stations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import cameras as C
from sightline.plans.coverage_queries import t
from sightline.plans.space_queries import POINTS, points


def turned(angle, x, y, z):
    """A matrix that turns about the upright axis and moves."""
    return C.matrix([F.cos(angle), -F.sin(angle), 0.0, x], [F.sin(angle), F.cos(angle), 0.0, y], [0.0, 0.0, 1.0, z])


def posed(s, d):
    k = F.col("s_suppkey")
    return t(s, d, "supplier").select(k.alias("camera"), turned(k / 10.0, k % 7 / 1.0, k % 5 / 1.0, k % 3 / 1.0).alias("m"))


def configs(s, d):
    n = F.col("n_nationkey")
    return t(s, d, "nation").select(n.alias("id"), F.when(n % 3 != 0, n % 2 == 0).alias("scene_depth"), F.when(n % 5 != 0, n % 2 == 1).alias("object_mask"), F.when(n % 4 == 0, "PHYSICAL").alias("object_split_mode"))


def frustum_rows(s, d):
    k = F.col("s_suppkey")
    c = t(s, d, "supplier").select(k.alias("camera"), F.when(k % 6 == 0, "PANO").otherwise("PERSP").alias("kind"), turned(F.lit(0.0), k % 10 / 1.0, F.floor(k / 10) / 1.0, F.lit(8.0)).alias("camera_to_world"), *[F.lit(float(v)).alias(n) for n, v in (("width", 640), ("height", 480), ("fx", 500), ("fy", 500), ("cx", 320), ("cy", 240), ("near", 0.1), ("far", 7))])
    return C.frusta(c)


def seen(s, d):
    """Which points each camera's frustum holds, by buckets of the level reach of a frustum."""
    from sightline.operators.spatial import radius_join

    f = frustum_rows(s, d).select("*", F.col("origin.x").alias("x"), F.col("origin.y").alias("y"))
    p = points(s, d).select("id", "x", "y", "z")
    pairs = radius_join(f, p, 6.0, ("x", "y"))
    held = pairs.select(*[F.col(f"l_{c}").alias(c) for c in ("camera", "world_to_camera", "x0", "x1", "y0", "y1", "near", "far")], F.struct(*[F.col(f"r_{c}").alias(c) for c in "xyz"]).alias("p"))
    return held.where(C.in_frustum(F.col("p"))).groupBy("camera").agg(F.count(F.lit(1)).alias("points"))


def stations(s, d):
    p = points(s, d).select((F.col("id") % 50).alias("curve"), "id", "x", "y", F.when(F.col("id") % 3 == 0, F.lit(0.0)).otherwise(F.col("id") % 5 - 2.0).alias("tx"), F.when(F.col("id") % 3 == 0, F.lit(0.0)).otherwise(F.col("id") % 7 - 3.0).alias("ty"))
    return C.stable_forward(p, curve="curve", order="id").select("id", F.round("forward.x", 9).alias("fx"), F.round("forward.y", 9).alias("fy"))


def active_cameras(s, d):
    r = t(s, d, "supplier").select(F.col("s_suppkey").alias("name"), F.col("s_nationkey").alias("nation"))
    with_own = C.active(r.where("nation = 3"), r, r.where("nation = 4 or name % 50 = 0"))
    fallback = C.active(r.where("nation = 99"), r.where("nation < 5"), r.where("nation = 4 or nation = 7"))
    return with_own.select("name", F.lit("own").alias("how")).unionByName(fallback.select("name", F.lit("fallback").alias("how")))


def rigs(s, d):
    out = None
    for shape in ("sphere", "hemisphere", "cylinder", "half_cylinder", "grid", "cube"):
        r = C.rig(s, shape, radius=2.0).groupBy().agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")), 6).alias("r2"), F.round(F.min("z"), 6).alias("lowest")).withColumn("shape", F.lit(shape))
        out = r if out is None else out.unionByName(r)
    return out


def matrix_columns(m, cells):
    return [F.round(F.get(m, i), 9).alias(f"m{i}") for i in cells]


QUERIES = {
    "a1_output_config": lambda s, d: C.with_defaults(configs(s, d), keep=["id"]),
    "a16_active_cameras": active_cameras,
    "a18_frusta": lambda s, d: frustum_rows(s, d).select("camera", F.round("origin.x", 9).alias("ox"), *[F.round(c, 9).alias(c) for c in ("x0", "x1", "y0", "y1")]),
    "a19_usable_cameras": lambda s, d: C.usable(t(s, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 6 == 0, "PANO").otherwise("PERSP").alias("kind"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey") % 5 == 0).alias("preview"), (F.col("s_suppkey") % 7 == 0).alias("temporary"))).select("s_suppkey"),
    "a31_camera_records": lambda s, d: C.camera_record(posed(s, d).select("camera", F.col("m").alias("camera_to_world"), *[F.lit(v).alias(n) for n, v in (("width", 640), ("height", 480), ("fx", 500.0), ("fy", 500.0), ("cx", 320.0), ("cy", 240.0))])).select("camera", "record.index", "record.size.width", F.round(F.get("record.world_to_camera", 3), 9).alias("t0")),
    "b13_output_manifest": lambda s, d: C.output_manifest(C.with_defaults(configs(s, d), keep=["id"]), "id").select("id", F.get_json_object("manifest", "$.split").alias("split"), F.get_json_object("manifest", "$.internal_object_id_used").alias("ids"), F.get_json_object("manifest", "$.required_internal_passes").alias("passes")),
    "c19_frustum_points": seen,
    "c25_camera_to_world": lambda s, d: posed(s, d).select("camera", *matrix_columns(C.camera_to_world_opencv(F.col("m")), (0, 1, 3, 5, 7, 10, 11))),
    "c26_world_to_camera": lambda s, d: posed(s, d).select("camera", *matrix_columns(C.world_to_camera_opencv(F.col("m")), (0, 1, 3, 5, 7, 10, 11))),
    "c28_camera_parameters": lambda s, d: t(s, d, "part").select("p_partkey", C.camera_parameters(F.when(F.col("p_size") % 3 == 0, "PANO").otherwise("PERSP"), F.when(F.col("p_size") % 2 == 0, "EQUIRECTANGULAR").otherwise("FISHEYE"), F.col("p_size") * 20.0, F.lit(480.0), F.lit(24.0), F.lit(36.0), F.col("p_size") < 24, F.lit(24.0), F.lit(None).cast("double"), F.col("p_size") / 100.0, F.lit(-0.1)).alias("k")).select("p_partkey", *[F.round(f"k.{c}", 6).alias(c) for c in ("fx", "fy", "cx", "cy")]),
    "c41_stable_forward": stations,
    "c42_shell_radii": lambda s, d: t(s, d, "region").select("r_regionkey").withColumn("radius", F.explode(F.array(*[F.lit(round(v, 9)) for v in C.shell_radii(0.18, 0.06)]))),
    "c43_blender_from_colmap": lambda s, d: t(s, d, "supplier").select(F.col("s_suppkey").alias("camera"), C.blender_from_colmap([[F.cos(F.col("s_suppkey") / 10.0), -F.sin(F.col("s_suppkey") / 10.0), F.lit(0.0)], [F.sin(F.col("s_suppkey") / 10.0), F.cos(F.col("s_suppkey") / 10.0), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.0)]], [F.lit(1.0), F.lit(2.0), F.lit(3.0)]).alias("m")).select("camera", *matrix_columns(F.col("m"), (0, 1, 3, 5, 7, 11))),
    "c44_layers": lambda s, d: C.layers(s, 4, (0.4, 0.1, -0.2, -0.5)),
    "f37_axis_values": lambda s, d: t(s, d, "part").select("p_partkey", F.posexplode(C.axis_values(F.col("p_size") % 7 / 2.0, F.col("p_size") / 5.0, 0.6)).alias("k", "v")).select("p_partkey", "k", F.round("v", 9).alias("v")),
    "h32_seed_candidates": lambda s, d: C.seed_candidates(t(s, d, "supplier").select(F.col("s_suppkey").alias("origin"), (F.col("s_suppkey") % 6 / 1.0).alias("yaw"), F.lit(0.0).alias("pitch"), (F.col("s_suppkey") % 3 == 0).alias("allow_polar"), F.lit(1.0).alias("polar_yaw")), horizontal_fov=1.2, pitches=(-20.0, 0.0, 20.0)).groupBy("origin", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("yaw"), 6).alias("yaws"), F.round(F.sum("pitch"), 6).alias("pitches")),
    "h35_rigs": rigs,
    "h36_shell_group": lambda s, d: C.shell_group(points(s, d).select("id", "x", "y", "z"), F.lit(0.18)).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("position.x"), 6).alias("sx"), F.round(F.max("position.z"), 6).alias("top")),
    "h42_icosahedron": lambda s, d: s.createDataFrame([(i, *[round(v, 9) for v in p]) for i, p in enumerate(sorted(C.icosahedron()))], "k long, x double, y double, z double"),
    "h44_path_camera_count": lambda s, d: t(s, d, "part").select("p_partkey", C.path_camera_count(F.col("p_size") - 10.0, count=7, density=1.5, most=40).cast("long").alias("n")),
    "h45_first_cameras": lambda s, d: C.first_cameras(t(s, d, "supplier").select(F.col("s_name").alias("name"), "s_nationkey", (F.col("s_suppkey") % 9 == 0).alias("selected")), most=8, key=["s_nationkey"]).select("name", "new_name"),
    "i19_pose_check": lambda s, d: posed(s, d).select("camera", C.pose_matches(turned(F.col("camera") / 10.0 + F.when(F.col("camera") % 4 == 0, 1e-3).otherwise(0.0), F.col("camera") % 7 / 1.0 + F.when(F.col("camera") % 5 == 0, 1e-3).otherwise(0.0), F.col("camera") % 5 / 1.0, F.col("camera") % 3 / 1.0), F.col("m")).alias("ok")),
    "i20_inverse_check": lambda s, d: posed(s, d).select("camera", C.are_inverse(F.col("m"), C.rigid_inverse(F.when(F.col("camera") % 4 == 0, turned(F.lit(0.5), F.lit(0.0), F.lit(0.0), F.lit(1.0))).otherwise(F.col("m")))).alias("ok")),
    "i21_recommended": lambda s, d: C.update_where(t(s, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("nation"), F.col("c_acctbal").cast("double").alias("balance")), {"balance": F.greatest("balance", F.lit(0.0))}, F.col("nation") < 10),
}

_M = "(select s_suppkey as camera, s_suppkey / 10.0::double as a, (s_suppkey % 7)::double as x, (s_suppkey % 5)::double as y, (s_suppkey % 3)::double as z from supplier)"
_SPLIT = "case when n_nationkey % 4 = 0 then 'PHYSICAL' else 'VIRTUAL' end"
_CONFIG = f"(select n_nationkey as id, true as rgb, case when n_nationkey % 3 <> 0 then n_nationkey % 2 = 0 else false end as scene_depth, false as object_depth, false as scene_normal, false as object_normal, case when n_nationkey % 5 <> 0 then n_nationkey % 2 = 1 else false end as object_mask, false as object_id, false as material_id, {_SPLIT} as object_split_mode from nation)"
SQL = {
    "a1_output_config": f"select * from {_CONFIG}",
    "a16_active_cameras": "select s_suppkey as name, 'own' as how from supplier where s_nationkey = 3 or s_nationkey = 4 or s_suppkey % 50 = 0 union all select s_suppkey, 'fallback' from supplier where s_nationkey < 5 or s_nationkey = 7",
    "a18_frusta": "select s_suppkey as camera, (s_suppkey % 10)::double as ox, round(-0.64::double + 1.28 * 0.03, 9) as x0, round(0.64::double - 1.28 * 0.03, 9) as x1, round(-0.48::double + 0.96 * 0.03, 9) as y0, round(0.48::double - 0.96 * 0.03, 9) as y1 from supplier where s_suppkey % 6 <> 0",
    "a19_usable_cameras": "select s_suppkey from supplier where s_suppkey % 6 <> 0 and not (s_suppkey % 4 <> 0 and s_suppkey % 5 = 0) and s_suppkey % 7 <> 0",
    "a31_camera_records": f"select camera, cast(row_number() over (order by camera) - 1 as int) as index, 640 as width, round(-(cos(a) * x + sin(a) * y), 9) as t0 from {_M}",
    "b13_output_manifest": f"select id, case when object_split_mode = 'PHYSICAL' then 'physical' else 'virtual' end as split, case when object_mask then 'true' else 'false' end as ids, '[' || case when scene_depth then '\"depth\",' else '' end || case when object_mask then '\"object_id\",' else '' end || '\"rgb\"]' as passes from {_CONFIG}",
    "c19_frustum_points": f"select camera, count(*) as points from (select s_suppkey as camera, s_suppkey % 10 as cx, s_suppkey // 10 as cy from supplier where s_suppkey % 6 <> 0) c, {POINTS} p where 8 - p.z between 0.1 and 7 and (p.x - cx) / (8 - p.z) between -0.64::double + 1.28 * 0.03 and 0.64::double - 1.28 * 0.03 and (p.y - cy) / (8 - p.z) between -0.48::double + 0.96 * 0.03 and 0.48::double - 0.96 * 0.03 group by 1",
    "c25_camera_to_world": f"select camera, round(cos(a), 9) as m0, round(sin(a), 9) as m1, x as m3, round(-cos(a), 9) as m5, y as m7, -1.0::double as m10, z as m11 from {_M}",
    "c26_world_to_camera": f"select camera, round(cos(a), 9) as m0, round(sin(a), 9) as m1, round(-(cos(a) * x + sin(a) * y), 9) as m3, round(-cos(a), 9) as m5, round(-(sin(a) * x - cos(a) * y), 9) as m7, -1.0::double as m10, z as m11 from {_M}",
    "c28_camera_parameters": "select p_partkey, round(case when p and e then w / (2 * pi()) when p then w / pi() when v then 480.0::double else 24 / 36.0::double * w end, 6) as fx, round(case when p and e then 480 / pi() when p then 480 / pi() when v then 480.0::double else 24 / 36.0::double * w end, 6) as fy, round(w / 2 - case when p then 0 else p_size / 100.0::double * w end, 6) as cx, round(240 + case when p then 0 else -48.0::double end, 6) as cy from (select *, p_size * 20.0::double as w, p_size % 3 = 0 as p, p_size % 2 = 0 as e, p_size < 24 as v from part)",
    "c41_stable_forward": f"select id, round(case when own >= 1e-8 then tx / own when chord >= 1e-8 then cx / chord else 0 end, 9) as fx, round(case when own >= 1e-8 then ty / own when chord >= 1e-8 then cy / chord else 1 end, 9) as fy from (select *, sqrt(tx * tx + ty * ty) as own, sqrt(cx * cx + cy * cy) as chord from (select id, case when id % 3 = 0 then 0.0::double else id % 5 - 2.0::double end as tx, case when id % 3 = 0 then 0.0::double else id % 7 - 3.0::double end as ty, coalesce(lead(x) over w, x) - coalesce(lag(x) over w, x) as cx, coalesce(lead(y) over w, y) - coalesce(lag(y) over w, y) as cy from {POINTS} window w as (partition by id % 50 order by id)))",
    "c42_shell_radii": "select r_regionkey, radius from region, (values (0.18::double), (0.153), (0.126), (0.099), (0.072), (0.06)) v(radius)",
    "c43_blender_from_colmap": "select s_suppkey as camera, round(cos(a), 9) as m0, round(-sin(a), 9) as m1, round(-(cos(a) + 2 * sin(a)), 9) as m3, round(-cos(a), 9) as m5, round(-(-sin(a) + 2 * cos(a)), 9) as m7, -3.0::double as m11 from (select s_suppkey, s_suppkey / 10.0::double as a from supplier)",
    "c44_layers": "select layer::int as layer, name, \"offset\" from (values (0, 'Upper', 0.4::double), (1, 'Upper_Middle', 0.1), (2, 'Lower_Middle', -0.2), (3, 'Lower', -0.5)) v(layer, name, \"offset\")",
    "f37_axis_values": "select p_partkey, k::int as k, round(case when hi <= lo + 1e-6 then (lo + hi) / 2 else (lo + hi - n * 0.6::double) / 2 + k * 0.6::double end, 9) as v from (select *, unnest(range(0, case when hi <= lo + 1e-6 then 1 else n + 1 end)) as k from (select p_partkey, lo, hi, greatest(1, floor((hi - lo) / 0.6::double))::int as n from (select p_partkey, p_size % 7 / 2.0::double as lo, p_size / 5.0::double as hi from part)))",
    "h32_seed_candidates": "select s_suppkey as origin, kind, case kind when 'base' then 1 when 'turn' then 42 else 2 end::bigint as n, round(case kind when 'base' then (s_suppkey % 6)::double when 'turn' then 3 * 91 * 2 * pi() / 14 else 2.0 end, 6) as yaws, 0.0::double as pitches from supplier, (values ('base'), ('turn'), ('polar')) v(kind) where kind <> 'polar' or s_suppkey % 3 = 0",
    "h36_shell_group": f"select id, 12::bigint as n, round(12 * x, 6) as sx, round(z + 0.18::double * ((1 + sqrt(5)) / 2) / sqrt(1 + ((1 + sqrt(5)) / 2) ** 2), 6) as top from {POINTS}",
    "h42_icosahedron": "with p as (select (1 + sqrt(5.0::double)) / 2 as p), v as (select 0.0 as x, a / n as y, b * p / n as z from (select p, sqrt(1 + p * p) as n from p), (values (1), (-1)) s(a), (values (1), (-1)) u(b) union all select a / n, b * p / n, 0.0 from (select p, sqrt(1 + p * p) as n from p), (values (1), (-1)) s(a), (values (1), (-1)) u(b) union all select b * p / n, 0.0, a / n from (select p, sqrt(1 + p * p) as n from p), (values (1), (-1)) s(a), (values (1), (-1)) u(b)) select row_number() over (order by x, y, z) - 1 as k, round(x, 9) as x, round(y, 9) as y, round(z, 9) as z from v",
    "h44_path_camera_count": "select p_partkey, case when p_size - 10 <= 1e-6 then 7 else greatest(1, least(40, ceil((p_size - 10) * 1.5::double))) end::bigint as n from part",
    "h45_first_cameras": "with c as (select s_name as name, s_nationkey from supplier where s_suppkey % 9 = 0), f as (select min(name) as name from c group by s_nationkey order by name limit 8) select name, 'Camera_' || lpad((row_number() over (order by name) - 1)::varchar, 5, '0') as new_name from f",
    "i19_pose_check": "select s_suppkey as camera, s_suppkey % 4 <> 0 and s_suppkey % 5 <> 0 as ok from supplier",
    "i20_inverse_check": "select s_suppkey as camera, s_suppkey % 4 <> 0 as ok from supplier",
    "i21_recommended": "select c_custkey, c_nationkey::bigint as nation, case when c_nationkey < 10 then greatest(c_acctbal::double, 0) else c_acctbal::double end as balance from customer",
}
