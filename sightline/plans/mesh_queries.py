"""Mesh and incremental queries over part as samples and supplier as cameras."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import vectors as V
from sightline.operators import meshes as M
from sightline.plans.coverage_queries import t
from sightline.plans.space_queries import POINTS, points

LIMITS = {"near": 0.35, "far": 3.0, "max_incidence": 75.0}


def samples(s, d):
    return points(s, d).withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0)})


def cameras(s, d):
    return t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 10 + 0.03).alias("x"), (F.floor(F.col("s_suppkey") / 10) + 0.07).alias("y"), (F.col("s_suppkey") % 4 + 0.5).alias("z"))


CAMERAS = "(select s_suppkey as id, s_suppkey % 10 + 0.03::double as x, s_suppkey // 10 + 0.07::double as y, s_suppkey % 4 + 0.5::double as z from supplier)"
VIEWS = f"(select sample, camera, distance, incidence from (select sample, camera, d as distance, degrees(acos(least(greatest(abs(dz / greatest(d, 1e-9::double)), 0), 1))) as incidence from (select a.id as sample, b.id as camera, b.z - a.z as dz, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) as d from {POINTS} a, {CAMERAS} b) where d <= 3) where distance >= 0.35 and incidence <= 75)"


def updated(s, d):
    x, c = samples(s, d), cameras(s, d)
    old = c.where("id % 3 <> 0")
    views, how = M.update_views(M.accepted_views(x, old, **LIMITS), x, old, c, **LIMITS)
    return M.coverage_scores(views, x).withColumn("how", F.lit(how)).withColumn("score", F.round("score", 9))


def quads(s, d):
    p = t(s, d, "nation").select(F.col("n_nationkey").alias("object"))
    w = F.col("object") % 5 + 1
    corners = F.array(*[F.struct(F.lit(i).alias("id"), (x * w).cast("double").alias("x"), F.lit(float(y)).alias("y"), F.lit(0.0).alias("z")) for i, (x, y) in enumerate(((0, 0), (1, 0), (1, 2), (0, 2)))])
    vertices = p.select("object", F.explode(corners).alias("v")).select("object", "v.*")
    return M.triangles(p.select("object", F.lit(0).alias("face"), F.array(*[F.lit(i) for i in range(4)]).alias("v")), vertices)


def offsets(s, d):
    lines = points(s, d).select(F.floor(F.col("id") / 8).alias("line"), "x", "y")
    return M.first_clear_offset(lines, points(s, d).where("z > 4.8").select("x", "y"), [(0.0, o * k * 0.15) for k in (1, 2, 3, 4) for o in (1, -1)], key="line", reach=0.2)


QUERIES = {
    "a3_triangles": lambda s, d: quads(s, d).select("object", "tri", "area", F.col("normal.z").alias("nz")),
    "a5_surface_lattice": lambda s, d: M.surface_lattice(quads(s, d), 0.5).groupBy("object").agg(F.count(F.lit(1)).alias("samples"), F.round(F.max("p.x"), 9).alias("reach")),
    "c18_accepted_views": lambda s, d: M.accepted_views(samples(s, d), cameras(s, d), **LIMITS).select("sample", "camera", F.round("distance", 6).alias("distance"), F.round("incidence", 5).alias("incidence")),
    "d19_update_coverage": updated,
    "d33_barycentric": lambda s, d: points(s, d).select("id", bary_().alias("b")).select("id", *[F.round(f"b.{c}", 9).alias(c) for c in "abc"]),
    "f43_first_clear_offset": offsets,
    "j13_materialize": lambda s, d: M.materialize(t(s, d, "nation").select(F.col("n_nationkey").alias("id")), t(s, d, "region").select((-1 - F.col("r_regionkey")).alias("id")), "id"),
    "k_quaternion_round_trip": lambda s, d: points(s, d).select("id", F.round(turn_()[1][0], 6).alias("sine")),
}


def bary_():
    from sightline.operators.spatial import barycentric

    return barycentric(V.vec(F.col("x"), F.col("y"), F.lit(0.0)), V.vec(0, 0, 0), V.vec(10, 0, 0), V.vec(0, 16, 0))


def turn_():
    a = F.col("id") / 50.0
    m = [[F.cos(a), -F.sin(a), F.lit(0.0)], [F.sin(a), F.cos(a), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.0)]]
    return V.rotation(V.quaternion(m))


SQL = {
    "a3_triangles": "select n_nationkey as object, k::int as tri, (n_nationkey % 5 + 1)::double as area, 1.0::double as nz from nation, range(1, 3) r(k)",
    "c18_accepted_views": f"select sample, camera, round(distance, 6) as distance, round(incidence, 5) as incidence from {VIEWS}",
    "d19_update_coverage": f"with n as (select sample, count(*) as n from {VIEWS} group by 1) select id, coalesce(n, 0) as views, round(least(1.0::double, coalesce(n, 0) / 3.0::double), 9) as score, 'delta' as how from {POINTS} p left join n on n.sample = p.id",
    "d33_barycentric": f"select id, round(1 - x / 10 - y / 16, 9) as a, round(x / 10, 9) as b, round(y / 16, 9) as c from {POINTS}",
    "f43_first_clear_offset": f"with p as (select distinct id // 8 as line, x, y from {POINTS}), b as (select x, y from {POINTS} where z > 4.8), o(attempt, dx, dy) as (select k::int, 0.0::double, (case when k % 2 = 0 then 1 else -1 end) * (k // 2 + 1) * 0.15::double from range(8) r(k)), hit as (select distinct line, attempt from p, o, b where (p.x + dx - b.x) ** 2 + (p.y + dy - b.y) ** 2 <= 0.2::double * 0.2::double) select line, (select min(attempt) from o where not exists (select 1 from hit h where h.line = l.line and h.attempt = o.attempt)) as attempt from (select distinct line from p) l",
    "j13_materialize": "select -1 - r_regionkey as old, (select max(n_nationkey) from nation) + row_number() over (order by r_regionkey) as new from region",
    "k_quaternion_round_trip": "select p_partkey as id, round(sin(p_partkey / 50.0::double), 6) as sine from part",
}
