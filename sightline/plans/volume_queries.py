"""Volume queries: a box of each nation as solids, part as points, and a room of boxes to scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import vectors as V
from sightline.operators import volumes as W
from sightline.plans.coverage_queries import t
from sightline.plans.space_queries import POINTS, points

SIX = [(1.0, 0.0, 0.0), (-1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, -1.0, 0.0), (0.0, 0.0, 1.0), (0.0, 0.0, -1.0)]


def solids(s, d):
    """One box a nation: 1 x 0.8 x 3 at steps of 2 and 1.5."""
    k = F.col("n_nationkey")
    low = V.vec(k % 5 * 2 + 0.113, F.floor(k / 5) * 1.5 + 0.137, F.lit(0.513))
    rows = t(s, d, "nation").select(k.alias("k"), F.posexplode(W.wall(k, low, V.add(low, V.vec(1.0, 0.8, 3.0)))).alias("i", "w"))
    return rows.select((F.col("k") * 12 + F.col("i")).alias("tri"), "w.owner", "w.a", "w.b", "w.c")


def room(s):
    """Triangles of a hollow room, 10 x 6 x 3, with a floor, a ceiling and four walls, and a table of 2 x 2 x 0.8 in it."""
    one = s.range(1)
    box = lambda name, lo, hi: W.wall(F.lit(name), V.vec(*lo), V.vec(*hi))
    parts = [("floor", (-0.5, -0.5, -0.2), (10.5, 6.5, 0.0)), ("roof", (-0.5, -0.5, 3.0), (10.5, 6.5, 3.2)), ("west", (-0.5, -0.5, 0.0), (0.0, 6.5, 3.0)), ("east", (10.0, -0.5, 0.0), (10.5, 6.5, 3.0)), ("south", (-0.5, -0.5, 0.0), (10.5, 0.0, 3.0)), ("north", (-0.5, 6.0, 0.0), (10.5, 6.5, 3.0)), ("table", (4.013, 2.017, 0.0), (6.013, 4.017, 0.8))]
    return one.select(F.posexplode(F.concat(*[box(*p) for p in parts])).alias("tri", "w")).select("tri", "w.owner", "w.a", "w.b", "w.c")


ROOM = {"low_x": 0.25, "low_y": 0.25, "low_z": 0.0, "high_x": 9.75, "high_y": 5.75, "high_z": 2.5}


def spots(s, d):
    return points(s, d).select("id", V.vec(F.col("x"), F.col("y"), F.col("z")).alias("p"))


def in_room(s, d):
    p = points(s, d).where("x < 9.9 and y < 5.9 and z < 2.9")
    return p.select("id", V.vec(F.col("x") + 0.031, F.col("y") + 0.043, F.col("z") + 0.017).alias("p"))


def strips(s, d):
    p = F.struct("x", "y", "z")
    return points(s, d).select("id", V.vec(p["x"], p["y"], p["z"]).alias("a"), V.vec(p["x"] + 0.6, p["y"] + 0.2, p["z"]).alias("b"))


def scene(s):
    return W.free_space(s, room(s), ROOM, step=0.5, cell=1.0, headroom=1.8, clearance=0.3, reach=1.0, directions=W.level_directions())


def supported(s):
    return W.supports(W.columns(s, ROOM, 0.5), room(s), low=-0.1, high=2.5, cell=1.0)


QUERIES = {
    "a6_planning_settings": lambda s, d: s.createDataFrame([tuple(W.planning_settings(W.checked_bounds(points(s, d)), q).values()) for q in ("FAST", "HIGH", "?")], "diagonal double, cell double, rays int").select(F.round("diagonal", 9).alias("diagonal"), F.round("cell", 9).alias("cell"), "rays"),
    "a7_free_space": lambda s, d: scene(s).select("ix", "iy", "component", F.round("z", 6).alias("z")),
    "a8_grid_pitch": lambda s, d: s.createDataFrame([(round(W.grid_pitch(W.checked_bounds(points(s, d)), requested=r, most_cells=n), 9),) for r, n in ((0.35, 200_000), (0.01, 1000), (0.1, 1000))], "pitch double"),
    "a9_bounds": lambda s, d: W.bounds(points(s, d).withColumn("layer", F.col("id") % 4), ["layer"]),
    "a10_supports": lambda s, d: supported(s).select("ix", "iy", F.round("z", 6).alias("z")),
    "c6_inside_solid": lambda s, d: W.inside_solid(spots(s, d), solids(s, d), W.VOTES, cell=1.0, reach=4.0),
    "c7_clear_points": lambda s, d: W.clear(spots(s, d), solids(s, d), cell=1.0, reach=4.0, clearance=0.25).select("id"),
    "c15_contains": lambda s, d: W.contains(spots(s, d), solids(s, d), cell=1.0, reach=4.0),
    "c16_segments_inside": lambda s, d: W.segments_inside(strips(s, d), solids(s, d), cell=1.0, reach=4.0),
    "c45_free_width": lambda s, d: W.free_width(in_room(s, d), room(s), "x", cell=1.0, limit=8.0).select("id", F.round("width", 6).alias("width"), F.round("centre", 6).alias("centre")),
    "c46_collides": lambda s, d: W.collides(spots(s, d), solids(s, d), cell=1.0, reach=4.0, radius=0.2),
    "d5_points_clear": lambda s, d: W.points_clear(in_room(s, d), room(s), cell=1.0, reach=4.0, clearance=0.2, directions=SIX),
    "d6_segments_clear": lambda s, d: W.segments_clear(strips(s, d), solids(s, d), cell=1.0, reach=2.0, radius=0.05).groupBy("clear").agg(F.count(F.lit(1)).alias("n")),
    "d28_nearest_surface": lambda s, d: W.nearest_surface(in_room(s, d), room(s), SIX, cell=1.0, search=3.0).select("id", F.round("nearest", 6).alias("nearest"), "open"),
    "e34_vertical_limits": lambda s, d: W.vertical_limits(in_room(s, d), room(s), cell=1.0, reach=4.0).select("id", F.round("floor", 6).alias("floor"), F.round("ceiling", 6).alias("ceiling")),
    "h40_pushed_cameras": lambda s, d: W.pushed_out(in_room(s, d), room(s), cell=1.0, clearance=0.4, search=2.0).select("id", "pushes", (F.col("nearest") >= 0.4 - 1e-9).alias("clear")),
}

_BOX = "(select n_nationkey as owner, n_nationkey % 5 * 2 + 0.113::double as x0, n_nationkey // 5 * 1.5::double + 0.137::double as y0, 0.513::double as z0, n_nationkey % 5 * 2 + 1.113::double as x1, n_nationkey // 5 * 1.5::double + 0.937::double as y1, 3.513::double as z1 from nation)"
_IN = "p.x between x0 and x1 and p.y between y0 and y1 and p.z between z0 and z1"
_INSIDE = f"select id, owner from {POINTS} p, {_BOX} where {_IN}"
_OUT = "greatest(x0 - p.x, 0, p.x - x1) ** 2 + greatest(y0 - p.y, 0, p.y - y1) ** 2 + greatest(z0 - p.z, 0, p.z - z1) ** 2"
_SPOT = f"(select id, x + 0.031::double as x, y + 0.043::double as y, z + 0.017::double as z from {POINTS} where x < 9.9 and y < 5.9 and z < 2.9)"
#: the table's box, seen from a point in the room
_UNDER = "(x > 4.013 and x < 6.013 and y > 2.017 and y < 4.017)"
_LAID = "(x > 4.013 and x < 6.013 and y > 2.017 and y < 4.017 and z < 0.8)"
SQL = {
    "a6_planning_settings": f"with b as (select sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2) as dg from {POINTS}) select round(dg, 9) as diagonal, round(least(greatest(dg / 300, 0.03::double), 0.15), 9) as cell, rays::int as rays from b, (values (8), (16), (12)) v(rays)",
    "a8_grid_pitch": f"with b as (select greatest(0.01, max(x) - min(x)) * greatest(0.01, max(y) - min(y)) as a from {POINTS}) select round(least(greatest(greatest(least(greatest(r, 0.1), 1.0), sqrt(a / n)), 0.1), 2.0), 9) as pitch from b, (values (0.35::double, 200000), (0.01, 1000), (0.1, 1000)) v(r, n)",
    "a9_bounds": f"select id % 4 as layer, min(x) as low_x, min(y) as low_y, min(z) as low_z, max(x) as high_x, max(y) as high_y, max(z) as high_z from {POINTS} group by 1",
    "a10_supports": "with c as (select ix, iy, 0.25 + ix * 0.5::double as x, 0.25 + iy * 0.5::double as y from range(20) a(ix), range(12) b(iy)) select ix, iy, 0.0::double as z from c union all select ix, iy, 0.8 from c where x > 4.013 and x < 6.013 and y > 2.017 and y < 4.017",
    "c6_inside_solid": _INSIDE,
    "c15_contains": _INSIDE,
    "c7_clear_points": f"select id from {POINTS} q where not exists (select 1 from {_BOX} b, (select q.x as x, q.y as y, q.z as z) p where {_OUT} < 0.0625 - 1e-9)",
    "c46_collides": f"select distinct id from {POINTS} p, {_BOX} where {_OUT} < 0.04 - 1e-9",
    "c16_segments_inside": f"select id, owner, {_IN} and {_IN.replace('p.x', '(p.x + 0.6)').replace('p.y', '(p.y + 0.2)')} as inside from {POINTS} p, {_BOX} where p.z between z0 and z1 and greatest(0, (x0 - p.x) / 0.6, (y0 - p.y) / 0.2) < least(1, (x1 - p.x) / 0.6, (y1 - p.y) / 0.2)",
    "c45_free_width": f"select id, round(case when w <= 8 and e <= 8 then w + e else 16 end, 6) as width, round(case when w <= 8 and e <= 8 then x + (e - w) / 2 else x end, 6) as centre from (select *, case when y > 2.017 and y < 4.017 and z < 0.8 and x > 6.013 then x - 6.013 when {_LAID} then x - 4.013 else x end as w, case when y > 2.017 and y < 4.017 and z < 0.8 and x < 4.013 then 4.013 - x when {_LAID} then 6.013 - x else 10 - x end as e from {_SPOT})",
    "e34_vertical_limits": f"select id, round(case when {_UNDER} and z > 0.8 then 0.8 else 0 end, 6)::double as floor, round(case when {_UNDER} and z < 0.8 then 0.8 else 3 end, 6)::double as ceiling from {_SPOT}",
}
