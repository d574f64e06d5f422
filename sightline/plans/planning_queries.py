"""Planning queries over part as a walkable raster: 40 cells a row, small sizes are obstacles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import graph as G
from sightline.operators import planning as P
from sightline.plans.coverage_queries import t
from sightline.plans.graph_queries import CELLS, COMP4, E4, cells, edges4
from sightline.plans.space_queries import POINTS, points

LIMITS = P.Limits(grid=1.0, least_area=4.0, room_area=6.0, room_width=2.0, cover_radius=0.5, lane_gap=1.1, stitch_distance=2.5, stitch_degrees=95.0)


def spaces(s, d):
    """Blocks of 8 x 5 cells as regions, with a clearance and doorways."""
    c = cells(s, d)
    return c.withColumn("region", F.floor(F.col("ix") / 8) + 5 * F.floor(F.col("iy") / 5)).withColumn("clearance", F.col("size") / 40.0).withColumn("doorway", F.col("size") % 9 == 0)


def lanes_of(s, d):
    return points(s, d).select(F.floor(F.col("id") / 6).alias("line"), "id", "x", (F.col("y") + F.col("id") % 3 / 8.0).alias("y"))


def segments(s, d):
    return P.line_segments(lanes_of(s, d), key="line", order="id")


def terraces(s, d):
    """Two floors, at 0 and 2.4, with a slope between them in three of every five rows: 0.15 a cell in even bands, 0.3 in odd ones."""
    p = t(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 40).alias("ix"), F.floor(F.col("p_partkey") / 40).alias("iy"))
    odd = F.floor(F.col("iy") / 5) % 2 == 1
    steps = F.when(odd, 8).otherwise(16)
    at = F.col("ix") - 9
    z = F.when(F.col("ix") <= 9, 0.0).when(at >= steps, 2.4).otherwise(at * F.when(odd, 0.3).otherwise(0.15))
    slope = (F.col("ix") > 9) & (at < steps)
    return p.withColumn("z", F.round(z, 6)).where(~slope | (F.col("iy") % 5).between(1, 3)).withColumns({"x": F.col("ix").cast("double"), "y": F.col("iy").cast("double")})


def level_parts(s, d):
    c = terraces(s, d)
    e = G.grid_edges(c, offsets=((1, 0), (0, 1)), max_rise=0.38)
    level = G.components_of(c, G.flat_edges(e, c, 0.1)).where("size >= 4")
    m = level.select(F.col("node").alias("id"), F.col("root").alias("region"))
    r = m.join(c, "id").groupBy("region").agg(F.avg("z").alias("mean_z"), F.count(F.lit(1)).cast("double").alias("area"))
    return c, e, m, r


def joined(s, d):
    c, e, m, r = level_parts(s, d)
    return P.connectors(c, e, m, r, LIMITS)


def reached(s, d):
    c, e, m, r = level_parts(s, d)
    found, _ = P.connectors(c, e, m, r, LIMITS)
    return P.reachable_regions(e, m, found, c.groupBy().agg(F.min("id").alias("node")))


def plan(s, d):
    return P.walkable_plan(terraces(s, d).select("id", "ix", "iy", "x", "y", "z"), LIMITS)["stats"]


def hill(s, d):
    return points(s, d).select(F.col("id"), (F.col("id") % 40).alias("ix"), F.floor(F.col("id") / 40).alias("iy"), F.col("z").alias("value"))


QUERIES = {
    "c10_region_classes": lambda s, d: P.classify_regions(spaces(s, d), region="region", pitch=1.0, near=0.6).select("region", "cells", F.round("p10", 9).alias("p10"), F.round("p50", 9).alias("p50"), F.round("width", 9).alias("width"), "safe", "doorways", F.round("occupancy", 9).alias("occupancy"), "near_field"),
    "c11_preferred_direction": lambda s, d: P.preferred_direction(spaces(s, d), region="region").select("id", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy")),
    "c12_space_kinds": lambda s, d: P.space_kinds(spaces(s, d), space="region", limits=LIMITS),
    "c23_corridor_axes": lambda s, d: P.corridor_axes(points(s, d).select("id", F.col("z").alias("width_x"), (F.col("id") % 11 / 3.0).alias("width_y")), corridor=1.5),
    "e21_covered_cells": lambda s, d: P.covered_cells(points(s, d), segments(s, d), radius=0.3).select("id").distinct(),
    "e22_lane_cells": lambda s, d: P.covered_cells(points(s, d).withColumn("storey", F.col("id") % 2), segments(s, d).withColumn("storey", F.col("line") % 2), radius=0.4, by=["storey"]).groupBy("line").agg(F.count(F.lit(1)).alias("n")),
    "e23_within_walk": lambda s, d: P.covered_within(edges4(s, d), cells(s, d).where("size = 50").select(F.col("id").alias("node")), 3.0).select("node", F.round("distance", 6).alias("distance")),
    "f7_resampled": lambda s, d: P.resampled(lanes_of(s, d), key="line", order="id", spacing=0.4).groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("x"), 6).alias("reach")),
    "f20_cross_lanes": lambda s, d: P.contiguous_lanes(cells(s, d), stride=3, budget=12),
    "f21_typed_runs": lambda s, d: P.typed_runs(cells(s, d).select("iy", "ix", F.when(F.col("size") > 30, "wide").otherwise("narrow").alias("kind")), lane="iy", at="ix", kind="kind").drop("run"),
    "f24_oriented_runs": lambda s, d: P.typed_runs(cells(s, d).select((F.col("ix") + F.col("iy")).alias("lane"), "ix", F.lit(1).alias("kind")), lane="lane", at="ix", kind="kind").select("lane", "first", "last", "cells"),
    "f25_split_valid": lambda s, d: P.split_valid(lanes_of(s, d), key="line", order="id", vertex=F.col("id") % 7 != 0, edge=F.col("id") % 11 != 0).groupBy("line", "part").agg(F.min("id").alias("first"), F.max("id").alias("last")).select("line", "first", "last"),
    "f27_guarded_smoothing": lambda s, d: P.smoothed(lanes_of(s, d), points(s, d).where("z > 4.7").select((F.col("x") + 0.13).alias("x"), (F.col("y") + 0.11).alias("y")), key="line", order="id", iterations=2, reach=0.1).groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.max("passes").alias("passes")),
    "f39_anchors": lambda s, d: P.anchors(lanes_of(s, d).withColumnRenamed("id", "ord"), points(s, d), key="line", order="ord", reach=0.6),
    "f42_repaired_runs": lambda s, d: P.repaired_runs(lanes_of(s, d), points(s, d).where("z > 4.8"), key="line", order="id", reach=0.15).groupBy("line", "part").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).select("line", "first", "last"),
    "f44_first_clear_height": lambda s, d: P.first_clear_height(points(s, d).withColumn("line", F.floor(F.col("id") / 4)), points(s, d).where("id % 5 = 1").withColumn("z", F.col("z") + 0.1), [0.0, 0.25, -0.25, 0.5], key="line", reach=0.3),
    "g10_edge_distance": lambda s, d: P.edge_distance(cells(s, d), edges4(s, d).withColumn("cost", F.lit(1.0)), 1.0),
    "g17_connectors": lambda s, d: joined(s, d)[0].select("kind", F.size("regions").alias("regions"), F.round("rise", 6).alias("rise"), F.round("run", 6).alias("run"), "cells"),
    "g19_reachable_regions": reached,
    "g20_structural_supports": lambda s, d: P.structural_supports(terraces(s, d), G.grid_edges(terraces(s, d), offsets=((1, 0), (0, 1)), max_rise=0.38), step=1.0, least_area=9.0),
    "g21_component_at": lambda s, d: P.component_at(cells(s, d), edges4(s, d), (20.2, 1.1, 0.2)),
    "g26_isolines": lambda s, d: P.isolines(hill(s, d), 2.53).groupBy().agg(F.count(F.lit(1)).alias("points"), F.countDistinct("line").alias("lines")),
    "g26_contour_segments": lambda s, d: P.contour_segments(hill(s, d), 2.53).groupBy(F.floor(F.least("ay", "by_")).alias("row")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by_"))), 6).alias("length")),
    "g27_stitched": lambda s, d: P.stitched(lanes_of(s, d).withColumn("area", F.floor(F.col("line") / 40)), group="area", key="line", order="id", distance=0.6, degrees=65.0).groupBy("area").agg(F.countDistinct("line").alias("lines"), F.count(F.lit(1)).alias("points")),
    "g29_nearest_component": lambda s, d: P.component_at(cells(s, d), edges4(s, d), (5.2, 3.1), ("x", "y")),
    "g34_walkable_plan": plan,
    "h21_covering_lanes": lambda s, d: P.cover_by_lanes(spaces(s, d), P.row_lanes(spaces(s, d), region="region", grid=1.0), region="region", lane="lane", radius=0.75, target=0.9).groupBy("region").agg(F.count(F.lit(1)).alias("lanes"), F.sum("gain").alias("cells")),
    "h20_room_lanes": lambda s, d: P.cover_by_lanes(spaces(s, d), P.row_lanes(spaces(s, d), region="region", grid=1.0), region="region", lane="lane", radius=1.1, target=0.5, least=2).groupBy("region").agg(F.count(F.lit(1)).alias("lanes"), F.sum("gain").alias("cells")),
    "h24_row_lanes": lambda s, d: P.row_lanes(spaces(s, d), region="region", grid=1.0).select("region", F.col("lane").cast("long").alias("lane"), "ax", "bx", "ay", "cells", F.col("edge_rank").cast("long").alias("edge_rank")),
    "h25_even_lanes": lambda s, d: P.evenly_spaced_lanes(spaces(s, d), region="region", count=3),
}

_REG = f"(select *, ix::double as x, iy::double as y, ix // 8 + 5 * (iy // 5) as region, size / 40.0::double as clearance, size % 9 = 0 as doorway from {CELLS})"
_LINE = f"(select id // 6 as line, id, x, y + id % 3 / 8.0::double as y from {POINTS})"
_SEG = f"(select line, ax, ay, bx, by_, (bx - ax) as dx, (by_ - ay) as dy from (select line, x as ax, y as ay, lead(x) over w as bx, lead(y) over w as by_ from {_LINE} window w as (partition by line order by id)) where bx is not null)"
_D = "sqrt((p.x - (ax + k * dx)) ** 2 + (p.y - (ay + k * dy)) ** 2)"
_K = "(select p.id, p.x, p.y, p.z, s.line, s.ax, s.ay, s.bx, s.by_, s.dx, s.dy, case when dx * dx + dy * dy > 1e-12 then least(greatest(((p.x - ax) * dx + (p.y - ay) * dy) / (dx * dx + dy * dy), 0), 1) else 0 end as k from {p} p, {s} s {w})"
_NEAR = f"(select * from {_K.format(p=POINTS, s=_SEG, w='where p.x between least(ax, bx) - 0.5 and greatest(ax, bx) + 0.5 and p.y between least(ay, by_) - 0.5 and greatest(ay, by_) + 0.5')} p)"
SQL = {
    "c10_region_classes": f"select region, count(*) as cells, round(quantile_cont(clearance, 0.1), 9) as p10, round(quantile_cont(clearance, 0.5), 9) as p50, round(greatest(1.0, 2 * quantile_cont(clearance, 0.1)), 9) as width, count(*) filter (where clearance >= 0.2) as safe, count(*) filter (where doorway) as doorways, round(least(greatest(1 - count(*) / ((max(ix) - min(ix) + 1) * (max(iy) - min(iy) + 1))::double, 0), 1), 9) as occupancy, quantile_cont(clearance, 0.5) < 0.6 or greatest(1.0, 2 * quantile_cont(clearance, 0.1)) < 1.2 as near_field from {_REG} group by 1",
    "c11_preferred_direction": f"with r as {_REG}, c as (select region, avg(x) as cx, avg(y) as cy from r group by 1), v as (select r.id, r.doorway, cx - x as vx, cy - y as vy, (select coalesce(sum(case when q.iy = r.iy then q.clearance else 0 end), 0) from r q where abs(q.ix - r.ix) + abs(q.iy - r.iy) = 1) as sx, (select coalesce(sum(case when q.ix = r.ix then q.clearance else 0 end), 0) from r q where abs(q.ix - r.ix) + abs(q.iy - r.iy) = 1) as sy from r join c using (region)) select id, round(case when doorway then case when sx >= sy then 1.0 else 0 end when sqrt(vx * vx + vy * vy) > 1e-6 then vx / sqrt(vx * vx + vy * vy) else 1 end, 6) as dx, round(case when doorway then case when sx >= sy then 0.0 else 1 end when sqrt(vx * vx + vy * vy) > 1e-6 then vy / sqrt(vx * vx + vy * vy) else 0 end, 6) as dy from v",
    "c12_space_kinds": f"select region, count(*)::double as area, case when count(*) >= 6 and least(max(x) - min(x), max(y) - min(y)) + 1 >= 2 then 'ROOM' else 'CORRIDOR' end as kind from {_REG} group by 1",
    "c23_corridor_axes": f"select id, x as narrow_x, y as narrow_y, not x or y as allow_x, not y or x as allow_y from (select id, z <= 1.5 as x, id % 11 / 3.0::double <= 1.5 as y from {POINTS})",
    "e21_covered_cells": f"select distinct id from {_NEAR} p where {_D} <= 0.3 + 1e-9",
    "e22_lane_cells": f"select line, count(distinct id) as n from {_NEAR} p where id % 2 = line % 2 and {_D} <= 0.4 + 1e-9 group by 1",
    "e23_within_walk": f"with recursive e as materialized (select * from {E4}), r(node, d, hops) as (select id, 0.0::double, 0 from {CELLS} where size = 50 union select e.dst, r.d + e.cost, r.hops + 1 from r join e on e.src = r.node where r.d + e.cost <= 3 + 1e-9) select node, round(min(d), 6) as distance from r group by 1",
    "f20_cross_lanes": f"with r as (select 'x' as axis, iy as lane, ix as pos from {CELLS} where iy % 3 = 0 union all select 'y', ix, iy from {CELLS} where ix % 3 = 0), g as (select axis, lane, count(*) as cells, min(pos) as \"first\", max(pos) as \"last\" from (select *, pos - row_number() over (partition by axis, lane order by pos) as run from r) group by axis, lane, run having count(*) >= 2), k as (select *, row_number() over (partition by axis order by cells desc, lane, \"first\") as turn from g) select axis, lane, \"first\", \"last\", cells, rank::int as rank from (select *, row_number() over (order by turn, axis) as rank from k where turn <= 12) where rank <= 12",
    "f21_typed_runs": f"with c as (select iy, ix, case when size > 30 then 'wide' else 'narrow' end as kind from {CELLS}), n as (select *, case when ix - lag(ix) over w = 1 and kind = lag(kind) over w then 0 else 1 end as new from c window w as (partition by iy order by ix)), r as (select *, sum(new) over (partition by iy order by ix) as run from n) select iy, min(ix) as first, max(ix) as last, count(*) as cells, min(kind) as kind from r group by iy, run",
    "f24_oriented_runs": f"select lane, min(ix) as first, max(ix) as last, count(*) as cells from (select ix + iy as lane, ix, ix - row_number() over (partition by ix + iy order by ix) as run from {CELLS}) group by lane, run",
    "f25_split_valid": f"with p as (select line, id, id % 7 <> 0 as v, id % 11 <> 0 as e, lag(id % 7 <> 0) over (partition by line order by id) as pv from {_LINE}), r as (select *, sum(case when v and e and coalesce(pv, false) then 0 else 1 end) over (partition by line order by id) as part from p) select line, min(id) as first, max(id) as last from r where v group by line, part having count(*) > 1",
    "f39_anchors": f"with n as (select l.line, l.id as ord, arg_min(p.id, (round((l.x - p.x) ** 2 + (l.y - p.y) ** 2, 12), p.id)) as id from {_LINE} l, {POINTS} p where p.x between l.x - 0.6 and l.x + 0.6 and p.y between l.y - 0.6 and l.y + 0.6 and (l.x - p.x) ** 2 + (l.y - p.y) ** 2 <= 0.36 group by 1, 2) select line, id, min(ord) as ord from n group by 1, 2",
    "f42_repaired_runs": f"with h as (select l.line, l.id, exists (select 1 from {POINTS} p where p.z > 4.8 and (l.x - p.x) ** 2 + (l.y - p.y) ** 2 <= 0.15::double * 0.15::double) as hit from {_LINE} l), b as (select *, bool_or(hit) over (partition by line order by id rows between 1 preceding and 1 following) as bad from h), r as (select *, sum(case when not bad and coalesce(not lag_, false) then 0 else 1 end) over (partition by line order by id) as part from (select *, lag(bad) over (partition by line order by id) as lag_ from b)) select line, min(id) as first, max(id) as last from r where not bad group by line, part having count(*) > 1",
    "f44_first_clear_height": f"with q as (select id // 4 as line, i, h, x, y, z + h as z from {POINTS}, (values (0, 0.0::double), (1, 0.25), (2, -0.25), (3, 0.5)) v(i, h)), hit as (select distinct q.line, q.i from q, {POINTS} b where b.id % 5 = 1 and (q.x - b.x) ** 2 + (q.y - b.y) ** 2 + (q.z - b.z - 0.1) ** 2 <= 0.3::double * 0.3::double) select line, (select arg_min(h, i) from (values (0, 0.0::double), (1, 0.25), (2, -0.25), (3, 0.5)) v(i, h) where not exists (select 1 from hit where hit.line = l.line and hit.i = v.i)) as height from (select distinct id // 4 as line from {POINTS}) l",
    "g10_edge_distance": f"with recursive e as materialized (select src, dst from {E4}), rim as (select id from {CELLS} where (select count(*) from e where src = id) < 4), r(node, hops) as (select id, 0 from rim union select e.dst, r.hops + 1 from r join e on e.src = r.node where r.hops < 30) select node, min(hops) + 1.0::double as distance from r group by 1",
    "g21_component_at": f"with k as {COMP4} select node as id from k where root = (select root from k where node = (select arg_min(id, (round((ix - 20.2::double) ** 2 + (iy - 1.1::double) ** 2 + (z - 0.2::double) ** 2, 12), id)) from {CELLS}))",
    "g29_nearest_component": f"with k as {COMP4} select node as id from k where root = (select root from k where node = (select arg_min(id, (round((ix - 5.2::double) ** 2 + (iy - 3.1::double) ** 2, 12), id)) from {CELLS}))",
    "h24_row_lanes": f"with r as (select region, iy, count(*) as cells, min(ix)::double as ax, max(ix)::double as bx, iy::double as ay from (select *, ix - row_number() over (partition by region, iy order by ix) as run from {_REG}) group by region, iy, run having count(*) >= 2), n as (select *, row_number() over (partition by region order by iy, ax) as lane, count(*) over (partition by region) as n from r) select region, lane, ax, bx, ay, cells, -least(lane - 1, n - lane) as edge_rank from n",
    "h25_even_lanes": f"with r as (select region, iy as lane, count(*) as cells from {_REG} group by 1, 2 having count(*) >= 2), k as (select *, row_number() over (partition by region order by lane) - 1 as k, count(*) over (partition by region) as n from r) select region, lane, cells from k where n <= 3 or k in (0, round((n - 1) / 2.0), n - 1)",
}
