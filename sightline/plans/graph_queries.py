"""Graph and selection queries over part as a grid (p_partkey mod 40, div 40; small sizes are walls) and lineitem as observations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators import graph as G
from sightline.operators import select as H
from sightline.plans.coverage_queries import EDGES, OBS, obs, supplier_edges, t
from sightline.session import cut

FOUR = ((1, 0), (0, 1))


def cells(s, d) -> DataFrame:
    p = t(s, d, "part").where("p_size > 14")
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 40).alias("ix"), F.floor(F.col("p_partkey") / 40).alias("iy"), F.col("p_size").alias("size")).select("*", F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"), (F.col("size") % 5 / 10.0).alias("z"))


CELLS = "(select p_partkey as id, p_partkey % 40 as ix, p_partkey // 40 as iy, p_size as size, p_size % 5 / 10.0::double as z from part where p_size > 14)"


def edges4(s, d) -> DataFrame:
    return G.grid_edges(cells(s, d), max_rise=0.36, offsets=FOUR)


E4 = f"(select a.id as src, b.id as dst, sqrt(1 + (a.z - b.z) * (a.z - b.z)) as cost from {CELLS} a join {CELLS} b on abs(a.ix - b.ix) + abs(a.iy - b.iy) = 1 and abs(a.z - b.z) <= 0.36 + 1e-9)"


def wide(s, d) -> DataFrame:
    """All ten offsets, so that routes take few steps."""
    return cut(G.grid_edges(cells(s, d), max_rise=0.36))


WIDE = f"(select a.id as src, b.id as dst from {CELLS} a join {CELLS} b on abs(a.ix - b.ix) <= 2 and abs(a.iy - b.iy) <= 2 and a.id <> b.id and abs(a.z - b.z) <= 0.36 + 1e-9 and (a.ix - b.ix) ** 2 + (a.iy - b.iy) ** 2 <= 2.3 * 2.3 + 1e-9)"


def seeds(s, d) -> DataFrame:
    return G.components_of(cells(s, d), edges4(s, d)).where("component = 1").select(F.col("root").alias("node")).distinct()


COMP = "(with recursive e as materialized (select src, dst from {e}), n as (select id from {c}), r(node, root) as (select id, id from n union select e.dst, r.root from r join e on e.src = r.node where e.dst > r.root) select node, min(root) as root from r group by 1)"
COMP4 = COMP.format(e=E4, c=CELLS)
REACH = f"(with recursive e as materialized (select * from {E4}), r(node) as (select root from (select root, count(*) as n from {COMP4} group by 1 order by n desc, root limit 1) union select e.dst from r join e on e.src = r.node) select node from r)"
FLAT = f"(select e.* from {E4} e join {CELLS} a on a.id = e.src join {CELLS} b on b.id = e.dst where abs(a.z - b.z) <= 0.1 + 1e-9)"


def flat_regions(s, d):
    return G.regions(cells(s, d), edges4(s, d), tolerance=0.1, least_cells=4)


def uncovered(s, d):
    c = cells(s, d)
    return G.uncovered(c, edges4(s, d), c.where("size > 30"), 3)


def labelled(s, d):
    c = cells(s, d)
    return G.crossing_counts(edges4(s, d), c.select("id", (F.floor(F.col("ix") / 10) * 10 + F.floor(F.col("iy") / 10)).alias("label")))


def gains(s, d):
    o = obs(s, d)
    cov = o.where("candidate % 10 = 0").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.collect_set("bin").alias("bins"))
    return H.marginal_gain(o.where("candidate % 10 <> 0"), cov, candidate="candidate", cell="cell", bin="bin")


def cover(s, d, **k):
    return H.greedy_cover(obs(s, d), candidate="candidate", cell="cell", budget=6, **k)


def repaired(s, d):
    ids, n = H.swap_repair(obs(s, d), list(range(1, 7)), candidate="candidate", cell="cell")
    return s.createDataFrame([(c, n) for c in ids], "candidate long, covered long")


def far_route(s, d):
    f = G.shortest(wide(s, d), seeds(s, d))
    end = f.agg(F.max(F.struct(F.round("distance", 6).alias("q"), "node")).alias("m")).first().m.node
    return s.createDataFrame(list(enumerate(G.route(f, end))), "place int, node long")


QUERIES = {
    "d7_grid_graph": lambda s, d: G.grid_edges(cells(s, d)).withColumn("cost", F.round("cost", 9)),
    "d8_four_neighbours": lambda s, d: edges4(s, d).withColumn("cost", F.round("cost", 9)),
    "g1_components": lambda s, d: G.components_of(cells(s, d), edges4(s, d)).select("node", "root", "size"),
    "g2_component_order": lambda s, d: G.components_of(cells(s, d), edges4(s, d)).select("component", "root", "size").distinct(),
    "g4_candidate_components": lambda s, d: G.components(supplier_edges(s, d).where("ratio >= 0.02").select(F.col("a").alias("u"), F.col("b").alias("v"))),
    "g5_cluster_minima": lambda s, d: G.cluster_minima(cells(s, d), edges4(s, d), ["size"]),
    "g6_reachable": lambda s, d: G.reachable_set(edges4(s, d), seeds(s, d)),
    "g7_reachable_union": lambda s, d: G.reachable(wide(s, d), cells(s, d).where("id % 400 = 7").select(F.col("id").alias("node"))),
    "g8_induced_subgraph": lambda s, d: G.restrict(edges4(s, d), cells(s, d).where("size > 25")).select("src", "dst"),
    "g9_boundary_distance": lambda s, d: G.boundary_distance(cells(s, d), edges4(s, d), 4).select("node", F.round("distance", 6).alias("distance")),
    "g11_shortest": lambda s, d: G.shortest(wide(s, d), seeds(s, d)).select("node", F.round("distance", 6).alias("distance")),
    "g12_route": far_route,
    "g13_diameter": lambda s, d: s.createDataFrame([(round(G.diameter(wide(s, d), seeds(s, d).first()[0])[2], 6),)], "length double"),
    "g14_weighted_graph": lambda s, d: G.weighted(edges4(s, d), cells(s, d), "size", 50.0).withColumn("cost", F.round("cost", 9)),
    "g15_flat_graph": lambda s, d: G.flat_edges(edges4(s, d), cells(s, d), 0.1).select("src", "dst"),
    "g16_floor_regions": flat_regions,
    "g18_interface_counts": labelled,
    "g18_label_growth": lambda s, d: G.grow_labels(wide(s, d), cells(s, d).where("id % 300 = 11").select(F.col("id").alias("node"), F.col("id").alias("label"))),
    "g23_uncovered_regions": uncovered,
    "c9_local_structure": lambda s, d: G.local_structure(cells(s, d), edges4(s, d), F.col("size").cast("double")),
    "h1_marginal_gain": gains,
    "h2_best_of_group": lambda s, d: H.best_of_group(t(s, d, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice"), "p_brand", [F.col("p_size"), F.col("p_retailprice"), (-F.col("p_partkey")).alias("k")]),
    "h13_greedy_cover": cover,
    "h15_weighted_cover": lambda s, d: H.greedy_cover(obs(s, d).withColumn("w", F.when(F.col("category") == "A", 4).otherwise(1)), candidate="candidate", cell="cell", budget=4, weight="w"),
    "h16_cover_by_length": lambda s, d: H.greedy_cover(obs(s, d).withColumn("len", 1 + F.col("candidate") % 3), candidate="candidate", cell="cell", budget=4, cost="len", conflict="candidate"),
    "h8_swap_repair": repaired,
    "h26_farthest_points": lambda s, d: H.farthest_points(cells(s, d).withColumn("zone", F.floor(F.col("iy") / 10)), group="zone", id="id", axes=["x", "y"], count=6, spacing=1.5),
    "h26_farthest_points_large": lambda s, d: H.farthest_points_large(cells(s, d), id="id", axes=["x", "y"], count=10),
    "d24_diverse_views": lambda s, d: H.diverse_sequence(cells(s, d).select(F.floor(F.col("iy") / 10).alias("zone"), "id", "x", "y", F.cos(F.col("id") % 5 / 2.0).alias("fx"), F.sin(F.col("id") % 5 / 2.0).alias("fy")), group="zone", order=["id"], axes=["x", "y"], distance=3.0, most=200, forward=["fx", "fy"], degrees=40.0),
    "d24_diverse_sequence": lambda s, d: H.diverse_sequence(cells(s, d).select(F.floor(F.col("iy") / 10).alias("zone"), "id", "x", "y"), group="zone", order=["id"], axes=["x", "y"], distance=3.0, most=20),
    "h39_ring_origins": lambda s, d: H.ring_origins(t(s, d, "nation").select(F.col("n_nationkey").alias("region"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(0.5).alias("z")), radii=[0.75, 1.5], angles=12, heights=[0.0, 0.4]).withColumns({c: F.round(c, 9) for c in "xyz"}),
    "h41_cube_faces": lambda s, d: H.cube_faces(t(s, d, "nation").select("n_nationkey")),
    "h43_sphere_directions": lambda s, d: H.sphere_directions(s, 30).select("id", *[F.round(c, 9).alias(c) for c in "xyz"]),
}
SQL = {
    "d7_grid_graph": f"select a.id as src, b.id as dst, round(sqrt((a.ix - b.ix) ** 2 + (a.iy - b.iy) ** 2 + (a.z - b.z) ** 2), 9) as cost from {CELLS} a join {CELLS} b on abs(a.ix - b.ix) <= 2 and abs(a.iy - b.iy) <= 2 and a.id <> b.id and abs(a.z - b.z) <= 0.36 + 1e-9 and sqrt((a.ix - b.ix) ** 2 + (a.iy - b.iy) ** 2) <= 2.3 + 1e-9",
    "d8_four_neighbours": f"select src, dst, round(cost, 9) as cost from {E4}",
    "g1_components": f"select node, root, count(*) over (partition by root) as size from {COMP4}",
    "g2_component_order": f"select cast(row_number() over (order by size desc, root) as int) as component, root, size from (select root, count(*) as size from {COMP4} group by 1)",
    "g4_candidate_components": "select * from " + COMP.format(e=f"(select a as src, b as dst from {EDGES} where ratio >= 0.02 union all select b, a from {EDGES} where ratio >= 0.02)", c=f"(select a as id from {EDGES} where ratio >= 0.02 union select b from {EDGES} where ratio >= 0.02)"),
    "g5_cluster_minima": f"select root, arg_min(id, (size, id)) as id from {COMP4} c join {CELLS} k on k.id = c.node group by 1",
    "g6_reachable": f"select node from {REACH}",
    "g7_reachable_union": f"with recursive e as materialized (select src, dst from {WIDE}), r(node, hops) as (select id, 0 from {CELLS} where id % 400 = 7 union select e.dst, hops + 1 from r join e on e.src = r.node where hops < 60) select node, min(hops) as hops from r group by 1",
    "g8_induced_subgraph": f"select src, dst from {E4} where src in (select id from {CELLS} where size > 25) and dst in (select id from {CELLS} where size > 25)",
    "g14_weighted_graph": f"select src, dst, round(cost * (1 + 1.5 * greatest(0, 1 - size / 50.0::double)), 9) as cost from {E4} join {CELLS} k on k.id = dst",
    "g15_flat_graph": f"select src, dst from {FLAT}",
    "g16_floor_regions": "select *, cast(row_number() over (order by mean_z, root) as int) as region from (select root, count(*) as cells, round(avg(z), 9) as mean_z from " + COMP.format(e=FLAT, c=CELLS) + f" c join {CELLS} k on k.id = c.node group by 1 having count(*) >= 4)",
    "g18_interface_counts": f"with l as (select id, ix // 10 * 10 + iy // 10 as label from {CELLS}) select least(a.label, b.label) as a, greatest(a.label, b.label) as b, count(*) as links from {E4} e join l a on a.id = src join l b on b.id = dst where src < dst and a.label <> b.label group by 1, 2",
    "g23_uncovered_regions": "select root, count(*) as size from " + COMP.format(e=f"(select e.* from {E4} e join {CELLS} a on a.id = src join {CELLS} b on b.id = dst where a.size <= 30 and b.size <= 30)", c=f"(select * from {CELLS} where size <= 30)") + " group by 1 having count(*) >= 3",
    "c9_local_structure": f"with n as (select src as id, count(*) as n, max(size) as widest from {E4} join {CELLS} k on k.id = dst group by 1) select k.id, coalesce(n, 0) < 4 as boundary, size >= coalesce(widest, 0) and size >= (select median(size) from {CELLS}) as medial from {CELLS} k left join n on n.id = k.id",
    "h1_marginal_gain": f"with c as (select cell, count(*) as n, list(distinct bin) as bins from {OBS} where candidate % 10 = 0 group by 1), o as (select candidate, cell, min(bin) as bin from {OBS} where candidate % 10 <> 0 group by 1, 2), j as (select candidate, coalesce(n, 0) as n, coalesce(list_contains(bins, bin), false) as seen from o left join c using (cell)), g as (select candidate, count(*) as cells, count(*) filter (where n = 0) / count(*)::double as new, count(*) filter (where n > 0 and n < 3) / count(*)::double as under, count(*) filter (where n > 0 and not seen) / count(*)::double as other from j group by 1) select *, round(0.45::double * new + 0.25::double * under + 0.15::double * other, 9) as score from g",
    "h2_best_of_group": "select p_brand, p_partkey, p_size, p_retailprice from (select *, row_number() over (partition by p_brand order by p_size desc, p_retailprice desc, p_partkey) as n from part) where n = 1",
    "h39_ring_origins": f"select n_nationkey as region, r::double as radius, k::int as step, round(1 + r * cos(k * {2 * math.pi / 12!r}::double), 9) as x, round(2 + r * sin(k * {2 * math.pi / 12!r}::double), 9) as y, round(0.5 + h, 9)::double as z from nation, (values (0.75::double), (1.5::double)) a(r), range(12) b(k), (values (0.0::double), (0.4::double)) c(h)",
    "h41_cube_faces": "select n_nationkey, f.* from nation, (values (0, 1, 0, 0), (1, -1, 0, 0), (2, 0, 1, 0), (3, 0, -1, 0), (4, 0, 0, 1), (5, 0, 0, -1)) f(face, dx, dy, dz)",
    "h43_sphere_directions": f"select id, round(sqrt(1 - z * z) * cos(id * {math.pi * (3 - math.sqrt(5))!r}::double), 9) as x, round(sqrt(1 - z * z) * sin(id * {math.pi * (3 - math.sqrt(5))!r}::double), 9) as y, round(z, 9) as z from (select id, 1 - (2 * id + 1) / 30.0::double as z from range(30) r(id))",
}
