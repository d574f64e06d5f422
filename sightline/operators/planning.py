"""From walkable cells to routes: kinds of space, connectors, coverage lanes, contours, stitching and the plan of all.

Cells are (id, ix, iy, x, y, z, ...), edges (src, dst, cost) in both directions.
Lines are points (key, ord, x, y, ...). Greedy choices run for all regions at once,
one round a job, on counts that are aggregated before they travel.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import vectors as V
from sightline.operators import graph as G
from sightline.operators.order import placed
from sightline.operators.paths import chaikin
from sightline.operators.spatial import nearest, radius_join
from sightline.session import cut


@dataclass(frozen=True)
class Limits:
    """The limits of a walkable plan, in metres and square metres."""

    grid: float = 0.3
    floor_tolerance: float = 0.10
    connector_step: float = 0.38
    least_cells: int = 4
    least_area: float = 2.0
    stitch_distance: float = 1.25
    stitch_degrees: float = 65.0
    smoothing: int = 2
    connector_rise: float = 0.55
    connector_lanes: float = 3.0
    major_area: float = 8.0
    room_area: float = 4.0
    room_width: float = 1.8
    room_lanes: int = 2
    cover_radius: float = 0.50
    cover_target: float = 0.98
    lane_gap: float = 0.85


# kinds of space


def classify_regions(cells: DataFrame, *, region: str, pitch: float, near: float) -> DataFrame:
    """A row for each region of cells (ix, iy, x, y, clearance, doorway): its measures and its kind.

    Spans are along the principal axes. Doorway transitions come first, then narrow
    corridors, small rooms, cluttered space; the rest are normal rooms.
    """
    c = cells.withColumns({"px": F.col("x") - F.avg("x").over(Window.partitionBy(region)), "py": F.col("y") - F.avg("y").over(Window.partitionBy(region))})
    axes = c.groupBy(region).agg((0.5 * F.atan2(2 * F.sum(F.col("px") * F.col("py")), F.sum(F.col("px") * F.col("px")) - F.sum(F.col("py") * F.col("py")))).alias("turn"))
    c = c.join(axes, region).withColumn("u", F.col("px") * F.cos("turn") + F.col("py") * F.sin("turn")).withColumn("w", F.col("py") * F.cos("turn") - F.col("px") * F.sin("turn"))
    m = c.groupBy(region).agg(
        F.count(F.lit(1)).alias("cells"), (F.max("u") - F.min("u")).alias("long"), (F.max("w") - F.min("w")).alias("wide"), F.expr("percentile(clearance, 0.1)").alias("p10"), F.expr("percentile(clearance, 0.5)").alias("p50"), F.avg("clearance").alias("mean"),
        F.count_if("doorway").alias("doorways"), F.count_if(F.col("clearance") >= 0.20).alias("safe"), ((F.max("ix") - F.min("ix") + 1) * (F.max("iy") - F.min("iy") + 1)).alias("box"),
    )
    shorter = F.greatest(F.lit(pitch), F.least("long", "wide"))
    m = m.withColumn("area", F.col("cells") * (pitch * pitch)).withColumn("width", F.greatest(F.lit(pitch), 2 * F.col("p10"))).withColumn("aspect", F.greatest("long", "wide", shorter) / shorter).withColumn("occupancy", V.clamp(1 - F.col("cells") / F.greatest(F.lit(1), F.col("box")), 0.0, 1.0))
    kind = (
        F.when((F.col("area") <= 2.0) & (F.col("doorways") > 0), "DOORWAY_TRANSITION")
        .when((F.col("aspect") >= 2.5) & ((F.col("width") <= 2.2) | (F.col("p50") <= 1.0)), "NARROW_CORRIDOR")
        .when((F.col("area") <= 8.0) | (F.col("width") <= 1.35) | (F.col("safe") < 6), "SMALL_ROOM")
        .when((F.col("occupancy") >= 0.35) | (F.col("mean") <= 0.55), "CLUTTERED_SPACE")
        .otherwise("NORMAL_ROOM")
    )
    return m.select(region, "cells", "area", "width", "mean", "p10", "p50", "aspect", "safe", "doorways", "occupancy", kind.alias("kind"), ((F.col("p50") < near) | (F.col("width") < 2 * near)).alias("near_field"))


def preferred_direction(cells: DataFrame, *, region: str) -> DataFrame:
    """id, dx, dy: in a doorway the axis along which the neighbours are wider (x of equals), else the way to the region's centre, else (1, 0)."""
    c = cells.select("ix", "iy", F.col("clearance").alias("n"))
    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])).alias("o")
    ask = cells.where("doorway").select("id", "ix", "iy", around).select("id", (F.col("ix") + F.col("o.dx")).alias("ix"), (F.col("iy") + F.col("o.dy")).alias("iy"), (F.col("o.dx") != 0).alias("level"))
    sums = ask.join(c, ["ix", "iy"]).groupBy("id").agg(F.sum(F.when(F.col("level"), F.col("n")).otherwise(0.0)).alias("sx"), F.sum(F.when(~F.col("level"), F.col("n")).otherwise(0.0)).alias("sy"))
    centre = cells.groupBy(region).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    r = cells.join(centre, region).join(sums, "id", "left").withColumn("vx", F.col("cx") - F.col("x")).withColumn("vy", F.col("cy") - F.col("y")).withColumn("n", F.hypot("vx", "vy"))
    along_x = F.coalesce(F.col("sx") >= F.col("sy"), F.lit(True))
    pick = lambda d, v, else_: F.when(F.col("doorway"), F.when(along_x, d[0]).otherwise(d[1])).when(F.col("n") > 1e-6, F.col(v) / F.col("n")).otherwise(else_)
    return r.select("id", pick((1.0, 0.0), "vx", 1.0).alias("dx"), pick((0.0, 1.0), "vy", 0.0).alias("dy"))


def space_kinds(cells: DataFrame, *, space: str, limits: Limits) -> DataFrame:
    """space, area, kind: a room has the area and the width of one, everything else is a corridor."""
    g = limits.grid
    m = cells.groupBy(space).agg((F.count(F.lit(1)) * (g * g)).alias("area"), (F.least(F.max("x") - F.min("x"), F.max("y") - F.min("y")) + g).alias("width"))
    return m.select(space, "area", F.when((F.col("area") >= limits.room_area) & (F.col("width") >= limits.room_width), "ROOM").otherwise("CORRIDOR").alias("kind"))


def corridor_axes(widths: DataFrame, *, corridor: float) -> DataFrame:
    """id, narrow_x, narrow_y, allow_x, allow_y of cells (id, width_x, width_y): lanes along an axis are allowed unless the cell is narrow along it alone."""
    nx, ny = F.col("width_x") <= corridor, F.col("width_y") <= corridor
    return widths.select("id", nx.alias("narrow_x"), ny.alias("narrow_y"), (~nx | ny).alias("allow_x"), (~ny | nx).alias("allow_y"))


# coverage of cells by lines


def covered_cells(cells: DataFrame, segments: DataFrame, *, radius: float, by: Sequence[str] = ()) -> DataFrame:
    """The distinct (id, *by, *line columns) of cells within radius, in the plane, of a segment (ax, ay, bx, by_, ...).

    A segment goes to the grid cells of its box grown by the radius and narrowed to
    those near it; `by` names columns that must agree, as a storey.
    """
    size = max(radius, 1e-9)
    extra = [c for c in segments.columns if c not in ("ax", "ay", "bx", "by_", *by)]
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - radius) / size).cast("long"), F.floor((F.greatest(a, b) + radius) / size).cast("long"))
    s = segments.withColumn("gx", F.explode(span("ax", "bx"))).withColumn("gy", F.explode(span("ay", "by_")))
    middle = V.segment_distance_xy((F.col("gx") + 0.5) * size, (F.col("gy") + 0.5) * size, F.col("ax"), F.col("ay"), F.col("bx"), F.col("by_"))
    s = s.where(middle <= radius + size)
    c = cells.select("id", "x", "y", *by, F.floor(F.col("x") / size).cast("long").alias("gx"), F.floor(F.col("y") / size).cast("long").alias("gy"))
    near = c.join(s.hint("merge"), ["gx", "gy", *by]).where(V.segment_distance_xy(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by_")) <= radius + 1e-9)
    return near.select("id", *by, *extra).distinct()


def line_segments(points: DataFrame, *, key: str, order: str, keep: Sequence[str] = ()) -> DataFrame:
    """The segments (key, ax, ay, bx, by_) between neighbours of each line."""
    w = Window.partitionBy(key).orderBy(order)
    nxt = points.withColumn("bx", F.lead("x").over(w)).withColumn("by_", F.lead("y").over(w))
    return nxt.where("bx is not null").select(key, *keep, F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by_")


def covered_within(edges: DataFrame, seeds: DataFrame, radius: float) -> DataFrame:
    """node, distance of what lies within a walking distance of the seeds (node): nothing beyond is ever relaxed."""
    best = cut(seeds.select("node").distinct().withColumn("distance", F.lit(0.0)))
    front = best
    while True:
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node"), (F.col("distance") + F.col("cost")).alias("distance")).where(F.col("distance") <= radius + 1e-9).groupBy("node").agg(F.min("distance").alias("distance"))
        front = cut(step.join(best.withColumnRenamed("distance", "was"), "node", "left").where(F.col("was").isNull() | (F.col("distance") < F.col("was") - 1e-12)).drop("was"))
        if front.isEmpty():
            return best
        best = cut(best.join(front.select("node"), "node", "left_anti").unionByName(front))


def edge_distance(cells: DataFrame, edges: DataFrame, step: float, neighbours: int = 4) -> DataFrame:
    """node, distance of a mask's cells from its outside, which is one step beyond a cell that lacks a neighbour."""
    links = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    rim = cells.select("id").join(links, "id", "left").where(F.coalesce("n", F.lit(0)) < neighbours).select(F.col("id").alias("node"))
    return G.shortest(edges, rim).select("node", (F.col("distance") + step).alias("distance"))


# regions and what joins them


def walk_back(found: DataFrame, ends: DataFrame) -> DataFrame:
    """(group, step, node): from each end (group, node) along `previous` of shortest() to its seed, step 0 at the end. The part known doubles in a round."""
    up = cut(found.select("node", "previous").where("previous is not null"))
    known, n = cut(ends.select("group", "node").withColumn("step", F.lit(0))), 1
    while True:
        steps = cut(known.join(up.hint("merge"), "node").select("group", F.col("previous").alias("node"), (F.col("step") + n).alias("step")))
        if steps.isEmpty():
            return known.select("group", "step", "node")
        known = cut(known.unionByName(steps))
        up = cut(up.join(up.select(F.col("node").alias("previous"), F.col("previous").alias("far")).hint("merge"), "previous").select("node", F.col("far").alias("previous")))
        n *= 2


def connectors(cells: DataFrame, edges: DataFrame, membership: DataFrame, regions: DataFrame, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """Ramps and stairs: (connector, kind, regions, rise, run, cells) and their centre lines (connector, ord, node).

    membership (id, region); regions (region, mean_z, area). Connectors are components
    of the ends of steep edges and of unclaimed cells that hold a steep one, touch two
    regions, rise enough both themselves and between these, don't fall back on their
    centre line by more than the tolerance, and are wide enough or join two major
    floors. A ramp rises at most a fifth. They are numbered by their least cell. Edges
    may bring their `rise`.
    """
    z = cells.select("id", "x", "y", "z")
    a, b = (z.select(F.col("id").alias(n), F.col("z").alias(f"z_{n}")) for n in ("src", "dst"))
    rises = edges if "rise" in edges.columns else edges.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").withColumn("rise", F.abs(F.col("z_src") - F.col("z_dst")))
    steep = cut(rises.where(F.col("rise") > limits.floor_tolerance).select(F.col("src").alias("id")).distinct())
    free = edges.select(F.col("src").alias("id")).distinct().join(membership.select("id").hint("merge"), "id", "left_anti")
    nodes = cut(steep.unionByName(free).distinct())
    inner = cut(G.restrict(edges, nodes))
    parts = G.components_of(nodes, inner).select(F.col("node").alias("id"), F.col("root").alias("group"))
    parts = cut(parts.join(parts.join(steep.hint("merge"), "id", "left_semi").select("group").distinct().hint("merge"), "group", "left_semi"))
    own = parts.join(membership.hint("merge"), "id").select("group", "region")
    beside = edges.select(F.col("src").alias("id"), "dst").join(parts.hint("merge"), "id").select("group", F.col("dst").alias("id")).distinct().join(membership.hint("merge"), "id").select("group", "region")
    touched = cut(own.unionByName(beside).distinct().join(regions, "region"))
    pairs = touched.groupBy("group").agg(F.countDistinct("region").alias("n"), (F.max("mean_z") - F.min("mean_z")).alias("regional"), F.count_if(F.col("area") >= limits.major_area).alias("major"), F.transform(F.sort_array(F.collect_set(F.struct("mean_z", "region"))), lambda r: r["region"]).alias("regions")).where("n >= 2")
    ends = parts.join(z.hint("merge"), "id").groupBy("group").agg(F.min(F.struct("z", "id")).alias("low"), F.max(F.struct("z", "id")).alias("high"), F.count(F.lit(1)).alias("cells")).join(pairs, "group")
    ends = cut(ends.where((F.col("high.z") - F.col("low.z") >= limits.connector_rise) & (F.col("regional") >= limits.connector_rise)))
    found = G.shortest(inner, ends.select(F.col("low.id").alias("node")), block=60_000)
    line = walk_back(found, ends.select("group", F.col("high.id").alias("node"))).join(z.withColumnRenamed("id", "node").hint("merge"), "node")
    w = Window.partitionBy("group").orderBy(F.desc("step"))
    legs = line.withColumn("px", F.lag("x").over(w)).withColumn("py", F.lag("y").over(w)).withColumn("pz", F.lag("z").over(w))
    run = legs.groupBy("group").agg(F.coalesce(F.sum(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))), F.lit(0.0)).alias("run"), F.coalesce(F.sum(F.greatest(F.lit(0.0), F.col("pz") - F.col("z"))), F.lit(0.0)).alias("back"), F.count(F.lit(1)).alias("long"))
    good = ends.join(run, "group").where((F.col("back") <= limits.floor_tolerance) & ((F.col("cells") / F.col("long") + 1e-9 >= limits.connector_lanes) | (F.col("major") >= 2)))
    rise = F.col("high.z") - F.col("low.z")
    kind = F.when(rise / F.greatest("run", F.lit(1e-9)) <= 0.20 + 1e-12, "RAMP").otherwise("STAIR")
    out = cut(good.select("group", kind.alias("kind"), "regions", rise.alias("rise"), "run", "cells"))
    named = F.concat_ws("_", F.initcap("kind"), F.col("group").cast("string"))
    lines = line.join(out.select("group", named.alias("connector")), "group").select("connector", F.row_number().over(Window.partitionBy("connector").orderBy(F.desc("step"))).alias("ord"), "node", "x", "y", "z")
    return out.select(named.alias("connector"), "kind", "regions", "rise", "run", "cells"), lines


def reachable_regions(edges: DataFrame, membership: DataFrame, joined: DataFrame, seed: DataFrame) -> DataFrame:
    """region of all that connectors (regions) join to the seed's (node); a seed outside all regions starts from the nearest by walking distance."""
    home = cut(seed.join(membership.withColumnRenamed("id", "node"), "node").select("region"))
    if home.isEmpty():
        near = G.shortest(edges, seed).join(membership.withColumnRenamed("id", "node"), "node")
        home = near.groupBy().agg(F.min(F.struct("distance", "node", "region")).alias("m")).where("m is not null").select(F.col("m.region").alias("region"))
    links = joined.select(F.explode("regions").alias("dst"), F.col("regions")[0].alias("src")).where("src <> dst")
    both = links.select("src", "dst", F.lit(1.0).alias("cost"))
    return G.reachable_set(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost")), home.select(F.col("region").alias("node"))).select(F.col("node").alias("region"))


def structural_supports(cells: DataFrame, edges: DataFrame, *, step: float, least_area: float, flat: float = 0.075, joined: float = 0.45) -> DataFrame:
    """id of broad floors, and of smaller patches that touch two whose mean heights are more than `joined` apart."""
    level = G.components_of(cells, G.flat_edges(edges, cells, flat))
    major = cut(level.where(F.col("size") * step * step >= least_area).select(F.col("node").alias("id"), F.col("root").alias("floor")))
    mean = major.join(cells.select("id", "z"), "id").groupBy("floor").agg(F.avg("z").alias("mean"))
    rest = cells.join(major, "id", "left_anti")
    parts = cut(G.components_of(rest, G.restrict(edges, rest)).select(F.col("node").alias("id"), F.col("root").alias("patch")))
    touch = parts.join(edges, parts["id"] == edges["src"]).select("patch", F.col("dst").alias("id")).join(major, "id").join(mean, "floor")
    good = touch.groupBy("patch").agg(F.countDistinct("floor").alias("n"), (F.max("mean") - F.min("mean")).alias("apart")).where((F.col("n") >= 2) & (F.col("apart") > joined)).select("patch")
    return major.select("id").unionByName(parts.join(good, "patch", "left_semi").select("id"))


def component_at(cells: DataFrame, edges: DataFrame, seed: tuple[float, float, float] | None, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """id of the component of the cell nearest to a seed, ties by id; without a seed of the largest component."""
    c = G.components_of(cells, edges).select(F.col("node").alias("id"), "root", "component")
    if seed is None:
        return c.where("component = 1").select("id")
    d2 = sum(((F.col(a) - v) * (F.col(a) - v) for a, v in zip(axes, seed, strict=True)), F.lit(0.0))
    first = cells.groupBy().agg(F.min(F.struct(F.round(d2, 12).alias("d"), "id")).alias("m")).select(F.col("m.id").alias("id"))
    return c.join(c.join(first, "id").select("root"), "root", "left_semi").select("id")


# lanes


def contiguous_lanes(cells: DataFrame, *, stride: int, budget: int, least: int = 2) -> DataFrame:
    """axis, lane, run, rank, cells: unbroken runs of every stride-th row and column, the longest of both axes in turn up to a budget."""
    out = None
    for axis, across, along in (("x", "iy", "ix"), ("y", "ix", "iy")):
        rows = cells.where(F.pmod(F.col(across), F.lit(stride)) == 0).select(F.lit(axis).alias("axis"), F.col(across).cast("long").alias("lane"), F.col(along).cast("long").alias("at")).distinct()
        run = F.col("at") - F.row_number().over(Window.partitionBy("axis", "lane").orderBy("at"))
        runs = rows.withColumn("run", run).groupBy("axis", "lane", "run").agg(F.count(F.lit(1)).alias("cells"), F.min("at").alias("first"), F.max("at").alias("last")).where(F.col("cells") >= least)
        top = runs.orderBy(F.desc("cells"), "lane", "first").limit(budget)  # a top-k
        ranked = top.withColumn("turn", F.row_number().over(Window.partitionBy("axis").orderBy(F.desc("cells"), "lane", "first")))
        out = ranked if out is None else out.unionByName(ranked)
    return out.withColumn("rank", F.row_number().over(Window.orderBy("turn", "axis"))).where(F.col("rank") <= budget).select("axis", "lane", "first", "last", "cells", "rank")


def typed_runs(cells: DataFrame, *, lane: str, at: str, kind: str) -> DataFrame:
    """lane, run, first, last, cells: runs broken where a place is missing or the kind changes."""
    w = Window.partitionBy(lane).orderBy(at)
    new = F.when((F.col(at) - F.lag(at).over(w) == 1) & F.col(kind).eqNullSafe(F.lag(kind).over(w)), 0).otherwise(1)
    r = cells.withColumn("__new", new).withColumn("run", F.sum("__new").over(w))
    return r.groupBy(lane, "run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("cells"), F.first(kind).alias("kind"))


def split_valid(points: DataFrame, *, key: str, order: str, vertex: Column, edge: Column) -> DataFrame:
    """Points of the parts of each line (key, part, ord, ...): broken at invalid vertices, which go, and at invalid edges (to the point before), which don't; parts of one point go."""
    w = Window.partitionBy(key).orderBy(order)
    p = points.withColumn("__v", vertex).withColumn("__e", edge)
    p = p.withColumn("part", F.sum(F.when(F.coalesce(F.col("__e") & F.lag("__v").over(w), F.lit(False)) & F.col("__v"), 0).otherwise(1)).over(w)).where("__v")
    p = p.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(key, "part"))).where("__n > 1")
    return p.drop("__v", "__e", "__n")


def anchors(points: DataFrame, cells: DataFrame, *, key: str, order: str, reach: float) -> DataFrame:
    """key, id, ord: the nearest cell of each point within reach (ties by id), with the first point that has it."""
    pairs = radius_join(points.select(key, order, "x", "y"), cells.select("id", "x", "y"), reach, ("x", "y"))
    one = pairs.withColumn("__d", F.round("distance2", 12)).groupBy(f"l_{key}", f"l_{order}").agg(F.min(F.struct("__d", "r_id"))["r_id"].alias("id"))
    return one.groupBy(F.col(f"l_{key}").alias(key), "id").agg(F.min(f"l_{order}").alias(order))


def evenly_spaced_lanes(cells: DataFrame, *, region: str, count: int) -> DataFrame:
    """region, lane of the rows at even ranks of each region: as many as count, the first and last among them."""
    rows = cells.groupBy(region, F.col("iy").alias("lane")).agg(F.count(F.lit(1)).alias("cells")).where("cells >= 2")
    w = Window.partitionBy(region)
    r = rows.withColumn("k", F.row_number().over(w.orderBy("lane")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    wanted = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(max(count - 1, 0))), lambda i: F.round(i * (F.col("n") - 1) / max(count - 1, 1)).cast("int")))
    return r.where((F.col("n") <= count) | F.array_contains(wanted, F.col("k").cast("int"))).select(region, "lane", "cells")


def _dominant(p: pd.DataFrame) -> pd.DataFrame:
    """place, gain of a block's lanes that the greedy choice takes before any lane that shares a cell with them.

    A row for each lane (place, edge_rank, cells) and open cell (id), with the best that
    any lane of other blocks has there now (r_gain, r_edge_rank, r_cells, r_place; a gain of -1: none).
    What a lane adds only falls, so a lane above all that share its open cells is taken
    as it is. One that is not holds its cells: lesser lanes at these must wait too.
    """
    held, at, rank, rival = {}, {}, {}, {}
    for lane, cell, edge, n, *r in p[["place", "id", "edge_rank", "cells", "r_gain", "r_edge_rank", "r_cells", "r_place"]].itertuples(index=False, name=None):
        held.setdefault(lane, []).append(cell)
        at.setdefault(cell, []).append(lane)
        rank[lane] = (-edge, -n, lane)
        rival[cell] = (-r[0], -r[1], -r[2], r[3])
    gain = {lane: len(cells) for lane, cells in held.items()}
    heap = [(-n, *rank[lane]) for lane, n in gain.items()]
    heapq.heapify(heap)
    gone, waits, out = set(), set(), []
    while heap:
        key = heapq.heappop(heap)
        lane = key[3]
        if not gain[lane]:
            continue
        if -key[0] != gain[lane]:
            heapq.heappush(heap, (-gain[lane], *rank[lane]))
            continue
        mine = [c for c in held[lane] if c not in gone]
        if any(c in waits or rival[c] < key for c in mine):
            waits.update(mine)
            continue
        out.append((lane, gain[lane]))
        gone.update(mine)
        for c in mine:
            for other in at[c]:
                gain[other] -= 1
    return pd.DataFrame(out, columns=["place", "gain"]).astype("int64")


def cover_by_lanes(cells: DataFrame, lanes: DataFrame, *, region: str, lane: str, radius: float, target: float, least: int = 0, covered: DataFrame | None = None, block: int = 100_000) -> DataFrame:
    """(region, lane, pick, gain): lanes chosen greedily in each region until the target share of its cells is covered.

    lanes (region, lane, ax, ay, bx, by_, cells, edge_rank); of equal gains the one
    nearer to the border, the longer, the lesser wins. Below `least` picks a region
    goes on without a gain. Lanes fall into blocks of about `block` covered cells by
    region and lane. A round takes, in a task a block, every lane that comes before all
    that share cells with it; what a lane adds only falls, so the order of the picks is that
    of their gains. So the rounds grow with the blocks that a chain of overlapping
    lanes crosses, not with the picks; at the end a region's lanes, a row each, are put in order in one task.
    """
    size = cells.groupBy(region).agg(F.count(F.lit(1)).alias("all"))
    gives = cut(covered_cells(cells, lanes.select(region, lane, "ax", "ay", "bx", "by_"), radius=radius, by=[region]))
    left = gives if covered is None else cut(gives.join(covered.select("id").distinct(), "id", "left_anti"))
    have = size.join(cells.join(covered.select("id").distinct(), "id", "left_semi").groupBy(region).agg(F.count(F.lit(1)).alias("have")), region, "left").select(region, "all", F.coalesce("have", F.lit(0)).alias("have")) if covered is not None else size.withColumn("have", F.lit(0).cast("long"))
    counts = left.groupBy(region, lane).agg(F.count(F.lit(1)).alias("n"))
    numbered = cut(placed(lanes.select(region, lane, "cells", "edge_rank").join(counts.hint("merge"), [region, lane], "left").withColumn("n", F.coalesce("n", F.lit(0))), [region, lane], total="n").withColumn("block", F.floor(F.col("before") / block)).select(region, lane, "cells", "edge_rank", "place", "block"))
    left = cut(left.join(numbered.hint("merge"), [region, lane]).select("id", "place", "block", "edge_rank", "cells"))
    rank = ("gain", "edge_rank", "cells", "less")
    taken = None
    while not left.isEmpty():
        keyed = left.join(left.groupBy("place").agg(F.count(F.lit(1)).alias("gain")).hint("merge"), "place")
        tops = keyed.groupBy("id", "block").agg(F.max(F.struct("gain", "edge_rank", "cells", (-F.col("place")).alias("less"))).alias("top"))
        others = tops.select("id", F.col("block").alias("__b"), F.col("top").alias("rival")).hint("merge")
        rival = tops.join(others, "id").where(F.col("block") != F.col("__b")).groupBy("id", "block").agg(F.max("rival").alias("rival"))
        met = keyed.join(rival.hint("merge"), ["id", "block"], "left").select("block", "place", "id", "edge_rank", "cells", *[F.coalesce(F.col(f"rival.{c}"), F.lit(-1 if c == "gain" else 0)).alias(f"r_{c}") for c in rank]).withColumn("r_place", -F.col("r_less"))
        now = cut(met.groupBy("block").applyInPandas(_dominant, "place long, gain long"))
        taken = now if taken is None else taken.unionByName(now)
        fresh = left.join(now.select("place").hint("merge"), "place", "left_semi").select("id").distinct()
        left = cut(left.join(fresh.hint("merge"), "id", "left_anti"))
    w = Window.partitionBy(region).orderBy(F.desc("gain"), F.desc("edge_rank"), F.desc("cells"), lane)
    gains = numbered.join(taken.hint("merge"), "place", "left") if taken is not None else numbered.withColumn("gain", F.lit(None).cast("long"))
    ordered = gains.withColumn("gain", F.coalesce("gain", F.lit(0))).withColumn("pick", F.row_number().over(w) - 1).withColumn("before", F.coalesce(F.sum("gain").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    wanted = (F.col("pick") < least) | ((F.col("gain") > 0) & (F.col("have") + F.col("before") < target * F.col("all") - 1e-9))
    return ordered.join(have, region).where(wanted).select(region, lane, "pick", "gain")


def row_lanes(cells: DataFrame, *, region: str, grid: float) -> DataFrame:
    """region, lane, ax, ay, bx, by_, cells, edge_rank: the unbroken runs of two cells or more of every row, numbered in order."""
    runs = cells.withColumn("__run", F.col("ix") - F.row_number().over(Window.partitionBy(region, "iy").orderBy("ix")))
    r = runs.groupBy(region, "iy", "__run").agg(F.count(F.lit(1)).alias("cells"), F.min("x").alias("ax"), F.max("x").alias("bx"), F.min("y").alias("ay"), F.max("y").alias("by_")).where("cells >= 2")
    w = Window.partitionBy(region)
    r = r.withColumn("lane", F.row_number().over(w.orderBy("iy", "ax"))).withColumn("n", F.count(F.lit(1)).over(w))
    return r.select(region, "lane", "ax", "ay", "bx", "by_", "cells", (-F.least(F.col("lane") - 1, F.col("n") - F.col("lane"))).alias("edge_rank"))


# contours


#: Which sides of a square (bottom 0, right 1, top 2, left 3) a contour joins, by the corners above the level.
SQUARE_CASES = {1: ((3, 0),), 2: ((0, 1),), 3: ((3, 1),), 4: ((1, 2),), 5: ((3, 2), (0, 1)), 6: ((0, 2),), 7: ((3, 2),), 8: ((2, 3),), 9: ((2, 0),), 10: ((0, 3), (1, 2)), 11: ((2, 1),), 12: ((1, 3),), 13: ((1, 0),), 14: ((0, 3),)}


def contour_segments(field: DataFrame, level: float) -> DataFrame:
    """u, v, ax, ay, bx, by_: the pieces of a field's (ix, iy, value) contour, with the grid sides u, v that they end on.

    A square needs all four corners. A side's name is shared by the two squares at it,
    so pieces that follow each other share it.
    """
    corners = F.explode(F.array(*[F.struct(F.lit(-dx).alias("dx"), F.lit(-dy).alias("dy"), F.lit(k).alias("k")) for k, (dx, dy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))])).alias("o")
    q = field.select("ix", "iy", "value", corners).select((F.col("ix") + F.col("o.dx")).cast("long").alias("ix"), (F.col("iy") + F.col("o.dy")).cast("long").alias("iy"), "o.k", "value")
    q = q.groupBy("ix", "iy").agg(*[F.max(F.when(F.col("k") == k, F.col("value"))).alias(f"v{k}") for k in range(4)], F.count(F.lit(1)).alias("n")).where("n = 4")
    q = q.withColumn("case", sum((F.when(F.col(f"v{k}") >= level, 1 << k).otherwise(0) for k in range(1, 4)), F.when(F.col("v0") >= level, 1).otherwise(0)))
    t = lambda a, b: F.try_divide(level - F.col(a), F.col(b) - F.col(a))
    x, y = F.col("ix").cast("double"), F.col("iy").cast("double")
    side = lambda x_, y_, h, gx, gy: F.struct(x_.alias("x"), y_.alias("y"), F.concat_ws("_", F.lit(h), gx.cast("string"), gy.cast("string")).alias("name")).cast("struct<x:double,y:double,name:string>")
    sides = F.array(side(x + t("v0", "v1"), y, "h", F.col("ix"), F.col("iy")), side(x + 1, y + t("v1", "v2"), "v", F.col("ix") + 1, F.col("iy")), side(x + t("v3", "v2"), y + 1, "h", F.col("ix"), F.col("iy") + 1), side(x, y + t("v0", "v3"), "v", F.col("ix"), F.col("iy")))
    table = F.create_map(*[v for k, pairs in SQUARE_CASES.items() for v in (F.lit(k), F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs]))])
    with_case = q.where("case between 1 and 14").select(sides.alias("s"), F.explode(F.element_at(table, F.col("case"))).alias("p"))
    ends = with_case.select(F.get("s", F.col("p.a")).alias("a"), F.get("s", F.col("p.b")).alias("b"))
    return ends.select(F.col("a.name").alias("u"), F.col("b.name").alias("v"), F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by_"))


def isolines(field: DataFrame, level: float) -> DataFrame:
    """line, ord, x, y, closed: the contour's pieces chained; a line is named by its least side and starts there, or at its lesser end if it is open.

    The chains are components of pieces that share sides; a chain is put in order by
    one task, and has as many points as its contour.
    """
    s = cut(contour_segments(field, level))
    roots = G.components(s.select(F.xxhash64("u").alias("u"), F.xxhash64("v").alias("v")))
    rows = s.withColumn("node", F.xxhash64("u")).join(roots, "node").select("root", "u", "v", "ax", "ay", "bx", "by_")

    def chain(p: pd.DataFrame) -> pd.DataFrame:
        place, beside = {}, {}
        for u, v, ax, ay, bx, by in p[["u", "v", "ax", "ay", "bx", "by_"]].itertuples(index=False):
            place[u], place[v] = (ax, ay), (bx, by)
            beside.setdefault(u, []).append(v)
            beside.setdefault(v, []).append(u)
        ends = sorted(n for n, b in beside.items() if len(b) == 1)
        at, before, order = (ends or sorted(place))[0], None, []
        while at is not None and (not order or at != order[0]):
            order.append(at)
            ahead = [n for n in sorted(beside[at]) if n != before]
            before, at = at, (ahead[0] if ahead else None)
        name = min(place)
        return pd.DataFrame([(name, i, *place[n], not ends) for i, n in enumerate(order)], columns=["line", "ord", "x", "y", "closed"])

    return rows.groupBy("root").applyInPandas(chain, "line string, ord int, x double, y double, closed boolean")


# lines: smoothing, stitching


def smoothed(points: DataFrame, blocked: DataFrame, *, key: str, order: str, iterations: int, reach: float) -> DataFrame:
    """key, ord, x, y, passes: corner cutting, as often as no segment of the whole line comes within reach of a blocked point (x, y); a line stops at its first pass that would."""
    now = points.select(key, F.col(order).cast("int").alias("ord"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(0).alias("passes"))
    walls = blocked.select(F.monotonically_increasing_id().alias("id"), "x", "y")
    for k in range(1, iterations + 1):
        long = now.where(F.col("passes") == k - 1).join(now.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 2").select(key), key, "left_semi")
        tried = cut(chaikin(long, key=key, order="ord", axes=["x", "y"]))
        bad = covered_cells(walls, line_segments(tried, key=key, order="ord"), radius=reach).select(key).distinct()
        fine = tried.join(bad, key, "left_anti").select(key, F.col("ord").cast("int").alias("ord"), "x", "y", F.lit(k).alias("passes"))
        now = cut(now.join(fine.select(key).distinct(), key, "left_anti").unionByName(fine))
    return now


def stitched(points: DataFrame, *, group: str, key: str, order: str, distance: float, degrees: float, least: float = 0.0) -> DataFrame:
    """group, line, ord, x, y: the lines of each group, joined end to end as long as two fit: the nearest and straightest pair first.

    Two ends fit if they are at most a distance apart and turn by at most an angle;
    their score is the gap plus the distance times the turn's share of that angle,
    ties by the lesser lines. Ends are looked up by place, so a round costs what lies
    near; a group's lines must fit a task. Lines shorter than `least` go at the end.
    """
    own = points.select(F.col(group).alias("group"), F.col(key).alias("key"), F.col(order).alias("ord"), "x", "y")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        work: dict = {}
        for k, x, y in p.dropna(subset=["key"]).sort_values(["key", "ord"])[["key", "x", "y"]].itertuples(index=False, name=None):
            work.setdefault(k, []).append([float(x), float(y)])
        work = {k: v for k, v in work.items() if len(v) > 1}
        limit = math.radians(degrees)
        cell = max(distance, 1e-9)
        at: dict[tuple, set] = {}
        age = dict.fromkeys(work, 0)
        heap: list[tuple] = []

        def place(q: list) -> tuple:
            return int(q[0] // cell), int(q[1] // cell)

        def mark(k, add: bool) -> None:
            for end in (0, -1):
                s = at.setdefault(place(work[k][end]), set())
                (s.add if add else s.discard)(k)

        def fits(a, b):
            la, lb = work[a], work[b]
            for ra in (False, True):
                before, end = (la[1], la[0]) if ra else (la[-2], la[-1])
                for rb in (False, True):
                    start, after = (lb[-1], lb[-2]) if rb else (lb[0], lb[1])
                    gap = math.dist(end, start)
                    if gap > distance:
                        continue
                    u, v = (end[0] - before[0], end[1] - before[1]), (after[0] - start[0], after[1] - start[1])
                    n = math.hypot(*u) * math.hypot(*v)
                    turn = math.acos(max(-1.0, min(1.0, (u[0] * v[0] + u[1] * v[1]) / n))) if n > 1e-18 else 0.0
                    if turn <= limit + 1e-12:
                        yield (round(gap + distance * turn / max(limit, 1e-9), 9), a, b, ra, rb)

        def offer(k) -> None:
            """Put the best pair of a line on the heap."""
            near = {o for end in (0, -1) for dx in (-1, 0, 1) for dy in (-1, 0, 1) for o in at.get((place(work[k][end])[0] + dx, place(work[k][end])[1] + dy), ())}
            best = min((f for o in near if o != k for f in fits(*sorted((k, o)))), default=None)
            if best:
                heapq.heappush(heap, (*best, k, age[best[1]], age[best[2]]))

        for k in work:
            mark(k, True)
        for k in work:
            offer(k)
        while heap:
            _, a, b, ra, rb, k, *ages = heapq.heappop(heap)
            if [age.get(a), age.get(b)] != ages:
                # a line that is as it was looks again; one that grew has a pair of its own on the heap
                if age.get(k) == ages[k == b]:
                    offer(k)
                continue
            mark(a, False)
            mark(b, False)
            la, lb = (work[a][::-1] if ra else work[a]), (work[b][::-1] if rb else work[b])
            work[a] = la + (lb[1:] if math.dist(la[-1], lb[0]) <= 1e-6 else lb)
            del work[b], age[b]
            age[a] += 1
            mark(a, True)
            offer(a)
        out = [(p.group.iloc[0], k, i, x, y) for k, v in work.items() if sum(map(math.dist, v, v[1:])) >= least for i, (x, y) in enumerate(v)]
        return pd.DataFrame(out, columns=["group", "line", "ord", "x", "y"])

    kind = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    return own.groupBy("group").applyInPandas(run, f"group {kind['group']}, line {kind['key']}, ord int, x double, y double").withColumnRenamed("group", group)


def resampled(points: DataFrame, *, key: str, order: str, spacing: float) -> DataFrame:
    """key, ord, x, y: places every `spacing` along each line, carried over its corners, and the end point, though it may stand there twice."""
    own = points.select(F.col(key).alias("key"), F.col(order).alias("ord"), "x", "y")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        q = p.sort_values("ord")[["x", "y"]].to_numpy(float).tolist()
        out, due = [q[0]], spacing
        for a, b in zip(q, q[1:], strict=False):
            n = math.dist(a, b)
            while n > 1e-12 and due <= n + 1e-12:
                out.append([a[0] + (b[0] - a[0]) * due / n, a[1] + (b[1] - a[1]) * due / n])
                due += spacing
            due -= n
        out.append(q[-1])
        return pd.DataFrame([(p.key.iloc[0], i, *v) for i, v in enumerate(out)], columns=["key", "ord", "x", "y"])

    kind = dict(own.dtypes)["key"]
    return own.groupBy("key").applyInPandas(run, f"key {kind}, ord int, x double, y double").withColumnRenamed("key", key)


def first_clear_height(points: DataFrame, blocked: DataFrame, heights: Sequence[float], *, key: str, reach: float) -> DataFrame:
    """key, height: the first of the heights at which no point of a line (x, y, z) comes within reach of a blocked one; null where none does."""
    tries = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(h)).alias("h")) for i, h in enumerate(heights)])).alias("t")
    moved = points.select(key, "x", "y", "z", tries).select(key, "t.i", "t.h", "x", "y", (F.col("z") + F.col("t.h")).alias("z"))
    hit = radius_join(moved, blocked.select("x", "y", "z"), reach, spread="right").select(F.col(f"l_{key}").alias(key), F.col("l_i").alias("i")).distinct()
    lines = points.select(key).distinct()
    free = lines.select(key, tries).select(key, "t.i", "t.h").join(hit.hint("merge"), [key, "i"], "left_anti").groupBy(key).agg(F.min(F.struct("i", "h")).alias("m"))
    return lines.join(free.hint("merge"), key, "left").select(key, F.col("m.h").alias("height"))


def repaired_runs(points: DataFrame, blocked: DataFrame, *, key: str, order: str, reach: float, margin: int = 1) -> DataFrame:
    """key, part, ord, x, y: what is left of each densely sampled line without the samples within reach of a blocked point and `margin` beside them; parts of one sample go."""
    p = points.select(key, F.col(order).alias("ord"), "x", "y")
    hit = radius_join(p, blocked.select("x", "y"), reach, ("x", "y")).select(F.col(f"l_{key}").alias(key), F.col("l_ord").alias("ord")).distinct().withColumn("hit", F.lit(1))
    w = Window.partitionBy(key).orderBy("ord")
    f = p.join(hit, [key, "ord"], "left").withColumn("bad", F.coalesce(F.max("hit").over(w.rowsBetween(-margin, margin)), F.lit(0)) > 0)
    return split_valid(f, key=key, order="ord", vertex=~F.col("bad"), edge=F.lit(True)).select(key, "part", "ord", "x", "y")


# the whole plan


def walkable_plan(cells: DataFrame, limits: Limits, *, seed: tuple[float, float, float] | None = None) -> dict[str, DataFrame]:
    """Routes over walkable cells: the cells and edges in reach, regions, connectors, lanes, lines and stats, as tables.

    Cells that the seed's component doesn't reach are left out; level regions and
    their connectors are found, those regions that connectors join to the largest (or
    the seed's) are swept by lanes up to the cover target, and each region's lanes are
    stitched, smoothed and measured.
    """
    edges = cut(G.grid_edges(cells, grid=limits.grid, max_rise=limits.connector_step, keep=["rise"]))
    mine = cut(cells.join(component_at(cells, edges, seed).hint("merge"), "id", "left_semi"))
    inner = cut(edges.join(mine.select(F.col("id").alias("src")).hint("merge"), "src", "left_semi").select(*edges.columns))  # an edge has both ends in one component
    area = limits.grid * limits.grid
    level = G.components_of(mine, inner.where(F.col("rise") <= limits.floor_tolerance + 1e-9)).where((F.col("size") >= limits.least_cells) & (F.col("size") * area >= limits.least_area))
    membership = cut(level.select(F.col("node").alias("id"), F.col("root").alias("region")))
    regions = cut(membership.join(mine.hint("merge"), "id").groupBy("region").agg(F.avg("z").alias("mean_z"), (F.count(F.lit(1)) * area).alias("area"), F.count(F.lit(1)).alias("cells")))
    joined, lines = connectors(mine, inner, membership, regions, limits)
    home = cut(membership.join(regions, "region").groupBy().agg(F.max(F.struct("area", (-F.col("id")).alias("less"), "id")).alias("m")).where("m is not null").select(F.col("m.id").alias("node")))
    reached = cut(reachable_regions(inner, membership, joined, home))
    swept = cut(mine.join(membership.hint("merge"), "id").join(reached, "region", "left_semi"))
    lanes = cut(row_lanes(swept, region="region", grid=limits.grid))
    radius = max(limits.grid * 0.75, min(limits.cover_radius, limits.lane_gap * 0.5))
    picks = cut(cover_by_lanes(swept, lanes, region="region", lane="lane", radius=radius, target=limits.cover_target))
    chosen = cut(lanes.join(picks.hint("merge"), ["region", "lane"]))
    ends = chosen.select("region", "lane", F.explode(F.array(F.struct(F.lit(0).alias("ord"), F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.lit(1).alias("ord"), F.col("bx").alias("x"), F.col("by_").alias("y")))).alias("p")).select("region", "lane", "p.*")
    routes = cut(stitched(ends, group="region", key="lane", order="ord", distance=limits.stitch_distance, degrees=limits.stitch_degrees))
    covered = covered_cells(swept, chosen.select("region", "ax", "ay", "bx", "by_"), radius=radius, by=["region"])
    stats = swept.groupBy().agg(F.count(F.lit(1)).alias("cells")).select("cells", F.lit(regions.count()).alias("regions"), F.lit(reached.count()).alias("reached"), F.lit(joined.count()).alias("connectors"), F.lit(chosen.count()).alias("lanes"), F.lit(covered.select("id").distinct().count()).alias("covered"), F.lit(routes.select("region", "line").distinct().count()).alias("lines"))
    return {"cells": mine, "edges": inner.drop("rise"), "regions": regions, "connectors": joined, "connector_lines": lines, "lanes": chosen, "routes": routes, "stats": stats}


def nearest_cell(points: DataFrame, cells: DataFrame, reach: float) -> DataFrame:
    """The cell nearest to each point (id, x, y, z) within reach, ties by id."""
    return nearest(radius_join(points.select("id", "x", "y", "z"), cells.select("id", "x", "y", "z"), reach), "l_id", ["distance2", "r_id"]).select(F.col("l_id").alias("id"), F.col("r_id").alias("cell"))
