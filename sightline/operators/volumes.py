"""Solids, clearance and the scan of free space, by rays and nearest triangles.

Triangles are (tri, owner, a, b, c), points (id, p). Everything here is a grid
join of spatial.py with an aggregate behind it; nothing meets everything else.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import vectors as V
from sightline.operators.graph import components_of, grid_edges
from sightline.operators.spatial import inside_solid, near_triangles, nearest_hit, ray_hits

#: Directions in general position, of which most must agree.
VOTES = ((0.3137, 0.7711, 0.5540), (-0.6421, 0.2713, 0.7170), (0.5209, -0.4127, -0.7472))
#: Which bounds the grid pitch and the surface cell have.
PITCH, LEAST_CELL, MOST_CELL = (0.10, 1.00, 2.00), 0.03, 0.15
RAY_GRIDS = {"FAST": 8, "NORMAL": 12, "HIGH": 16}


def bounds(vertices: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The least and greatest x, y, z of (x, y, z) rows, of each group of by."""
    return vertices.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for n, f in (("low", F.min), ("high", F.max)) for c in "xyz"])


def checked_bounds(vertices: DataFrame) -> dict[str, float]:
    """The bounds as numbers; an error where there are no rows."""
    r = bounds(vertices).first().asDict()
    if r["low_x"] is None:
        raise ValueError("no geometry to bound")
    return r


def grid_pitch(box: dict[str, float], *, requested: float = 0.35, most_cells: int = 200_000, unit: float = 1.0) -> float:
    """The pitch of a raster over a box: the requested one, or what keeps the cells under their number, both within limits."""
    low, high, top = PITCH
    width, depth = (max(0.01, (box[f"high_{c}"] - box[f"low_{c}"]) / unit) for c in "xy")
    need = math.sqrt(width * depth / max(1000, most_cells))
    return min(max(max(min(max(requested, low), high), need), low), top) * unit


def planning_settings(box: dict[str, float], quality: str = "NORMAL", unit: float = 1.0) -> dict[str, float]:
    """Diagonal, surface cell and rays a side of a planning run."""
    diagonal = max(0.01, math.dist([box[f"low_{c}"] for c in "xyz"], [box[f"high_{c}"] for c in "xyz"]))
    return {"diagonal": diagonal, "cell": min(max(diagonal / unit / 300, LEAST_CELL), MOST_CELL) * unit, "rays": RAY_GRIDS.get(quality, RAY_GRIDS["NORMAL"])}


def contains(points: DataFrame, triangles: DataFrame, *, cell: float, reach: float, surface: float = 1e-4) -> DataFrame:
    """id, owner of the solids that hold a point: most of three rays cross them an odd number of times, or the point lies on them."""
    on = near_triangles(points, triangles, cell=cell, radius=surface).select("id", "owner")
    return inside_solid(points, triangles, VOTES, cell=cell, reach=reach).unionByName(on).distinct()


def segments_inside(segments: DataFrame, triangles: DataFrame, *, cell: float, reach: float) -> DataFrame:
    """id, owner, inside of segments (id, a, b) for each solid that holds a part of them: whether it holds all.

    A segment is cut where it meets the solid; the middle of every piece must be inside.
    """
    far = V.distance(F.col("a"), F.col("b"))
    rays = segments.select(F.col("id").alias("ray"), F.col("a").alias("o"), V.sub(F.col("b"), F.col("a")).alias("d"))
    met = ray_hits(rays, triangles, cell=cell, reach=reach).join(segments.select(F.col("id").alias("ray"), far.alias("far")), "ray").where("t < far").groupBy("ray").agg(F.sort_array(F.collect_set(F.round("t", 9))).alias("cuts"))
    s = segments.withColumn("far", far).join(met.withColumnRenamed("ray", "id"), "id", "left")
    cuts = F.concat(F.array(F.lit(0.0)), F.coalesce("cuts", F.array().cast("array<double>")), F.array("far"))
    pieces = s.withColumn("c", cuts).select("id", "a", "b", "far", F.posexplode(F.transform(F.slice("c", 2, F.size("c") - 1), lambda t, i: (t + F.get(F.col("c"), i)) / 2)).alias("k", "m"))
    middles = pieces.select(F.struct("id", "k").alias("id"), V.lerp(F.col("a"), F.col("b"), F.col("m") / F.greatest("far", F.lit(1e-12))).alias("p"))
    held = contains(middles, triangles, cell=cell, reach=reach).groupBy("id.id", "owner").agg(F.countDistinct("id.k").alias("n"))
    return held.join(pieces.groupBy("id").agg(F.count(F.lit(1)).alias("pieces")), "id").select("id", "owner", (F.col("n") == F.col("pieces")).alias("inside"))


def collides(points: DataFrame, triangles: DataFrame, *, cell: float, reach: float, radius: float) -> DataFrame:
    """id of the points nearer than radius to a triangle, or inside a solid."""
    near = near_triangles(points, triangles, cell=cell, radius=radius).where(F.col("distance") < radius - 1e-9).select("id")
    return near.unionByName(inside_solid(points, triangles, VOTES, cell=cell, reach=reach).select("id")).distinct()


def clear(points: DataFrame, triangles: DataFrame, *, cell: float, reach: float, clearance: float) -> DataFrame:
    """The points outside all solids and no nearer than the clearance to any triangle."""
    return points.join(collides(points, triangles, cell=cell, reach=reach, radius=clearance), "id", "left_anti")


def vertical_limits(points: DataFrame, triangles: DataFrame, *, cell: float, reach: float, half: float = 1.2) -> DataFrame:
    """id, floor, ceiling: the nearest hits below and above; where one is missing, half below and above the point."""
    both = points.select("id", "p", F.explode(F.array(F.lit(-1.0), F.lit(1.0))).alias("up"))
    rays = both.select(F.struct("id", "up").alias("ray"), F.col("p").alias("o"), V.vec(0.0, 0.0, F.col("up")).alias("d"))
    hit = nearest_hit(rays, triangles, cell=cell, reach=reach).groupBy("ray.id").agg(F.max(F.when(F.col("ray.up") < 0, F.col("t"))).alias("below"), F.max(F.when(F.col("ray.up") > 0, F.col("t"))).alias("above"))
    ok = F.col("below").isNotNull() & F.col("above").isNotNull()
    return points.join(hit, "id", "left").select("id", (F.col("p.z") - F.when(ok, F.col("below")).otherwise(half)).alias("floor"), (F.col("p.z") + F.when(ok, F.col("above")).otherwise(half)).alias("ceiling"))


def free_width(points: DataFrame, triangles: DataFrame, axis: str, *, cell: float, limit: float) -> DataFrame:
    """id, width, centre along an axis between the hits on both sides; with an open side twice the limit, and the point's own place."""
    both = points.select("id", "p", F.explode(F.array(F.lit(-1.0), F.lit(1.0))).alias("way"))
    d = V.vec(*[F.col("way") if c == axis else 0.0 for c in "xyz"])
    hit = nearest_hit(both.select(F.struct("id", "way").alias("ray"), F.col("p").alias("o"), d.alias("d")), triangles, cell=cell, reach=limit)
    ways = hit.groupBy("ray.id").agg(F.max(F.when(F.col("ray.way") < 0, F.col("t"))).alias("n"), F.max(F.when(F.col("ray.way") > 0, F.col("t"))).alias("p_"))
    shut = F.col("n").isNotNull() & F.col("p_").isNotNull()
    at = F.col("p")[axis]
    return points.join(ways, "id", "left").select("id", F.when(shut, F.col("n") + F.col("p_")).otherwise(2 * limit).alias("width"), F.when(shut, at + (F.col("p_") - F.col("n")) / 2).otherwise(at).alias("centre"))


def nearest_surface(points: DataFrame, triangles: DataFrame, directions: Sequence[tuple[float, float, float]], *, cell: float, search: float) -> DataFrame:
    """id, nearest, open: the least distance over the directions, and the number of the most open one (the first of equals); nothing hit counts as the search distance."""
    fan = points.select("id", "p", F.posexplode(V.fixed(directions)).alias("k", "d"))
    hit = nearest_hit(fan.select(F.struct("id", "k").alias("ray"), F.col("p").alias("o"), "d"), triangles, cell=cell, reach=search).select("ray.id", "ray.k", "t")
    all_ = fan.join(hit, ["id", "k"], "left").withColumn("t", F.coalesce("t", F.lit(float(search))))
    return all_.groupBy("id").agg(F.min("t").alias("nearest"), F.max(F.struct(F.round("t", 9).alias("t"), (-F.col("k")).alias("k"))).alias("m")).select("id", "nearest", (-F.col("m.k")).alias("open"))


def points_clear(points: DataFrame, triangles: DataFrame, *, cell: float, reach: float, clearance: float, directions: Sequence[tuple[float, float, float]], digits: int = 5) -> DataFrame:
    """id, clear: a floor below and a ceiling above, and nothing within the clearance in any direction. Points alike in so many digits are probed once."""
    place = points.select("id", V.vec(*[F.bround(F.col("p")[c], digits) for c in "xyz"]).alias("p"))
    once = place.groupBy("p").agg(F.min("id").alias("id")).select("id", "p")
    both = once.select("id", "p", F.explode(F.array(F.lit(-1.0), F.lit(1.0))).alias("up"))
    shut = nearest_hit(both.select(F.struct("id", "up").alias("ray"), F.col("p").alias("o"), V.vec(0.0, 0.0, F.col("up")).alias("d")), triangles, cell=cell, reach=reach).groupBy("ray.id").count().where("count = 2").select("id")
    close = nearest_surface(once, triangles, directions, cell=cell, search=clearance).where(F.col("nearest") < clearance - 1e-9).select("id")
    fine = once.join(shut, "id", "left_semi").join(close, "id", "left_anti").select("p", F.lit(True).alias("fine"))
    return place.join(fine, "p", "left").select("id", F.coalesce("fine", F.lit(False)).alias("clear"))


def segments_clear(segments: DataFrame, triangles: DataFrame, *, cell: float, reach: float, radius: float, step: float = 0.15, sides: int = 8) -> DataFrame:
    """id, clear of segments (id, a, b): nothing meets the segment and those beside it on a tube of the radius, nor comes near samples at most `step` apart."""
    far = F.greatest(V.distance(F.col("a"), F.col("b")), F.lit(1e-12))
    along = V.mul(V.sub(F.col("b"), F.col("a")), 1 / far)
    helper = F.when(F.abs(along["z"]) < 0.9, V.vec(0, 0, 1)).otherwise(V.vec(1, 0, 0))
    s = segments.withColumn("far", far).withColumn("u", along).withColumn("v", V.normalize(V.cross(F.col("u"), helper))).withColumn("w", V.cross(F.col("u"), F.col("v")))
    ring = [V.vec(0, 0, 0)] + [V.add(V.mul(F.col("v"), radius * math.cos(2 * math.pi * k / sides)), V.mul(F.col("w"), radius * math.sin(2 * math.pi * k / sides))) for k in range(sides)]
    rays = s.select("id", "a", "u", "far", F.posexplode(F.array(*ring)).alias("k", "off")).select(F.struct("id", "k").alias("ray"), V.add(F.col("a"), F.col("off")).alias("o"), F.col("u").alias("d"), "far")
    met = nearest_hit(rays.select("ray", "o", "d"), triangles, cell=cell, reach=reach).join(s.select("id", "far").hint("merge"), F.col("ray.id") == F.col("id")).where("t < far").select("id")
    n = F.ceil(F.col("far") / step).cast("int")
    samples = s.select("id", "a", "b", F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: i / F.greatest(n, F.lit(2)))).alias("k", "f"))
    near = near_triangles(samples.select(F.struct("id", "k").alias("id"), V.lerp(F.col("a"), F.col("b"), F.col("f")).alias("p")), triangles, cell=cell, radius=radius).where(F.col("distance") < radius - 1e-9).select("id.id")
    bad = met.unionByName(near).distinct().withColumn("bad", F.lit(True))
    return segments.select("id").join(bad.hint("merge"), "id", "left").select("id", F.col("bad").isNull().alias("clear"))


# the scan of floors and free space


def columns(spark: SparkSession, box: dict[str, float], step: float, *, most: int = 100_000) -> DataFrame:
    """ix, iy, x, y of a raster over a box; an error above so many columns."""
    nx, ny = (math.ceil((box[f"high_{c}"] - box[f"low_{c}"]) / step - 1e-9) + 1 for c in "xy")
    if nx * ny > most:
        raise ValueError(f"{nx * ny} columns are more than {most}; hide what isn't needed or widen the step")
    i = F.col("id")
    return spark.range(nx * ny).select((i % nx).alias("ix"), F.floor(i / nx).alias("iy"), (box["low_x"] + (i % nx) * step).alias("x"), (box["low_y"] + F.floor(i / nx) * step).alias("y"))


def supports(grid: DataFrame, triangles: DataFrame, *, low: float, high: float, cell: float, least_up: float = 0.55, apart: float = 0.04, most_hits: int = 128, floors: Sequence[str] | None = None) -> DataFrame:
    """ix, iy, x, y, z of every floor below each column, from the top: surfaces that face up, each more than `apart` below the one before.

    floors: the owners that count, all if None. A column with more than most_hits
    surfaces is an error, as its scan isn't complete.
    """
    n = V.cross(V.sub(F.col("b"), F.col("a")), V.sub(F.col("c"), F.col("a")))
    t = triangles.withColumn("up", V.normalize(n)["z"])
    rays = grid.select(F.struct("ix", "iy", "x", "y").alias("ray"), V.vec(F.col("x"), F.col("y"), high + 0.5).alias("o"), V.vec(0.0, 0.0, -1.0).alias("d"))
    hits = ray_hits(rays, triangles, cell=cell, reach=high - low + 2).join(t.select("tri", "up"), "tri").withColumn("z", F.round(high + 0.5 - F.col("t"), 9)).where(F.col("z") >= low - 0.1)
    hits = hits.groupBy("ray", "z").agg(F.max("up").alias("up"), F.max(F.col("owner").isin(list(floors)) if floors is not None else F.lit(True)).alias("floor"))
    stack = hits.groupBy("ray").agg(F.sort_array(F.collect_list(F.struct("z", "up", "floor")), asc=False).alias("s"))
    ok = F.when(F.size("s") > most_hits, F.raise_error(F.lit("a column meets too many surfaces"))).otherwise(F.col("s"))
    keep = lambda a, h: F.when((h["up"] >= least_up) & h["floor"] & ((F.size(a) == 0) | (F.element_at(a, -1) - h["z"] > apart)), F.concat(a, F.array(h["z"]))).otherwise(a)
    kept = stack.select("ray", F.explode(F.aggregate(ok, F.array().cast("array<double>"), keep)).alias("z"))
    return kept.select("ray.ix", "ray.iy", "ray.x", "ray.y", "z")


def free_space(spark: SparkSession, triangles: DataFrame, box: dict[str, float], *, step: float, cell: float, headroom: float, clearance: float, reach: float, directions: Sequence[tuple[float, float, float]], max_rise: float = 0.36) -> DataFrame:
    """The walkable map: id, ix, iy, x, y, z, clearance, component (1 is the largest).

    Floors of all columns, less those with less than the headroom above and those
    nearer than the clearance to something at half the headroom; what is left falls
    into components over steps of at most max_rise.
    """
    floor = supports(columns(spark, box, step), triangles, low=box["low_z"], high=box["high_z"], cell=cell)
    floor = floor.withColumn("id", F.xxhash64("ix", "iy", F.round("z", 4)))
    up = nearest_hit(floor.select(F.col("id").alias("ray"), V.vec(F.col("x"), F.col("y"), F.col("z") + 1e-3).alias("o"), V.vec(0.0, 0.0, 1.0).alias("d")), triangles, cell=cell, reach=headroom).select(F.col("ray").alias("id"))
    high = floor.join(up, "id", "left_anti")
    at = high.select("id", V.vec(F.col("x"), F.col("y"), F.col("z") + headroom / 2).alias("p"))
    room = nearest_surface(at, triangles, directions, cell=cell, search=reach).where(F.col("nearest") >= clearance - 1e-9)
    cells = high.join(room.select("id", F.col("nearest").alias("clearance")), "id")
    parts = components_of(cells, grid_edges(cells, grid=step, max_rise=max_rise))
    return cells.join(parts.select(F.col("node").alias("id"), "component"), "id")


def level_directions(n: int = 20) -> list[tuple[float, float, float]]:
    """n even directions in the plane."""
    return [(math.cos(2 * math.pi * k / n), math.sin(2 * math.pi * k / n), 0.0) for k in range(n)]


def ball_directions(n: int = 60) -> list[tuple[float, float, float]]:
    """n directions of an even spiral on the sphere."""
    z = [1 - 2 * (k + 0.5) / n for k in range(n)]
    turn = math.pi * (3 - math.sqrt(5))
    return [(math.sqrt(1 - h * h) * math.cos(k * turn), math.sqrt(1 - h * h) * math.sin(k * turn), h) for k, h in enumerate(z)]


def pushed_out(cameras: DataFrame, triangles: DataFrame, *, cell: float, clearance: float, search: float, rounds: int = 10, drop: float = 0.5) -> DataFrame:
    """id, p, pushes, nearest of cameras (id, p) pushed along their most open direction until nothing is nearer than the clearance.

    At most `rounds` pushes of what is missing; cameras that stay nearer than drop
    times the clearance go.
    """
    from sightline.session import cut

    ways = ball_directions()
    fan = V.fixed(ways)
    now = cameras.select("id", "p", F.lit(0).alias("pushes"), F.lit(False).alias("done"))
    for _ in range(rounds + 1):
        found = nearest_surface(now.where("not done"), triangles, ways, cell=cell, search=search)
        step = now.join(found, "id", "left")
        short = F.col("nearest") < clearance - 1e-9
        now = cut(step.select("id", F.when(~F.col("done") & short & (F.col("pushes") < rounds), V.add(F.col("p"), V.mul(F.get(fan, F.col("open")), F.greatest(clearance - F.col("nearest"), F.lit(clearance * 0.25))))).otherwise(F.col("p")).alias("p"), (F.col("pushes") + F.when(~F.col("done") & short & (F.col("pushes") < rounds), 1).otherwise(0)).alias("pushes"), (F.col("done") | ~short | (F.col("pushes") >= rounds)).alias("done")))
        if now.where("not done").isEmpty():
            break
    last = nearest_surface(now, triangles, ways, cell=cell, search=search)
    return now.join(last, "id").where(F.col("nearest") >= drop * clearance).select("id", "p", "pushes", "nearest")


def wall(owner: Column, low: Column, high: Column) -> Column:
    """The twelve triangles of a box between two corners, as structs (owner, a, b, c), facing out."""
    quads = ((0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5))
    tris = F.from_json(F.lit(json.dumps([[q[0], q[i], q[i + 1]] for q in quads for i in (1, 2)])), "array<array<int>>")
    corner = lambda i: V.vec(*[F.when(F.shiftright(i, k).bitwiseAND(1) == 1, high[c]).otherwise(low[c]) for k, c in enumerate("xyz")])
    return F.transform(tris, lambda q: F.struct(owner.alias("owner"), *[corner(q[k]).alias(n) for k, n in enumerate("abc")]))
