"""Spatial joins by grid buckets, with exact predicates behind them."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import vectors as V


def _around(axes: Sequence[str]) -> Column:
    """All offsets of -1, 0, 1 in each axis, as an array of structs o0, o1, ..."""
    offsets = itertools.product((-1, 0, 1), repeat=len(axes))
    return F.array(*[F.struct(*[F.lit(v).alias(f"o{j}") for j, v in enumerate(o)]) for o in offsets])


def radius_join(left: DataFrame, right: DataFrame, radius: float, axes: Sequence[str] = ("x", "y", "z"), *, spread: str = "left") -> DataFrame:
    """Pairs of rows at most radius apart, with their distance2; both sides have the axes' columns.

    One side's rows go to their grid buckets and the other's, the spread one's, to the
    buckets around their own, so the join is an equi-join and one bucket's rows meet
    only theirs. The spread side should be the one with fewer rows. The sides are
    merged: a broadcast would be judged by the size before the rows are spread.
    """
    k = range(len(axes))
    own = lambda side: side.select("*", *[F.floor(F.col(x) / radius).cast("long").alias(f"__b{i}") for i, x in enumerate(axes)])
    around = lambda side: side.withColumn("__o", F.explode(_around(axes))).select(*side.columns, *[(F.floor(F.col(x) / radius).cast("long") + F.col(f"__o.o{i}")).alias(f"__b{i}") for i, x in enumerate(axes)])
    a, b = (around(left), own(right)) if spread == "left" else (own(left), around(right))
    a = a.withColumnsRenamed({c: f"l_{c}" for c in left.columns})
    b = b.withColumnsRenamed({c: f"r_{c}" for c in right.columns})
    d2 = sum((F.pow(F.col(f"l_{x}") - F.col(f"r_{x}"), 2) for x in axes[1:]), F.pow(F.col(f"l_{axes[0]}") - F.col(f"r_{axes[0]}"), 2))
    return a.join(b.hint("merge"), [f"__b{i}" for i in k]).withColumn("distance2", d2).where(F.col("distance2") <= radius * radius).drop(*[f"__b{i}" for i in k])


def nearest(pairs: DataFrame, key: str, order: Sequence[Column | str], k: int = 1) -> DataFrame:
    """Of each key's candidate pairs the first k by order."""
    w = Window.partitionBy(key).orderBy(*order)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_to_queries(queries: DataFrame, rows: DataFrame, *, query: str, row: str, vector: str, k: int, block: int = 20_000) -> DataFrame:
    """The k rows nearest to each of a stated set of queries, ties by row id.

    Queries are counted and sent to all rows' partitions in blocks of about `block`, by
    a hash of their id, so what is broadcast at once doesn't grow with their number; a
    block costs one pass over the rows. Each partition's rows are cut to a top k a
    query before they meet.
    """
    q = queries.select(F.col(query).alias("q"), F.col(vector).alias("qv"))
    blocks = max(1, -(-q.count() // block))
    d2 = F.aggregate(F.zip_with("qv", F.col(vector), lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    out = None
    for b in range(blocks):
        own = F.broadcast(q.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b) if blocks > 1 else q)
        pairs = rows.select(F.col(row).alias("r"), F.col(vector)).join(own, F.col("q") != F.col("r")).select("q", "r", d2.alias("d2"))
        best = nearest(pairs, "q", ["d2", "r"], k).select("q", "r", "rank", F.round("d2", 6).alias("d2"))
        out = best if out is None else out.unionByName(best)
    return out


def with_nearest_colour(pixels: DataFrame, legend: DataFrame, *, limit: float = 0.04) -> DataFrame:
    """pixels (r, g, b, ...) with value: the nearest legend entry's (position, r, g, b) place plus one where its squared distance is below the limit, the first of equals, else -1.

    Distinct colours meet the legend in buckets as wide as the limit; no row is
    broadcast, and repeated pixels each come out.
    """
    near = radius_join(pixels.select("r", "g", "b").distinct(), legend.select("position", "r", "g", "b"), limit**0.5, ("r", "g", "b")).where(F.col("distance2") < limit)
    best = near.groupBy(*[F.col(f"l_{c}").alias(f"__{c}") for c in "rgb"]).agg((F.min(F.struct("distance2", F.col("r_position").alias("position")))["position"] + 1).alias("value"))
    both = pixels.join(best, [F.col(c) == F.col(f"__{c}") for c in "rgb"], "left")
    return both.select(*pixels.columns, F.coalesce("value", F.lit(-1)).alias("value"))


def nearest_colour(pixels: DataFrame, legend: DataFrame, *, limit: float = 0.04) -> DataFrame:
    """(id, value) of with_nearest_colour, a row for each pixel (id, r, g, b)."""
    return with_nearest_colour(pixels, legend, limit=limit).select("id", "value")


def ray_hits(rays: DataFrame, triangles: DataFrame, *, cell: float, reach: float) -> DataFrame:
    """Every triangle that each ray (ray, o, d) meets within reach, once: ray, tri, owner, t.

    A ray goes to the cells of its places at half-cell steps. Any hit is at most a
    quarter of a cell from such a place, so triangles (tri, owner, a, b, c) go to the
    cells of their boxes grown by that. A pair found in several cells is tested alike
    and comes out once.
    """
    t = _in_cells(triangles, cell, cell * 0.2501)
    r = rays.select("ray", "o", V.normalize(F.col("d")).alias("u"))
    steps = F.sequence(F.lit(0), F.lit(int(reach / (cell / 2)) + 1))
    at = lambda s, x: F.floor((F.col("o")[x] + F.col("u")[x] * (s * (cell / 2))) / cell).cast("long")
    passed = F.array_distinct(F.transform(steps, lambda s: F.struct(*[at(s, x).alias(f"g{x}") for x in "xyz"])))
    r = r.select("ray", "o", "u", F.explode(passed).alias("g")).select("ray", "o", "u", "g.*")
    hit = r.join(t.hint("merge"), ["gx", "gy", "gz"]).withColumn("t", V.ray_triangle(F.col("o"), F.col("u"), F.col("a"), F.col("b"), F.col("c"))).where(F.col("t") <= reach)
    return hit.groupBy("ray", "tri", "owner").agg(F.min("t").alias("t"))


def _in_cells(triangles: DataFrame, cell: float, margin: float) -> DataFrame:
    """Triangles once for every grid cell gx, gy, gz that their boxes, grown by a margin, touch."""
    for x, name in zip("xyz", ("gx", "gy", "gz"), strict=True):
        lo, hi = F.least(*[F.col(v)[x] for v in "abc"]) - margin, F.greatest(*[F.col(v)[x] for v in "abc"]) + margin
        triangles = triangles.withColumn(name, F.explode(F.sequence(F.floor(lo / cell).cast("long"), F.floor(hi / cell).cast("long"))))
    return triangles


def nearest_hit(rays: DataFrame, triangles: DataFrame, *, cell: float, reach: float) -> DataFrame:
    """The nearest triangle that each ray (ray, o, d) meets within reach: ray, tri, owner, t; of equal distances the lesser tri wins."""
    hit = ray_hits(rays, triangles, cell=cell, reach=reach)
    return hit.groupBy("ray").agg(F.min(F.struct("t", "tri", "owner")).alias("m")).select("ray", "m.tri", "m.owner", "m.t")


def visible(segments: DataFrame, triangles: DataFrame, *, cell: float, reach: float, tolerance: float) -> DataFrame:
    """Segments (ray, o, target) whose first hit isn't nearer than the target less the tolerance."""
    rays = segments.select("ray", "o", V.sub(F.col("target"), F.col("o")).alias("d"), V.distance(F.col("o"), F.col("target")).alias("far"))
    hit = nearest_hit(rays.select("ray", "o", "d"), triangles, cell=cell, reach=reach)
    return rays.join(hit, "ray", "left").select("ray", (F.col("t").isNull() | (F.col("t") >= F.col("far") - tolerance)).alias("visible"))


def near_triangles(points: DataFrame, triangles: DataFrame, *, cell: float, radius: float) -> DataFrame:
    """id, tri, owner, distance of the triangles within radius of each point (id, p).

    A triangle goes to the cells of its box grown by the radius, a point to its own
    cell, so each pair meets once.
    """
    own = points.select("id", "p", *[F.floor(F.col("p")[x] / cell).cast("long").alias(n) for x, n in zip("xyz", ("gx", "gy", "gz"), strict=True)])
    pairs = own.join(_in_cells(triangles, cell, radius), ["gx", "gy", "gz"])
    return pairs.select("id", "tri", "owner", V.triangle_distance(F.col("p"), F.col("a"), F.col("b"), F.col("c")).alias("distance")).where(F.col("distance") <= radius)


def inside_solid(points: DataFrame, triangles: DataFrame, directions: Sequence[tuple[float, float, float]], *, cell: float, reach: float) -> DataFrame:
    """id, owner of the points (id, p) inside a closed mesh: an odd number of its triangles on most of the rays in the directions.

    reach must be the mesh's longest extent at least. Each owner is a mesh of its own.
    """
    rays = points.select("id", F.posexplode(V.fixed(directions)).alias("k", "d"), F.col("p").alias("o")).select(F.struct("id", "k").alias("ray"), "o", "d")
    odd = ray_hits(rays, triangles, cell=cell, reach=reach).groupBy("ray", "owner").agg((F.count(F.lit(1)) % 2 == 1).alias("odd"))
    return odd.where("odd").groupBy("ray.id", "owner").count().where(2 * F.col("count") > len(directions)).select("id", "owner")


def adequate(views: DataFrame, *, target: str, pos: str, at: str, baseline: float = 0.12, degrees: float = 12.0) -> DataFrame:
    """Whether some two views of a target are at least a baseline and an angle apart."""
    v = F.array_agg(F.struct(F.col(pos).alias("o"), F.col(at).alias("t")))
    far = lambda a, b: (V.distance(a["o"], b["o"]) >= baseline) & (V.angle(V.sub(a["o"], a["t"]), V.sub(b["o"], b["t"])) >= F.radians(F.lit(degrees)))
    return views.groupBy(target).agg(v.alias("v")).select(target, F.exists("v", lambda a: F.exists("v", lambda b: far(a, b))).alias("adequate"))


def greedy_independent(views: DataFrame, *, target: str, order: str, pos: str, at: str, baseline: float, degrees: float, most: int) -> DataFrame:
    """How many views of each target stay when one is kept only if it is at least a baseline and an angle, as seen from the target, from all kept before, in order, up to `most`."""
    v = F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), F.col(pos).alias("o"), V.sub(F.col(pos), F.col(at)).alias("n"))))
    kind = views.select(F.array(F.struct(F.col(order).alias("i"), F.col(pos).alias("o"), V.sub(F.col(pos), F.col(at)).alias("n"))).alias("v")).schema["v"].dataType
    far = lambda k, w: (V.distance(k["o"], w["o"]) >= baseline) & (V.dot(k["n"], w["n"]) <= V.length(k["n"]) * V.length(w["n"]) * F.cos(F.radians(F.lit(degrees))))
    step = lambda a, w: F.when((F.size(a) < most) & F.forall(a, lambda k: far(k, w)), F.concat(a, F.array(w))).otherwise(a)
    return views.groupBy(target).agg(v.alias("v")).select(target, F.aggregate("v", F.array().cast(kind), step, lambda a: F.size(a)).alias("kept"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """added, removed or changed keys between two snapshots."""
    a, b = old.select(key, F.col(value).alias("a"), F.lit(1).alias("ina")), new.select(key, F.col(value).alias("b"), F.lit(1).alias("inb"))
    kind = F.when(F.col("ina").isNull(), "added").when(F.col("inb").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, key, "full").select(key, kind.alias("change")).where("change is not null")


def barycentric(p: Column, a: Column, b: Column, c: Column) -> Column:
    """Weights of a triangle's corners at a point in its plane."""
    n = V.cross(V.sub(b, a), V.sub(c, a))
    d = V.dot(n, n)
    w = lambda u, v: V.dot(V.cross(V.sub(v, u), V.sub(p, u)), n) / d
    return F.struct(w(b, c).alias("a"), w(c, a).alias("b"), w(a, b).alias("c"))
