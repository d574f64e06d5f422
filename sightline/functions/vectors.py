"""Vectors as structs x, y, z, and the scalar functions built on them."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(x, y, z) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(n) for v, n in ((x, "x"), (y, "y"), (z, "z"))])


def fixed(points) -> Column:
    """Given points as an array of vectors: one literal, however many they are."""
    return F.from_json(F.lit(json.dumps([dict(zip("xyz", map(float, p), strict=True)) for p in points])), "array<struct<x:double,y:double,z:double>>")


def add(a: Column, b: Column) -> Column:
    return vec(a["x"] + b["x"], a["y"] + b["y"], a["z"] + b["z"])


def sub(a: Column, b: Column) -> Column:
    return vec(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def mul(a: Column, k: Column | float) -> Column:
    return vec(a["x"] * k, a["y"] * k, a["z"] * k)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return length(sub(a, b))


def normalize(a: Column) -> Column:
    """The unit vector; (1, 0, 0) for one of no length."""
    return let(F.struct(a.alias("a"), length(a).alias("n")), lambda k: F.when(k["n"] > 1e-12, mul(k["a"], 1 / k["n"])).otherwise(vec(1, 0, 0)))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return add(a, mul(sub(b, a), t))


def clamp(x: Column, lo, hi) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def angle(a: Column, b: Column) -> Column:
    """Radians between two vectors."""
    return F.acos(clamp(dot(normalize(a), normalize(b)), -1.0, 1.0))


def surface_key(object_: Column, face: Column, position: Column, normal: Column, cell: float) -> Column:
    """Object, face, the position's grid cell (half up) and the normal in eighths (half even)."""
    q = [F.floor(position[a] / cell + 0.5).cast("long").alias(f"p{a}") for a in "xyz"]
    n = [F.bround(normal[a] * 8).cast("long").alias(f"n{a}") for a in "xyz"]
    return F.struct(object_.alias("object"), face.alias("face"), *q, *n)


def origin_key(position: Column, tolerance: float) -> Column:
    return F.struct(*[F.bround(position[a] / tolerance).cast("long").alias(a) for a in "xyz"])


def surface_category(normal: Column, cone_degrees: float = 25.0) -> Column:
    """floor and ceiling within the cone of the vertical, vertical within it of the horizontal, else slanted."""
    c, s = math.cos(math.radians(cone_degrees)), math.sin(math.radians(cone_degrees))
    z = normal["z"]
    return F.when(z >= c, "floor").when(z <= -c, "ceiling").when(F.abs(z) <= s, "vertical").when(F.abs(z) < c, "slanted").otherwise("other")


def direction_bin(direction: Column, degrees: float = 15.0) -> Column:
    """Yaw and pitch of a direction in bins, half even."""
    size = math.radians(degrees)
    yaw = F.bround(F.pmod(F.atan2(direction["y"], direction["x"]), F.lit(2 * math.pi)) / size).cast("long")
    pitch = F.bround(F.asin(clamp(direction["z"], -1.0, 1.0)) / size).cast("long")
    return F.struct(yaw.alias("yaw"), pitch.alias("pitch"))


def look_angles(origin: Column, target: Column) -> Column:
    """Yaw and pitch from one point to another; 0 and 0 where they coincide."""
    d = sub(target, origin)
    n = length(d)
    ok = n > 1e-9
    return F.struct(F.when(ok, F.atan2(d["y"], d["x"])).otherwise(0.0).alias("yaw"), F.when(ok, F.asin(clamp(d["z"] / n, -1.0, 1.0))).otherwise(0.0).alias("pitch"))


def palette(score: Column) -> Column:
    """Red below a third, yellow below two thirds, else green."""
    return F.when(score < 1 / 3, "red").when(score < 2 / 3, "yellow").otherwise("green")


def group_hue(index: Column) -> Column:
    """Hues that stay apart, by the golden ratio."""
    return F.pmod(index * 0.618033988749895, F.lit(1.0))


def hsv_to_rgb(h: Column, s: float, v: float) -> Column:
    """r, g, b of a hue at fixed saturation and value."""

    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h * 6, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return F.struct(channel(5).alias("r"), channel(3).alias("g"), channel(1).alias("b"))


def project(point: Column, rows: list[list[float]], fx: float, fy: float, cx: float, cy: float) -> Column:
    """Pixel (u, v) of a world point through a world-to-camera matrix; null behind the camera."""
    c = [point["x"] * r[0] + point["y"] * r[1] + point["z"] * r[2] + r[3] for r in rows[:3]]
    ok = c[2] > 1e-9
    return F.struct(F.when(ok, fx * c[0] / c[2] + cx).alias("u"), F.when(ok, fy * c[1] / c[2] + cy).alias("v"), ok.alias("valid"))


def intrinsics(width: Column, height: Column, lens: Column, sensor: Column, aspect: Column) -> Column:
    """fx, fy, cx, cy for a sensor fitted to the larger side."""
    f = F.when(width >= height * aspect, width * lens / sensor).otherwise(height * aspect * lens / sensor)
    return F.struct(f.alias("fx"), (f / aspect).alias("fy"), (width / 2).alias("cx"), (height / 2).alias("cy"))


def quaternion(m: list[list[Column]]) -> Column:
    """w, x, y, z of a rotation matrix, from its largest diagonal term."""
    t = m[0][0] + m[1][1] + m[2][2]
    s0 = F.sqrt(F.greatest(t + 1, F.lit(1e-12))) * 2
    a = F.struct((s0 / 4).alias("w"), ((m[2][1] - m[1][2]) / s0).alias("x"), ((m[0][2] - m[2][0]) / s0).alias("y"), ((m[1][0] - m[0][1]) / s0).alias("z"))

    def lead(i: int, j: int, k: int) -> Column:
        s = F.sqrt(F.greatest(1 + m[i][i] - m[j][j] - m[k][k], F.lit(1e-12))) * 2
        parts = {"w": (m[k][j] - m[j][k]) / s, "xyz"[i]: s / 4, "xyz"[j]: (m[j][i] + m[i][j]) / s, "xyz"[k]: (m[k][i] + m[i][k]) / s}
        return F.struct(*[parts[n].alias(n) for n in "wxyz"])

    x, y, z = m[0][0], m[1][1], m[2][2]
    return F.when(t > 0, a).when((x > y) & (x > z), lead(0, 1, 2)).when(y > z, lead(1, 2, 0)).otherwise(lead(2, 0, 1))


def rotation(q: Column) -> list[list[Column]]:
    """The matrix of a unit quaternion."""
    w, x, y, z = (q[n] for n in "wxyz")
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def orientation_continuity(p: Column, q: Column) -> Column:
    """1 - angle / pi between two unit quaternions."""
    d = F.abs(sum((p[n] * q[n] for n in "xyz"), p["w"] * q["w"]))
    return 1 - 2 * F.acos(clamp(d, -1.0, 1.0)) / math.pi


def segment_distance_xy(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment in the plane."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n > 1e-12, clamp(((px - ax) * dx + (py - ay) * dy) / n, 0.0, 1.0)).otherwise(0.0)
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def triangle_area(a: Column, b: Column, c: Column) -> Column:
    return length(cross(sub(b, a), sub(c, a))) / 2


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def ray_triangle(origin: Column, direction: Column, a: Column, b: Column, c: Column) -> Column:
    """Distance along a ray to a triangle, null where it misses or meets it behind."""
    eps = 1e-9

    def solve(m: Column) -> Column:
        u, v, t = m["u"] / m["det"], m["v"] / m["det"], m["t"] / m["det"]
        return F.when((F.abs(m["det"]) > 1e-12) & (u >= -eps) & (v >= -eps) & (u + v <= 1 + eps) & (t > eps), t)

    def terms(k: Column) -> Column:
        return let(F.struct(dot(k["e1"], k["h"]).alias("det"), dot(k["s"], k["h"]).alias("u"), dot(k["d"], k["q"]).alias("v"), dot(k["e2"], k["q"]).alias("t")), solve)

    def crossed(e: Column) -> Column:
        return let(F.struct(e["e1"].alias("e1"), e["e2"].alias("e2"), e["s"].alias("s"), e["d"].alias("d"), cross(e["d"], e["e2"]).alias("h"), cross(e["s"], e["e1"]).alias("q")), terms)

    return let(F.struct(sub(b, a).alias("e1"), sub(c, a).alias("e2"), sub(origin, a).alias("s"), direction.alias("d")), crossed)


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    """Distance of a point from a segment in space."""

    def from_line(k: Column) -> Column:
        n = dot(k["d"], k["d"])
        return length(sub(k["s"], mul(k["d"], F.when(n > 1e-18, clamp(dot(k["s"], k["d"]) / n, 0.0, 1.0)).otherwise(0.0))))

    return let(F.struct(sub(b, a).alias("d"), sub(p, a).alias("s")), from_line)


def triangle_distance(p: Column, a: Column, b: Column, c: Column) -> Column:
    """Distance of a point from a triangle: to its plane where the foot lies inside, else to the nearest side."""

    def inner(k: Column) -> Column:
        nn = dot(k["n"], k["n"])
        side = lambda u, v: dot(cross(sub(v, u), sub(p, u)), k["n"]) >= 0
        return F.when((nn > 1e-18) & side(a, b) & side(b, c) & side(c, a), F.abs(dot(sub(p, a), k["n"])) / F.sqrt(nn))

    plane = let(F.struct(cross(sub(b, a), sub(c, a)).alias("n")), inner)
    return F.coalesce(plane, F.least(segment_distance(p, a, b), segment_distance(p, b, c), segment_distance(p, c, a)))


def depth_to_millimetres(metres: Column, hit: Column) -> Column:
    """16-bit depth: millimetres up to 65535, 0 for background."""
    return F.when(hit, clamp(F.floor(metres * 1000 + 0.5), 0, 65535)).otherwise(F.lit(0)).cast("int")


def normal_to_16bit(n: Column) -> Column:
    return F.floor(clamp((n + 1) / 2, 0.0, 1.0) * 65535 + 0.5).cast("int")


def duration(seconds: Column) -> Column:
    """H:MM:SS of whole seconds."""
    s = F.floor(F.greatest(seconds, F.lit(0))).cast("long")
    return F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), F.lpad(F.floor(s % 3600 / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def safe_name(name: Column) -> Column:
    """Letters, digits, _ . and - stay; runs of others become one underscore."""
    return F.trim(F.regexp_replace(name, r"[^A-Za-z0-9_.-]+", "_"), F.lit("_"))


def slug(name: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(name, r"[^A-Za-z0-9]+", "-")), F.lit("-"))


def numbered(prefix: str, index: Column, digits: int = 4) -> Column:
    return F.concat(F.lit(prefix), F.lpad(index.cast("string"), digits, "0"))


def trailing_number(name: Column) -> Column:
    return F.regexp_extract(name, r"([0-9]+)$", 1)
