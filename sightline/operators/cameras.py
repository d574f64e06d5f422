"""Cameras: selection, matrices, intrinsics, frusta, rigs and the records made of them.

Matrices are arrays of 16 numbers, row by row.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions import vectors as V

#: The fields of an output configuration and what they are where a source lacks them.
OUTPUT_DEFAULTS: dict[str, Any] = {
    "rgb": True, "scene_depth": False, "object_depth": False, "scene_normal": False, "object_normal": False, "object_mask": False, "object_id": False, "material_id": False, "object_split_mode": "VIRTUAL",
}
#: The constant part of an output manifest.
MANIFEST_CONSTANTS: dict[str, Any] = {"normal_space": "world", "normal_format": "PNG_UINT16_RAW_RGB_ENCODED", "depth_space": "camera_view_z", "depth_unit": "meter", "depth_invalid_value": 0}
#: Names of two, three and four layers.
LAYER_NAMES = {2: ("Upper", "Lower"), 3: ("Upper", "Middle", "Lower"), 4: ("Upper", "Upper_Middle", "Lower_Middle", "Lower")}
SHRINK_STEPS = (1.0, 0.85, 0.70, 0.55, 0.40)
IDENTITY = (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)


def with_defaults(rows: DataFrame, defaults: Mapping[str, Any] = OUTPUT_DEFAULTS, keep: Sequence[str] = ()) -> DataFrame:
    """The columns of keep and one column for each default, in its order; a missing column or a null takes the default."""
    have = {c.lower() for c in rows.columns}
    return rows.select(*keep, *[(F.coalesce(F.col(n), F.lit(v)) if n.lower() in have else F.lit(v)).alias(n) for n, v in defaults.items()])


def output_manifest(configs: DataFrame, key: str) -> DataFrame:
    """key, manifest: the configuration, whether ids are needed inside, the constants and the passes, as JSON."""
    per_object = F.col("object_depth") | F.col("object_normal") | F.col("object_mask")
    physical = F.col("object_split_mode") == "PHYSICAL"
    passes = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in (("depth", F.col("scene_depth") | F.col("object_depth")), ("normal", F.col("scene_normal") | F.col("object_normal")), ("object_id", F.col("object_id") | per_object), ("rgb", F.col("rgb")))]))
    body = F.struct(*OUTPUT_DEFAULTS.keys(), (F.col("object_id") | per_object).alias("internal_object_id_used"), F.when(physical, "physical").otherwise("virtual").alias("split"), passes.alias("required_internal_passes"), *[F.lit(v).alias(n) for n, v in MANIFEST_CONSTANTS.items()])
    return configs.select(key, F.to_json(body).alias("manifest"))


def active(collection: DataFrame, scene: DataFrame, patch: DataFrame, *, name: str = "name") -> DataFrame:
    """The collection's cameras, all of the scene's where it has none, and the patch cameras not among them, by name.

    Whether the collection is empty is found out when the plan runs, by a left anti
    join on a constant, not by a job of its own.
    """
    marked = collection.select(F.lit(1).alias("__any")).limit(1)
    fallback = scene.withColumn("__one", F.lit(1)).join(marked, F.col("__one") == F.col("__any"), "left_anti").drop("__one")
    base = collection.unionByName(fallback)
    return base.unionByName(patch.join(base.select(name), name, "left_anti"))


def usable(cameras: DataFrame) -> DataFrame:
    """Perspective cameras that are neither previews nor temporary."""
    return cameras.where((F.col("kind") == "PERSP") & ~F.coalesce("preview", F.lit(False)) & ~F.coalesce("temporary", F.lit(False)))


def first_cameras(cameras: DataFrame, *, most: int, name: str = "name", selected: str = "selected", key: Sequence[str] = ()) -> DataFrame:
    """The selected cameras, or all where none is, first by name of those with one key, at most `most`, with dense new names."""
    any_ = cameras.where(selected).select(F.lit(True).alias("__any")).limit(1)
    chosen = cameras.where(selected).unionByName(cameras.withColumn("__one", F.lit(True)).join(any_, F.col("__one") == F.col("__any"), "left_anti").drop("__one"))
    if key:
        chosen = chosen.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(name))).where("__n = 1").drop("__n")
    first = chosen.orderBy(name).limit(most)  # a top-k: at most `most` rows are numbered
    return first.withColumn("index", F.row_number().over(Window.orderBy(name))).withColumn("new_name", F.concat(F.lit("Camera_"), F.lpad((F.col("index") - 1).cast("string"), 5, "0")))


# matrices


def matrix(*rows: Sequence[Column | float]) -> Column:
    """A matrix of three or four rows of four; a missing last row is 0 0 0 1."""
    cells = [v for r in rows for v in r] + ([0.0, 0.0, 0.0, 1.0] if len(rows) == 3 else [])
    return F.array(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double") for v in cells])


def multiply(a: Column, b: Column) -> Column:
    return V.let(F.struct(a.alias("a"), b.alias("b")), lambda k: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: sum((F.get(k["a"], F.floor(i / 4).cast("int") * 4 + j) * F.get(k["b"], F.lit(4 * j) + i % 4) for j in range(1, 4)), F.get(k["a"], F.floor(i / 4).cast("int") * 4) * F.get(k["b"], i % 4))))


def rigid_inverse(m: Column) -> Column:
    """The inverse of a rotation and a translation."""

    def inverse(k: Column) -> Column:
        e = lambda i, j: F.get(k, 4 * i + j)
        return matrix(*[[e(0, i), e(1, i), e(2, i), -(e(0, i) * e(0, 3) + e(1, i) * e(1, 3) + e(2, i) * e(2, 3))] for i in range(3)])

    return V.let(m, inverse)


def camera_to_world_opencv(m: Column) -> Column:
    """The axes y and z turned round."""
    return F.transform(m, lambda v, i: F.when((i % 4 == 1) | (i % 4 == 2), -v).otherwise(v))


def world_to_camera_opencv(m: Column) -> Column:
    return rigid_inverse(camera_to_world_opencv(m))


def blender_from_colmap(rotation: Sequence[Sequence[Column]], t: Sequence[Column]) -> Column:
    """camera-to-world of a world-to-camera rotation and translation with y down and z forward."""
    m = matrix(*[[*rotation[i], t[i]] for i in range(3)])
    return camera_to_world_opencv(rigid_inverse(m))


def are_inverse(a: Column, b: Column, tolerance: float = 1e-7) -> Column:
    return F.forall(F.arrays_zip(multiply(a, b).alias("m"), F.array(*[F.lit(v) for v in IDENTITY]).alias("i")), lambda x: F.abs(x["m"] - x["i"]) <= tolerance)


def pose_errors(actual: Column, wanted: Column) -> Column:
    """Distance of the places and angle of the rotations of two matrices."""

    def errors(k: Column) -> Column:
        p = [F.get(k["a"], 4 * i + 3) - F.get(k["b"], 4 * i + 3) for i in range(3)]
        trace = sum((F.get(k["a"], 4 * i + j) * F.get(k["b"], 4 * i + j) for i in range(3) for j in range(3)), F.lit(0.0))
        return F.struct(F.sqrt(p[0] * p[0] + p[1] * p[1] + p[2] * p[2]).alias("position"), F.acos(V.clamp((trace - 1) / 2, -1.0, 1.0)).alias("rotation"))

    return V.let(F.struct(actual.alias("a"), wanted.alias("b")), errors)


def pose_matches(actual: Column, wanted: Column, position: float = 1e-6, rotation: float = 1e-5) -> Column:
    return V.let(pose_errors(actual, wanted), lambda e: (e["position"] <= position) & (e["rotation"] <= rotation))


# intrinsics and frusta


def camera_parameters(kind: Column, panorama: Column, width: Column, height: Column, lens: Column, sensor: Column, vertical_fit: Column, sensor_height: Column, fov: Column, shift_x: Column, shift_y: Column) -> Column:
    """fx, fy, cx, cy of panoramic (equirectangular or fisheye) and perspective cameras; shifts move the centre of perspective ones alone."""
    pano, equi = kind == "PANO", panorama == "EQUIRECTANGULAR"
    f = F.when(vertical_fit, lens / sensor_height * height).otherwise(lens / sensor * width)
    fish = F.greatest(F.coalesce(fov, F.lit(math.pi)), F.lit(1e-6))
    fx = F.when(pano & equi, width / (2 * math.pi)).when(pano, width / fish).otherwise(f)
    fy = F.when(pano & equi, height / math.pi).when(pano, height / fish).otherwise(f)
    cx, cy = width * 0.5 - F.when(pano, 0.0).otherwise(shift_x) * width, height * 0.5 + F.when(pano, 0.0).otherwise(shift_y) * height
    return F.struct(fx.alias("fx"), fy.alias("fy"), cx.alias("cx"), cy.alias("cy"))


def frusta(cameras: DataFrame, *, scale: float = 1.0, margin: float = 0.03) -> DataFrame:
    """camera, origin, world_to_camera, x0, x1, y0, y1, near, far of perspective cameras: the tangent bounds drawn in by a margin of their span."""
    c = usable(cameras.withColumns({"preview": F.lit(False), "temporary": F.lit(False)}))
    x0, x1 = -F.col("cx") / F.col("fx"), (F.col("width") - F.col("cx")) / F.col("fx")
    y0, y1 = (F.col("cy") - F.col("height")) / F.col("fy"), F.col("cy") / F.col("fy")
    m = F.col("camera_to_world")
    origin = V.vec(*[F.get(m, 4 * i + 3) * scale for i in range(3)])
    return c.select("camera", origin.alias("origin"), rigid_inverse(m).alias("world_to_camera"), (x0 + (x1 - x0) * margin).alias("x0"), (x1 - (x1 - x0) * margin).alias("x1"), (y0 + (y1 - y0) * margin).alias("y0"), (y1 - (y1 - y0) * margin).alias("y1"), "near", "far")


def in_frustum(point: Column) -> Column:
    """Whether a world point is between the clips and tangent bounds of a frustum's columns; the camera looks along -z."""
    m = F.col("world_to_camera")
    local = F.struct(*[(F.get(m, 4 * i) * point["x"] + F.get(m, 4 * i + 1) * point["y"] + F.get(m, 4 * i + 2) * point["z"] + F.get(m, 4 * i + 3)).alias(n) for i, n in enumerate("xyz")])
    inside = lambda p: (-p["z"] >= F.col("near")) & (-p["z"] <= F.col("far")) & (p["x"] / -p["z"]).between(F.col("x0"), F.col("x1")) & (p["y"] / -p["z"]).between(F.col("y0"), F.col("y1"))
    return F.coalesce(V.let(local, inside), F.lit(False))


def camera_record(cameras: DataFrame) -> DataFrame:
    """camera, record: the nested record of a camera, numbered by name."""
    c = cameras.withColumn("index", F.row_number().over(Window.orderBy("camera")) - 1)
    record = F.struct("index", F.struct("width", "height").alias("size"), F.struct("fx", "fy", "cx", "cy").alias("intrinsics"), F.col("camera_to_world"), world_to_camera_opencv(F.col("camera_to_world")).alias("world_to_camera"))
    return c.select("camera", record.alias("record"))


# paths, layers and rigs


def stable_forward(stations: DataFrame, *, curve: str, order: str, least: float = 1e-8) -> DataFrame:
    """stations with `forward`: the level tangent (tx, ty); where it has no length the way from the station before to the one behind, of one curve; else (0, 1)."""
    w = Window.partitionBy(curve).orderBy(order)
    way = []
    for a, tangent in (("x", "tx"), ("y", "ty")):
        before, after = F.coalesce(F.lag(a).over(w), F.col(a)), F.coalesce(F.lead(a).over(w), F.col(a))
        way.append((F.col(tangent), after - before))
    own, chord = F.hypot(way[0][0], way[1][0]), F.hypot(way[0][1], way[1][1])
    parts = [F.when(own >= least, t / own).when(chord >= least, c / chord).otherwise(F.lit(d)).alias(n) for n, (t, c), d in zip("xy", way, (0.0, 1.0), strict=True)]
    return stations.withColumn("forward", F.struct(*parts))


def shell_radii(requested: float, least: float, *, adaptive: bool = True, steps: Sequence[float] = SHRINK_STEPS) -> list[float]:
    """Radii to try, from the requested one down to the least, each once."""
    requested = max(0.0, requested)
    least = min(requested, max(0.0, least))
    values = [requested * f for f in steps if requested * f + 1e-9 >= least] if adaptive else [requested]
    if adaptive and (not values or abs(values[-1] - least) > 1e-9):
        values.append(least)
    return [v for i, v in enumerate(values) if not i or abs(values[i - 1] - v) > 1e-9]


def layers(spark: SparkSession, count: int, offsets: Sequence[float]) -> DataFrame:
    """layer, name, offset of two to four layers from the top."""
    return spark.createDataFrame([(i, LAYER_NAMES[count][i], float(offsets[i])) for i in range(count)], "layer int, name string, offset double")


def icosahedron() -> list[tuple[float, float, float]]:
    """The unit directions of the twelve corners: every sign of (0, 1, p), turned through the axes, p being the golden ratio."""
    p = (1 + math.sqrt(5)) / 2
    n = math.hypot(1, p)
    flat = [(s, t * p) for s in (1, -1) for t in (1, -1)]
    corners = [(0.0, a, b) for a, b in flat] + [(a, b, 0.0) for a, b in flat] + [(b, 0.0, a) for b in (p, -p) for a in (1, -1)]
    return [(x / n, y / n, z / n) for x, y, z in corners]


def shell_group(stations: DataFrame, radius: Column) -> DataFrame:
    """stations times twelve directions on a shell: slot, direction, position."""
    ways = F.array(*[F.struct(F.lit(i).alias("slot"), V.vec(*d).alias("direction")) for i, d in enumerate(icosahedron())])
    rows = stations.select("*", F.explode(ways).alias("__w")).select(*stations.columns, "__w.slot", "__w.direction")
    return rows.withColumn("position", V.add(V.vec(F.col("x"), F.col("y"), F.col("z")), V.mul(F.col("direction"), radius)))


def path_camera_count(length: Column, *, count: int, density: float | None, most: int) -> Column:
    """A fixed count, or the length times a density, up to `most`; a path of no length has the fixed one."""
    fixed = F.lit(max(1, count))
    return fixed if density is None else F.when(length <= 1e-6, fixed).otherwise(F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(length * density))))


def axis_values(low: Column, high: Column, step: float) -> Column:
    """Evenly spaced places from the middle of an interval outwards, both ends' margins alike; the middle of an empty one."""
    step = max(0.05, step)
    n = F.greatest(F.lit(1), F.floor((high - low) / step)).cast("int")
    start = (low + high - n * step) / 2
    return F.when(high <= low + 1e-6, F.array((low + high) / 2)).otherwise(F.transform(F.sequence(F.lit(0), n), lambda i: start + i * step))


def seed_candidates(seeds: DataFrame, *, horizontal_fov: float, pitches: Sequence[float], polar: Sequence[float] = (55.0, -55.0)) -> DataFrame:
    """Candidates of each seed (origin, yaw, pitch, allow_polar, polar_yaw): itself, every yaw with every pitch, and the polar views.

    Yaws are as many as steps of 0.4 of the field of view, 30 degrees at most, fill a turn.
    """
    n = max(1, math.ceil(2 * math.pi / min(math.radians(30.0), horizontal_fov * 0.4) - 1e-12))
    part = lambda kind, yaw, pitch, name: F.struct(F.lit(kind).alias("kind"), yaw.alias("yaw"), pitch.alias("pitch"), name.alias("name"))
    base = F.array(part("base", F.col("yaw"), F.col("pitch"), F.lit("BASE")))
    turns = [part("turn", F.lit(k * 2 * math.pi / n), F.lit(math.radians(p)), F.lit(f"Y{k:02d}_P{p:+.0f}")) for k in range(n) for p in pitches]
    poles = [part("polar", F.col("polar_yaw"), F.lit(math.radians(p)), F.lit(f"POLAR{p:+.0f}")) for p in polar]
    every = F.concat(base, F.array(*turns), F.when(F.col("allow_polar"), F.array(*poles)).otherwise(F.slice(F.array(*poles), 1, 0)))
    return seeds.select("origin", F.explode(every).alias("c")).select("origin", F.concat_ws("_", F.col("origin").cast("string"), F.col("c.name")).alias("candidate"), "c.kind", "c.yaw", "c.pitch")


def rig(spark: SparkSession, shape: str, *, count: int = 24, rings: int = 3, radius: float = 1.0, height: float = 2.0, size: tuple[int, int, int] = (3, 3, 3), spacing: float = 1.0, jitter: float = 0.0, seed: int = 0) -> DataFrame:
    """index, x, y, z of a rig around the origin: sphere, hemisphere, cylinder, half_cylinder, grid (with a seeded jitter) or cube.

    Sphere and hemisphere are even spirals; cylinders have `rings` of count places; a
    cube has the six faces' middles at radius. Rigs along paths and from existing
    cameras are stations and rows already.
    """
    i = F.col("index").cast("double")
    if shape in ("sphere", "hemisphere"):
        z = 1 - 2 * (i + 0.5) / count if shape == "sphere" else 1 - (i + 0.5) / count
        r, a = F.sqrt(F.greatest(F.lit(0.0), 1 - z * z)), i * (math.pi * (3 - math.sqrt(5)))
        rows, place = spark.range(count), (r * F.cos(a) * radius, r * F.sin(a) * radius, z * radius)
    elif shape in ("cylinder", "half_cylinder"):
        full = shape == "cylinder"
        a = (i % count) * ((2 * math.pi / count) if full else (math.pi / max(1, count - 1)))
        level = F.floor(i / count) / max(1, rings - 1) - 0.5
        rows, place = spark.range(count * rings), (F.cos(a) * radius, F.sin(a) * radius, level * height)
    elif shape == "grid":
        nx, ny, nz = size
        cell = (F.col("index") % nx, F.floor(F.col("index") / nx) % ny, F.floor(F.col("index") / (nx * ny)))
        shake = [(F.pmod(F.xxhash64(F.lit(seed), F.lit(axis), F.col("index")), F.lit(1_000_003)) / 1_000_003.0 - 0.5) * (2 * jitter) for axis in range(3)]
        rows, place = spark.range(nx * ny * nz), tuple((c - (n - 1) / 2 + s) * spacing for c, n, s in zip(cell, size, shake, strict=True))
    elif shape == "cube":
        sign = F.when(F.col("index") % 2 == 0, radius).otherwise(-radius)
        rows, place = spark.range(6), tuple(F.when(F.floor(F.col("index") / 2) == k, sign).otherwise(0.0) for k in range(3))
    else:
        raise ValueError(f"no rig of shape {shape}")
    return rows.select(F.col("id").alias("index")).select("index", *[p.cast("double").alias(n) for n, p in zip("xyz", place, strict=True)])


def update_where(rows: DataFrame, changes: Mapping[str, Column], condition: Column) -> DataFrame:
    """rows with the columns of changes replaced where a condition holds."""
    return rows.withColumns({n: F.when(condition, v).otherwise(F.col(n)) for n, v in changes.items()})
