"""Pixels as rows: splits by object, images written from them, textures sampled, frames checked.

A pixel row is (frame, u, v, ...) with u to the right and v down. Images are encoded
one a group, on executors.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import vectors as V
from sightline.operators.spatial import with_nearest_colour


def png(rows: list[bytes], width: int, bits: int, colour: int) -> bytes:
    """A PNG file of raw scan lines; colour: 0 grey, 2 RGB."""

    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, len(rows), bits, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows), 6)) + part(b"IEND", b"")


def images(pixels: DataFrame, *, group: Sequence[str], value: str, width: int, height: int, bits: int = 8) -> DataFrame:
    """group, content: a grey PNG of each group's pixels (u, v, value); places without a pixel are 0."""
    kept = pixels.select(*group, F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"), F.col(value).cast("int").alias("value"))
    kind = ">u2" if bits == 16 else "u1"

    def draw(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        canvas = np.zeros((height, width), kind)
        canvas[p.v.to_numpy(), p.u.to_numpy()] = p.value.to_numpy()
        return pd.DataFrame([[*key, png([r.tobytes() for r in canvas], width, bits, 0)]], columns=[*group, "content"])

    schema = ", ".join(f"`{g}` {kept.schema[g].dataType.simpleString()}" for g in group) + ", content binary"
    return kept.groupBy(*group).applyInPandas(draw, schema)


def split_by_object(pixels: DataFrame, legend: DataFrame, *, valid: Column | None = None, limit: float = 0.04) -> DataFrame:
    """The pixels (r, g, b: their id colour, ...) of visible objects with their object's name.

    A pixel belongs to the nearest of the legend's colours (position, name, r, g, b)
    below the limit. valid: a further condition, as a depth mask or an alpha above a
    half. Objects without pixels don't come out.
    """
    kept = pixels if valid is None else pixels.where(valid)
    found = with_nearest_colour(kept, legend, limit=limit).where("value > 0")
    named = legend.select((F.col("position") + 1).alias("value"), V.safe_name(F.col("name")).alias("object"))
    return found.join(named, "value").drop("value")


def flipped_ids(ids: DataFrame, legend: DataFrame, *, height: int, limit: float = 0.04) -> DataFrame:
    """u, v, value of an id image (u, v, r, g, b): the legend's place plus one below the limit, else -1, the rows turned over."""
    return with_nearest_colour(ids, legend, limit=limit).select("u", (height - 1 - F.col("v")).alias("v"), "value")


def bilinear(points: DataFrame, texels: DataFrame, sizes: DataFrame, *, channels: Sequence[str]) -> DataFrame:
    """points (id, image, s, t) with each channel at (s, t), the four texels around mixed; coordinates wrap.

    texels: (image, ix, iy, channels); sizes: (image, width, height). A point of an
    image without texels gets nulls.
    """
    at = points.join(sizes, "image", "left")
    wrap = lambda c, n: F.pmod(F.col(c), F.lit(1.0)) * F.greatest(F.lit(1), F.col(n) - 1)
    at = at.withColumn("fx", wrap("s", "width")).withColumn("fy", wrap("t", "height")).withColumn("x0", F.floor("fx")).withColumn("y0", F.floor("fy"))
    tap = lambda dx, dy: F.struct(F.least(F.col("x0") + dx, F.col("width") - 1).alias("ix"), F.least(F.col("y0") + dy, F.col("height") - 1).alias("iy"), (F.when(F.lit(dx == 1), F.col("fx") - F.col("x0")).otherwise(1 - (F.col("fx") - F.col("x0"))) * F.when(F.lit(dy == 1), F.col("fy") - F.col("y0")).otherwise(1 - (F.col("fy") - F.col("y0")))).alias("w"))
    taps = at.select(*points.columns, F.explode(F.array(*[tap(dx, dy) for dx in (0, 1) for dy in (0, 1)])).alias("k")).select(*points.columns, "k.*")
    near = taps.join(texels, ["image", "ix", "iy"]).groupBy("id").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in channels])
    return points.join(near, "id", "left")


def described(materials: DataFrame, sources: Sequence[str], *, defaults: dict) -> DataFrame:
    """name and each attribute: the first of its sources (source_attribute columns) that isn't null, else the default; procedural where no source has an image, packed where one is packed."""
    found = [F.coalesce(*[F.col(f"{s}_{a}") for s in sources if f"{s}_{a}" in materials.columns], F.lit(v)).alias(a) for a, v in defaults.items()]
    return materials.select("name", *found, F.col("image").isNull().alias("procedural"), F.coalesce("packed", F.lit(False)).alias("packed"))


def sampled_materials(points: DataFrame, materials: DataFrame, texels: DataFrame, sizes: DataFrame, *, defaults: dict) -> DataFrame:
    """points (id, material, s, t) with the material's attributes; a base colour from its texture where it has one, defaults where the material is unknown."""
    own = points.join(materials, "material", "left")
    plain = own.select("id", "material", "image", "s", "t", *[F.coalesce(F.col(a), F.lit(v)).alias(a) for a, v in defaults.items()])
    seen = bilinear(plain.where("image is not null").select("id", "image", "s", "t"), texels, sizes, channels=["r", "g", "b"]).select("id", *[F.col(c).alias(f"t_{c}") for c in "rgb"])
    return plain.join(seen, "id", "left").select("id", "material", *[F.coalesce(F.col(f"t_{a}"), F.col(a)).alias(a) if a in "rgb" else F.col(a) for a in defaults])


def frame_checks(frames: DataFrame, pixels: DataFrame, *, triangles: int, least_cover: float = 0.01) -> DataFrame:
    """frame, errors: what is wrong with each frame's pixels (frame, depth, alpha, nx, ny, nz, triangle).

    A frame without pixels is missing; depths must be finite and not negative,
    normals of opaque pixels of length one within 2 percent, triangles known, and
    enough pixels opaque.
    """
    long = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    opaque = F.col("alpha") > 0.5
    bad = pixels.groupBy("frame").agg(
        F.count(F.lit(1)).alias("n"), F.avg(opaque.cast("double")).alias("cover"), F.count_if(F.col("depth").isNull() | F.isnan("depth") | (F.col("depth") < 0) | (F.col("depth") == float("inf"))).alias("depths"),
        F.count_if(opaque & (F.abs(long - 1) > 0.02)).alias("normals"), F.count_if(opaque & ~F.col("triangle").between(0, triangles - 1)).alias("unknown"),
    )
    c = {"no pixels": F.col("n").isNull(), "depth": F.col("depths") > 0, "normal": F.col("normals") > 0, "triangle": F.col("unknown") > 0, "cover": F.col("cover") < least_cover}
    return frames.select("frame").join(bad, "frame", "left").select("frame", F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in c.items()])).alias("errors"))


def zipped(files: DataFrame, cameras: DataFrame, *, name: str = "name", camera: str = "camera", every: int = 8) -> DataFrame:
    """position, name, camera, split: sorted files beside sorted cameras, every so many to validation.

    Both sides are the names of frames, ordered by ranges with the counts of the
    ranges before them added; more files than cameras, or fewer, is an error when
    the plan runs.
    """

    def placed(rows: DataFrame, order: str, out: str) -> DataFrame:
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = rows.select(F.col(order).alias(out)).repartitionByRange(n, out).sortWithinPartitions(out).withColumn("at", F.monotonically_increasing_id())
        parts = parts.withColumn("part", F.shiftrightunsigned("at", 33)).withColumn("in_part", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
        sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        return parts.join(F.broadcast(before), "part").select((F.col("before") + F.col("in_part")).alias("position"), out)

    both = placed(files, name, "name").join(placed(cameras, camera, "camera"), "position", "full")
    checked = F.when(F.col("name").isNull() | F.col("camera").isNull(), F.raise_error(F.lit("files and cameras are not as many"))).otherwise(F.col("name"))
    return both.select("position", checked.alias("name"), "camera", F.when(F.col("position") % every == 0, "validation").otherwise("train").alias("split"))
