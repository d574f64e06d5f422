"""What a dataset is handed over as: splats of all parts in one file with its description, and a pose sequence."""

from __future__ import annotations

import os
from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import vectors as V
from sightline.sources import ply
from sightline.sources.manifest import canonical, write_json

#: The first spherical harmonic, and how the file's columns are encoded.
HARMONIC = 0.28209479177387814
ENCODING = {"schema_version": "1.0", "coordinate_system": "world: +X right, +Y forward, +Z up", "quaternion_order": "wxyz", "scale_encoding": "linear_world", "opacity_encoding": "logit", "color_encoding": "linear_rgb", "sh_encoding": "3dgs_real_sh", "surface_normal_space": "world", "gaussian_normal_axis": "local_z"}


def splats(parts: Sequence[DataFrame], *, thickness: float = 0.05) -> DataFrame:
    """id and the columns of a splat file for all parts (id, x, y, z, r, g, b, alpha, spacing; tangent, bitangent, normal: structs) together.

    A splat is half a spacing wide and a share of that thick, in logarithms; its
    opacity is a logit held 1e-4 from the ends.
    """
    if not parts:
        raise ValueError("there are no parts to merge")
    s = reduce(lambda a, b: a.unionByName(b), parts)
    alpha = V.clamp(F.col("alpha"), 1e-4, 1 - 1e-4)
    wide = F.ln(F.greatest(F.col("spacing"), F.lit(1e-12)) / 2)
    turn = V.quaternion([[F.col(n)[x] for n in ("tangent", "bitangent", "normal")] for x in "xyz"])
    colour = [((F.col(c) - 0.5) / HARMONIC).alias(f"f_dc_{i}") for i, c in enumerate("rgb")]
    s = s.withColumn("__q", turn)
    return s.select("id", "x", "y", "z", *[F.col("normal")[x].alias(f"n{x}") for x in "xyz"], *colour, F.ln(alpha / (1 - alpha)).alias("opacity"), wide.alias("scale_0"), wide.alias("scale_1"), (wide + F.ln(F.lit(thickness))).alias("scale_2"), *[F.col("__q")[n].alias(f"rot_{i}") for i, n in enumerate("wxyz")])


def merge_and_export(parts: Sequence[DataFrame], folder: str, *, thickness: float = 0.05, unit_metres: float = 1.0, table: str | None = None) -> dict[str, Any]:
    """Write the merged splats as one PLY file with its description in a folder of the driver, and as a Parquet table where one is named (on a cluster: a shared path); returns their count and places."""
    merged = splats(parts, thickness=thickness)
    if table:
        merged.write.mode("overwrite").parquet(table)
        merged = merged.sparkSession.read.parquet(table)
    os.makedirs(folder, exist_ok=True)
    file, about = os.path.join(folder, "init_gaussians.ply"), os.path.join(folder, "init_gaussians.metadata.json")
    count = ply.write(merged, file)
    write_json(about, {**ENCODING, "world_unit_to_meters": float(unit_metres), "count": count})
    return {"count": count, "ply": file, "metadata": about, "table": table}


def save_sequence(sequence: dict[str, Any], path: str | None) -> str:
    """The sequence as canonical JSON text, also written to a path of the driver where one is given."""
    if path:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        write_json(path, sequence)
    return canonical(sequence)
