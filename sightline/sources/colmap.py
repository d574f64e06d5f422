"""Text lines of a structure-from-motion dataset, and the cameras as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.order import placed


def with_profile(cameras: DataFrame, columns: list[str], order: str) -> DataFrame:
    """cameras with camera_id: one for each distinct set of the columns, numbered in first-seen order."""
    first = placed(cameras.groupBy(*columns).agg(F.min(order).alias("__first")), ["__first", *columns])
    return cameras.join(first.select(*columns, F.col("place").cast("int").alias("camera_id")), columns)


def _number(c: str):
    return F.format_string("%.10f", F.col(c).cast("double"))


def camera_lines(cameras: DataFrame) -> DataFrame:
    """A PINHOLE line for each camera_id (width, height, fx, fy, cx, cy)."""
    one = cameras.select("camera_id", "width", "height", "fx", "fy", "cx", "cy").distinct()
    return one.select("camera_id", F.concat_ws(" ", F.col("camera_id").cast("string"), F.lit("PINHOLE"), F.col("width").cast("string"), F.col("height").cast("string"), *[_number(c) for c in ("fx", "fy", "cx", "cy")]).alias("value"))


def image_lines(images: DataFrame) -> DataFrame:
    """Two lines for each image (image_id, qw..qz, tx..tz, camera_id, name): the pose, and an empty one."""
    pose = F.concat_ws(" ", F.col("image_id").cast("string"), *[_number(c) for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")], F.col("camera_id").cast("string"), "name")
    return images.select("image_id", F.posexplode(F.array(pose, F.lit(""))).alias("line", "value"))


def point_lines(points: DataFrame) -> DataFrame:
    """A line for each point (point_id, x, y, z, r, g, b)."""
    return points.select("point_id", F.concat_ws(" ", F.col("point_id").cast("string"), *[_number(c) for c in "xyz"], *[F.col(c).cast("string") for c in "rgb"], F.lit("0")).alias("value"))


def transforms(images: DataFrame) -> DataFrame:
    """One JSON row for each image: file path and 4 x 4 matrix (array of rows)."""
    return images.select("image_id", F.to_json(F.struct(F.concat(F.lit("images/"), "name").alias("file_path"), F.col("matrix").alias("transform_matrix"))).alias("value"))


def write_lines(lines: DataFrame, order: list[str], path: str) -> None:
    """The lines in order as text; range-partitioned files whose names keep the order."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)
