"""Binary little-endian PLY of float32 columns, as a writer and a reader.

Executors encode the rows of ordered partitions to bytes; the file is the header
and those bytes in the partitions' order, so it is streamed, never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of a splat file in their order.
SPLAT_COLUMNS = ("x", "y", "z", "nx", "ny", "nz", "f_dc_0", "f_dc_1", "f_dc_2", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3")


def encode(rows: DataFrame, columns: Sequence[str], order: Sequence[str], bytes_each: int = 4 << 20) -> DataFrame:
    """(part, piece, n, body): the rows' float32 bytes in order, in pieces of bounded size."""
    step = max(1, bytes_each // (4 * len(columns)))
    ordered = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    source = ordered.select(F.spark_partition_id().alias("part"), *[F.col(c).cast("float").alias(c) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = 0
        for b in batches:
            for at in range(0, b.num_rows, step):
                cut = b.slice(at, step)
                body = np.stack([c.to_numpy(zero_copy_only=False).astype("<f4") for c in cut.columns[1:]], 1).tobytes()
                yield pa.RecordBatch.from_arrays([cut.column(0).slice(0, 1), pa.array([piece], pa.int32()), pa.array([cut.num_rows], pa.int64()), pa.array([body], pa.binary())], names=["part", "piece", "n", "body"])
                piece += 1

    return source.mapInArrow(run, "part int, piece int, n long, body binary")


def header(count: int, columns: Sequence[str]) -> bytes:
    lines = ["ply", "format binary_little_endian 1.0", f"element vertex {count}", *[f"property float {c}" for c in columns], "end_header"]
    return ("\n".join(lines) + "\n").encode()


def write(rows: DataFrame, path: str, columns: Sequence[str] = SPLAT_COLUMNS, order: Sequence[str] = ("id",)) -> int:
    """Write one file at a path of the driver, through a temporary name; returns the rows written."""
    import os

    from sightline.session import cut

    pieces = cut(encode(rows, columns, order))
    count = pieces.agg(F.sum("n")).first()[0] or 0
    with open(f"{path}.tmp", "wb") as f:
        f.write(header(count, columns))
        for r in pieces.orderBy("part", "piece").toLocalIterator():
            f.write(r.body)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{path}.tmp", path)
    return count


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of PLY files (id by place, then the float columns), parsed on the executors."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 4096).alias("h")).first()
    if head is None:
        raise ValueError(f"no file at {path}")
    text = bytes(head.h).split(b"end_header\n")[0].decode()
    names = [x.split()[-1] for x in text.splitlines() if x.startswith("property float")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                body = content.as_py().split(b"end_header\n", 1)[1]
                v = np.frombuffer(body, "<f4").reshape(-1, len(names))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), *[pa.array(np.ascontiguousarray(v[:, i])) for i in range(len(names))]], names=["id", *names])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "id long, " + ", ".join(f"{n} float" for n in names))
