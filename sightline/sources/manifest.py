"""Control files of the driver: canonical JSON, fingerprints, snapshots that are used only if they still fit."""

from __future__ import annotations

import hashlib
import json
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def canonical(payload: Any) -> str:
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fingerprint(payload: Any) -> str:
    return hashlib.sha256(canonical(payload).encode()).hexdigest()


def short_signature(payload: Any) -> str:
    return hashlib.sha1(canonical(payload).encode()).hexdigest()[:16]


def write_json(path: str, payload: Any) -> None:
    """Through a temporary file, so that a reader sees the old or the new one."""
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(payload, f, ensure_ascii=False, indent=1)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{path}.tmp", path)


def read_json(path: str, default: Any = None) -> Any:
    """The file's content, or the default where there is none or it isn't JSON."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return default


def save_snapshot(df: DataFrame, path: str, inputs: Any) -> None:
    """df as Parquet with the inputs' fingerprint as its last commit."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    df.sparkSession.createDataFrame([(fingerprint(inputs),)], "fingerprint string").write.mode("overwrite").parquet(f"{path}/mark")


def load_snapshot(spark: SparkSession, path: str, inputs: Any) -> DataFrame | None:
    """The snapshot if its fingerprint is that of the inputs, else None."""
    from pyspark.errors import AnalysisException

    try:
        mark = spark.read.parquet(f"{path}/mark").first()
    except AnalysisException:
        return None
    return spark.read.parquet(f"{path}/data") if mark and mark.fingerprint == fingerprint(inputs) else None
