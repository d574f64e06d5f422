"""Streams: points recorded by distance, and frames processed in resumable chunks."""

from __future__ import annotations

import math
import os
import subprocess
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, seq long, x double, y double, z double"


def record(points: DataFrame, least: float) -> DataFrame:
    """Of a stream of points (key, seq, x, y, z) those at least `least` from the last kept one of their key.

    The state is one point a key. Within a micro-batch points go in the order of seq;
    late ones are judged against the point kept last.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(pdfs)).sort_values("seq", kind="stable")
        last = state.get if state.exists else None
        kept = []
        for i, p in enumerate(rows[["x", "y", "z"]].itertuples(index=False)):
            if last is None or math.dist(p, last) >= least:
                kept.append(i)
                last = tuple(float(v) for v in p)
        if last is not None:
            state.update(last)
        yield rows.iloc[kept][["key", "seq", "x", "y", "z"]]

    return points.groupBy("key").applyInPandasWithState(step, OUT, "x double, y double, z double", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; a second run goes on where this one ended."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def commit_chunks(frames: DataFrame, checkpoint: str, path: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """Exactly-once chunks: each micro-batch writes its own folder anew, so one that is repeated replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/chunk={number}")

    frames.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def supervise(job: Callable[[int, int], Any], total: int, size: int, *, retries: int = 1) -> list[tuple[int, int]]:
    """Run job(start, end) over chunks in turn; a failing one is retried, then halved, down to single frames."""
    done, todo = [], [(a, min(a + size, total)) for a in range(0, total, size)]
    while todo:
        a, b = todo.pop(0)
        for attempt in range(retries + 1):
            try:
                job(a, b)
                done.append((a, b))
                break
            except Exception:
                if attempt == retries:
                    if b - a == 1:
                        raise
                    mid = (a + b) // 2
                    todo[:0] = [(a, mid), (mid, b)]
    return done


def _resident(pid: int) -> int:
    """Bytes of memory a process holds now; 0 where that can't be read."""
    try:
        with open(f"/proc/{pid}/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    except (OSError, ValueError, IndexError):
        return 0


def run_batch(command: Sequence[str], *, log: str, result: str, start: int, attempt: int, patterns: Mapping[str, str], pause: float = 1.0) -> dict[str, Any]:
    """Run one batch as a process of this machine with its log in a file, and judge it.

    It succeeded if it ended with 0, wrote a verified result of state chunk_done or
    done, and its log shows none of the patterns. Peak memory is sampled every pause.
    A result left by an earlier attempt is removed first.
    """
    import re

    from sightline.sources.manifest import read_json

    if os.path.exists(result):
        os.remove(result)
    began, peak = time.time(), 0
    with open(log, "w", encoding="utf-8") as f:
        process = subprocess.Popen(list(command), stdout=f, stderr=subprocess.STDOUT)
        while True:
            peak = max(peak, _resident(process.pid))
            try:
                code = process.wait(timeout=pause)
                break
            except subprocess.TimeoutExpired:
                continue
    faults: set[str] = set()
    with open(log, encoding="utf-8", errors="replace") as f:
        for line in f:
            faults |= {name for name, p in patterns.items() if re.search(p, line, re.IGNORECASE)}
    got = read_json(result) or {}
    verified = bool(got.get("verified"))
    numbers = {n: int(got.get(n) or 0) for n in ("start", "end", "total", "rendered", "next_start")}
    judged = {"attempt": attempt, "requested_start": start, "return_code": code, "faults": sorted(faults), "peak_bytes": peak, "seconds": round(time.time() - began, 2), "log": log, "verified": verified, "complete": bool(got.get("complete"))}
    return numbers | judged | {"success": code == 0 and verified and got.get("state") in ("chunk_done", "done") and not faults}


def stop_recording(query: Any, spark: SparkSession, path: str) -> DataFrame:
    """Take in what a recording query hasn't processed yet, end it, and give its points as a base path: key, seq, x, y, z with the coordinates smoothed once, ends kept."""
    from sightline.operators.paths import smooth_window

    if query.isActive:
        query.processAllAvailable()
        query.stop()
    return smooth_window(spark.read.schema(OUT).parquet(path), key="key", order=["seq"], columns=["x", "y", "z"])
