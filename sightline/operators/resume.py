"""What is done, what is complete, and what may be resumed: manifests against listings."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.sources.manifest import fingerprint, read_json, write_json


def complete(expected: DataFrame, listing: DataFrame, markers: DataFrame, *, key: str = "frame", path: str = "path") -> DataFrame:
    """key, complete: every expected file is valid, and a marker is there whose files are all valid.

    expected (key, path); listing (path, valid); markers (key, files).
    """
    valid = listing.where("valid").select(path).distinct()
    files = expected.join(valid.withColumn("__ok", F.lit(True)), path, "left").groupBy(key).agg(F.bool_and(F.coalesce("__ok", F.lit(False))).alias("have"))
    named = markers.select(key, F.explode_outer("files").alias(path)).join(valid.withColumn("__ok", F.lit(True)), path, "left").groupBy(key).agg(F.bool_and(F.coalesce("__ok", F.col(path).isNull())).alias("marked"))
    return files.join(named, key, "left").select(key, (F.col("have") & F.coalesce("marked", F.lit(False))).alias("complete"))


def legacy_complete(expected: DataFrame, listing: DataFrame, markers: DataFrame, *, key: str = "frame", path: str = "path", per_object: bool = False, backend: str = "CAMERA_OBJECTS") -> DataFrame:
    """As complete(), but without a marker valid files are enough, unless files are split by object; a marker of another backend or stem rejects.

    expected (key, stem, path); markers (key, backend, stem, files).
    """
    valid = listing.where("valid").select(path).distinct().withColumn("__ok", F.lit(True))
    files = expected.join(valid, path, "left").groupBy(key, "stem").agg(F.bool_and(F.coalesce("__ok", F.lit(False))).alias("have"))
    named = markers.select(key, "backend", F.col("stem").alias("m_stem"), F.explode_outer("files").alias(path)).join(valid, path, "left")
    named = named.groupBy(key, "backend", "m_stem").agg(F.bool_and(F.coalesce("__ok", F.col(path).isNull())).alias("marked"))
    right = (F.col("backend") == backend) & (F.col("m_stem") == F.col("stem")) & F.col("marked")
    return files.join(named, key, "left").select(key, (F.col("have") & F.when(F.col("backend").isNull(), F.lit(not per_object)).otherwise(right)).alias("complete"), F.col("backend").isNotNull().alias("has_marker"))


def recovered(done: DataFrame, *, key: str = "frame") -> DataFrame:
    """key, action of legacy_complete()'s rows: done ones with a marker are kept, those without get one, the rest is rendered."""
    return done.select(key, F.when(~F.col("complete"), "render").when(F.col("has_marker"), "done").otherwise("recover").alias("action"))


def latest_state(states: DataFrame, *, group: Sequence[str] = ()) -> DataFrame:
    """Of states (path, finished, modified) the newest unfinished one, else the newest; ties by path."""
    best = F.max(F.struct((~F.col("finished")).alias("open"), "modified", "path", "finished")).alias("m")
    return states.groupBy(*group).agg(best).where("m is not null").select(*group, "m.path", "m.finished", "m.modified")


def save_progress(path: str, signature: Any, done: Sequence[int], total: int, seconds: float, state: str = "rendering") -> bool:
    """A checkpoint of a run's progress, written at once or not at all; whether it could be."""
    try:
        write_json(path, {"signature": fingerprint(signature), "total": total, "done": sorted(set(done)), "seconds": seconds, "state": state})
    except OSError:
        return False
    return True


def load_progress(path: str, signature: Any, total: int) -> dict | None:
    """The checkpoint, if it is of the same inputs and number of frames; its done set within these."""
    found = read_json(path)
    if not found or found.get("signature") != fingerprint(signature) or found.get("total") != total:
        return None
    return found | {"done": [k for k in found.get("done", ()) if 1 <= k <= total]}


@dataclass
class StepRunner:
    """Stages run one unit a step, with the state kept in a file so that a new runner goes on where the last one stopped.

    stages: (name, work); work(unit) does one unit and says whether the stage is done.
    A stage that raises leaves the state as it was, with the error noted.
    """

    path: str
    stages: Sequence[tuple[str, Callable[[int], bool]]]
    inputs: Any = None
    state: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        held = read_json(self.path) or {}
        fresh = {"inputs": fingerprint(self.inputs), "stage": 0, "unit": 0, "error": None}
        self.state = held if held.get("inputs") == fresh["inputs"] else fresh

    @property
    def finished(self) -> bool:
        return self.state["stage"] >= len(self.stages)

    def step(self) -> bool:
        """One unit of the present stage; False once all stages are done."""
        if self.finished:
            return False
        _, work = self.stages[self.state["stage"]]
        try:
            done = work(self.state["unit"])
        except Exception as e:
            write_json(self.path, self.state | {"error": f"{type(e).__name__}: {e}"})
            raise
        self.state |= {"error": None} | ({"stage": self.state["stage"] + 1, "unit": 0} if done else {"unit": self.state["unit"] + 1})
        write_json(self.path, self.state)
        return not self.finished


def gate(problems: DataFrame, message: str = "message", shown: int = 5) -> None:
    """Raise if there are problems, naming the first few in order."""
    first = [r[0] for r in problems.select(message).orderBy(message).limit(shown + 1).collect()]
    if first:
        raise ValueError("; ".join(first[:shown]) + ("; and more" if len(first) > shown else ""))


def send_control(path: str, command: str, allowed: Sequence[str] = ("pause", "resume", "stop")) -> None:
    """A command for a running job, as a file beside it."""
    if command not in allowed:
        raise ValueError(f"no command {command}")
    write_json(path, {"command": command})


def poll(paths: dict[str, str], *, alive: bool | None, final: Sequence[str] = ("done", "failed", "stopped")) -> dict:
    """What a job's status, progress and metrics files say; running as its handle says, or where that is lost, unless the status is final."""
    out = {k: read_json(p, {}) or {} for k, p in paths.items()}
    status = out.get("status", {}).get("state")
    return out | {"running": alive if alive is not None else status is not None and status not in final}


def snapshot_inputs(spark: SparkSession, tables: dict[str, DataFrame], folder: str, settings: dict, frames: int, *, most_chunks: int = 64, least: int = 8) -> dict:
    """Write the inputs of a background run and its plan: settings, tables and how many frames a chunk has."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    plan = {"settings": settings, "fingerprint": fingerprint(settings), "frames": frames, "chunk": max(least, -(-frames // most_chunks)), "tables": sorted(tables)}
    write_json(f"{folder.removeprefix('file:')}/plan.json", plan)
    return plan
