"""Scoring, greedy covers and spread-out selections.

A greedy pick depends on the picks before it, so these loops run one aggregate
job a pick over (candidate, cell) rows; budgets are the feature's own limits.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.session import cut


def best_of_group(rows: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """The row of each group that is greatest by order (name each Column)."""
    keep = [c for c in rows.columns if c != group]
    best = F.max(F.struct(*order, F.struct(*keep).alias("row"))).alias("b")
    return rows.groupBy(group).agg(best).select(group, *[F.col(f"b.row.{c}").alias(c) for c in keep])


def marginal_gain(obs: DataFrame, coverage: DataFrame, *, candidate: str, cell: str, bin: str, minimum: int = 3) -> DataFrame:
    """Each candidate's weighted gain over the coverage (cell, n, bins): shares of new, under-observed and newly seen from another direction."""
    own = obs.select(F.col(candidate).alias("candidate"), F.col(cell).alias("cell"), F.col(bin).alias("bin")).distinct()
    own = own.groupBy("candidate", "cell").agg(F.min("bin").alias("bin"))
    j = own.join(coverage, "cell", "left")
    n = F.coalesce("n", F.lit(0))
    share = lambda c: F.count_if(c) / F.greatest(F.lit(1), F.count(F.lit(1)))
    new, under, other = share(n == 0), share((n > 0) & (n < minimum)), share((n > 0) & ~F.coalesce(F.array_contains("bins", F.col("bin")), F.lit(False)))
    out = j.groupBy("candidate").agg(F.count(F.lit(1)).alias("cells"), new.alias("new"), under.alias("under"), other.alias("other"))
    return out.withColumn("score", F.round(0.45 * F.col("new") + 0.25 * F.col("under") + 0.15 * F.col("other"), 9))


def greedy_cover(obs: DataFrame, *, candidate: str, cell: str, budget: int, weight: str | None = None, cost: str | None = None, target: float = 1.0, conflict: str | None = None) -> DataFrame:
    """(pick, candidate, gain, covered): up to `budget` picks of the greatest remaining weight (by cost), ties by candidate.

    Stops when no candidate gains or the target share of all weight is covered. With
    `conflict`, one pick for each of its values.
    """
    spark = obs.sparkSession
    cols = [F.col(candidate).alias("candidate"), F.col(cell).alias("cell"), (F.col(weight) if weight else F.lit(1)).cast("double").alias("w"), (F.col(cost) if cost else F.lit(1)).cast("double").alias("cost"), (F.col(conflict) if conflict else F.col(candidate)).alias("conflict")]
    left = cut(obs.select(*cols).dropDuplicates(["candidate", "cell"]))
    total = left.groupBy("cell").agg(F.max("w").alias("w")).agg(F.sum("w")).first()[0] or 0.0
    done, out = 0.0, []
    for k in range(budget):
        gains = left.groupBy("candidate", "conflict").agg(F.sum("w").alias("gain"), F.max("cost").alias("cost"))
        b = gains.orderBy(F.desc(F.round(F.col("gain") / F.greatest(F.col("cost"), F.lit(1e-9)), 9)), "candidate").first()
        if b is None or b.gain <= 0 or done >= target * total:
            break
        done += b.gain
        out.append((k, b.candidate, float(b.gain), float(done / max(total, 1e-12))))
        taken = left.where(F.col("candidate") == b.candidate).select("cell")
        left = cut(left.where(F.col("conflict") != b.conflict).join(taken, "cell", "left_anti"))
    kind = dict(left.dtypes)["candidate"]
    return spark.createDataFrame(out, f"pick int, candidate {kind}, gain double, covered double")


def swap_repair(obs: DataFrame, chosen: Sequence, *, candidate: str, cell: str, rounds: int = 8) -> tuple[list, int]:
    """The chosen candidates after up to `rounds` swaps that cover more cells: the least useful one leaves, the best one enters."""
    base = cut(obs.select(F.col(candidate).alias("c"), F.col(cell).alias("cell")).distinct())
    now = sorted(chosen)
    size = lambda ids: base.where(F.col("c").isin(ids)).select("cell").distinct().count()
    covered = size(now)
    for _ in range(rounds):
        inside = base.where(F.col("c").isin(now))
        alone = inside.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).where("n = 1").groupBy("c").agg(F.count(F.lit(1)).alias("only"))
        loss = {r.c: r.only for r in alone.collect()}  # at most the chosen ones
        out = min(now, key=lambda c: (loss.get(c, 0), c))
        rest = [c for c in now if c != out]
        held = base.where(F.col("c").isin(rest)).select("cell").distinct()
        b = base.where(~F.col("c").isin(now)).join(held, "cell", "left_anti").groupBy("c").agg(F.count(F.lit(1)).alias("gain")).orderBy(F.desc("gain"), "c").first()
        if b is None or b.gain <= loss.get(out, 0):
            break
        now = sorted([*rest, b.c])
        covered += b.gain - loss.get(out, 0)
    return now, covered


def farthest_points(points: DataFrame, *, group: str, id: str, axes: Sequence[str], count: int, spacing: float = 0.0) -> DataFrame:
    """Farthest-point sampling in each group, from its least id; ties by id; stops below the spacing. A group must fit a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id, kind="stable").reset_index(drop=True)
        p = pdf[list(axes)].to_numpy(float)
        d = np.full(len(p), np.inf)
        picked, at = [], 0
        while len(picked) < min(count, len(p)):
            picked.append(at)
            d = np.minimum(d, np.sqrt(((p - p[at]) ** 2).sum(1)))
            at = int(d.argmax())
            if d[at] < max(spacing, 1e-12):
                break
        out = pdf.iloc[picked][[group, id]].copy()
        out["pick"] = np.arange(len(picked), dtype=np.int32)
        return out

    kinds = dict(points.dtypes)
    return points.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {id} {kinds[id]}, pick int")


def farthest_points_large(points: DataFrame, *, id: str, axes: Sequence[str], count: int) -> DataFrame:
    """Farthest-point sampling over one large table: one aggregate a pick; only the last pick travels."""
    spark = points.sparkSession
    cols = [F.col(id).alias("id"), *[F.col(a).cast("double").alias(f"a{i}") for i, a in enumerate(axes)]]
    p = cut(points.select(*cols, F.lit(float("inf")).alias("d")))
    at = p.orderBy("id").first()
    out = []
    while at is not None and len(out) < count:
        out.append((len(out), at.id))
        d2 = sum(((F.col(f"a{i}") - at[f"a{i}"]) * (F.col(f"a{i}") - at[f"a{i}"]) for i in range(1, len(axes))), (F.col("a0") - at["a0"]) * (F.col("a0") - at["a0"]))
        p = p.withColumn("d", F.least("d", d2))
        if len(out) % 8 == 0:
            p = cut(p)
        at = p.where("d > 0").orderBy(F.desc("d"), "id").first()
    return spark.createDataFrame(out, f"pick int, {id} {dict(points.dtypes)[id]}")


def diverse_sequence(rows: DataFrame, *, group: str, order: Sequence[str], axes: Sequence[str], distance: float, most: int, forward: Sequence[str] = (), degrees: float = 2.0) -> DataFrame:
    """Rows in order that are at least a distance from all kept before, at most so many in each group.

    With forward columns a row is left out only if one kept before stands at most the
    distance away and looks at most so many degrees elsewhere.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable").reset_index(drop=True)
        p = pdf[list(axes)].to_numpy(float)
        f = pdf[list(forward)].to_numpy(float) if forward else None
        if f is not None:
            f = f / np.maximum(np.linalg.norm(f, axis=1, keepdims=True), 1e-12)
        kept: list[int] = []
        for i in range(len(p)):
            if len(kept) == most:
                break
            apart = np.sqrt(((p[kept] - p[i]) ** 2).sum(1)) if kept else np.full(1, np.inf)
            if f is None:
                same = apart < distance
            else:
                same = (apart <= distance) & ((f[kept] @ f[i] if kept else np.zeros(1)) >= np.cos(np.radians(degrees)))
            if not same.any():
                kept.append(i)
        return pdf.iloc[kept]

    return rows.groupBy(group).applyInPandas(run, rows.schema)


def ring_origins(regions: DataFrame, *, radii: Sequence[float], angles: int, heights: Sequence[float]) -> DataFrame:
    """Candidate origins on rings around each region's centre (region, x, y, z)."""
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(k).alias("k"), F.lit(h).alias("h")) for r in radii for k in range(angles) for h in heights])
    turn = F.col("s.k") * (2 * np.pi / angles)
    return regions.select("*", F.explode(steps).alias("s")).select("region", F.col("s.r").alias("radius"), F.col("s.k").alias("step"), (F.col("x") + F.col("s.r") * F.cos(turn)).alias("x"), (F.col("y") + F.col("s.r") * F.sin(turn)).alias("y"), (F.col("z") + F.col("s.h")).alias("z"))


def sphere_directions(spark, count: int) -> DataFrame:
    """A Fibonacci sphere of unit directions."""
    z = 1 - (2 * F.col("id") + 1) / count
    turn = F.col("id") * (np.pi * (3 - np.sqrt(5)))
    r = F.sqrt(1 - z * z)
    return spark.range(count).select("id", (r * F.cos(turn)).alias("x"), (r * F.sin(turn)).alias("y"), z.alias("z"))


def cube_faces(rows: DataFrame) -> DataFrame:
    """Each row six times, with a face number and its direction."""
    faces = [(0, 1, 0, 0), (1, -1, 0, 0), (2, 0, 1, 0), (3, 0, -1, 0), (4, 0, 0, 1), (5, 0, 0, -1)]
    f = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(x, ("face", "dx", "dy", "dz"), strict=True)]) for x in faces]))
    return rows.select("*", f.alias("__f")).select(*rows.columns, "__f.face", "__f.dx", "__f.dy", "__f.dz")
