"""Polylines, runs and intervals: ordered windows first, folds per polyline where a step depends on the last."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(key: str, order: Sequence[str]) -> Window:
    return Window.partitionBy(key).orderBy(*order)


def running_length(points: DataFrame, *, key: str, order: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """points with `step` from the point before (0 at the start) and `along`, its running sum."""
    w = _w(key, order)
    d2 = sum((F.pow(F.col(a) - F.lag(a).over(w), 2) for a in axes[1:]), F.pow(F.col(axes[0]) - F.lag(axes[0]).over(w), 2))
    return points.withColumn("step", F.coalesce(F.sqrt(d2), F.lit(0.0))).withColumn("along", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def segments(points: DataFrame, *, key: str, order: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """Each point with the next one's place: from, to along the line and the end coordinates."""
    w = _w(key, order)
    p = running_length(points, key=key, order=order, axes=axes)
    nxt = {f"next_{a}": F.lead(a).over(w) for a in [*axes, "along"]}
    return p.withColumns(nxt).where("next_along is not null")


def at_distances(segs: DataFrame, stations: DataFrame, *, key: str, axes: Sequence[str]) -> DataFrame:
    """Points at the stations' distances (key, station, distance), interpolated on the segment that holds them.

    An interval join: of touching segments the one that starts at the distance holds
    it, the last one of a line also its end.
    """
    last = segs.groupBy(key).agg(F.max("next_along").alias("total"))
    s = stations.join(last, key).withColumn("distance", F.least(F.greatest(F.col("distance"), F.lit(0.0)), F.col("total")))
    hit = s.join(segs, key).where((F.col("along") <= F.col("distance")) & ((F.col("distance") < F.col("next_along")) | ((F.col("distance") == F.col("total")) & (F.col("next_along") == F.col("total")))))
    t = F.when(F.col("next_along") > F.col("along"), (F.col("distance") - F.col("along")) / (F.col("next_along") - F.col("along"))).otherwise(0.0)
    placed = hit.select(key, "station", "distance", "along", *[(F.col(a) + (F.col(f"next_{a}") - F.col(a)) * t).alias(a) for a in axes])
    best = F.max(F.struct("along", "distance", *axes)).alias("b")
    return placed.groupBy(key, "station").agg(best).select(key, "station", "b.distance", *[F.col(f"b.{a}").alias(a) for a in axes])


def uniform_stations(lengths: DataFrame, *, key: str, total: str, spacing: float | None = None, count: Column | None = None) -> DataFrame:
    """(key, station, distance): ceil(total / spacing) equal parts, or `count` stations from end to end."""
    n = F.greatest(F.lit(1), F.ceil(F.col(total) / spacing)).cast("int") if spacing else F.greatest(F.lit(1), count - 1).cast("int")
    return lengths.select(key, F.col(total).alias("__t"), n.alias("__n")).select(key, "__t", "__n", F.explode(F.sequence(F.lit(0), F.col("__n"))).alias("station")).select(key, "station", (F.col("__t") * F.col("station") / F.col("__n")).alias("distance"))


def islands(rows: DataFrame, *, key: str, order: Sequence[str], flag: Column, least: int = 1) -> DataFrame:
    """Runs of rows with the flag set: key, run, first, last position and size of those of at least `least` rows."""
    w = _w(key, order)
    r = rows.withColumn("__f", F.coalesce(flag, F.lit(False))).withColumn("__p", F.row_number().over(w))
    r = r.withColumn("__s", F.when(F.col("__f") & ~F.coalesce(F.lag("__f").over(w), F.lit(False)), 1).otherwise(0)).withColumn("run", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.where("__f").groupBy(key, "run").agg(F.min("__p").alias("first"), F.max("__p").alias("last"), F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)


def dilated(flag: str, key: str, order: Sequence[str], rows: int) -> Column:
    """Whether the flag is set within some rows before or after."""
    return F.max(F.col(flag).cast("int")).over(_w(key, order).rowsBetween(-rows, rows)) == 1


def closed_gaps(rows: DataFrame, *, key: str, order: Sequence[str], flag: str, gap: int) -> DataFrame:
    """rows with `closed`: the flag, also set in gaps of at most `gap` rows between set ones."""
    w = _w(key, order)
    r = rows.withColumn("__p", F.row_number().over(w))
    before = F.last(F.when(F.col(flag), F.col("__p")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(F.when(F.col(flag), F.col("__p")), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return r.withColumn("closed", F.coalesce((after - before - 1) <= gap, F.lit(False)) | F.col(flag)).drop("__p")


def merge_intervals(intervals: DataFrame, *, key: str, lo: str, hi: str, gap: float = 0.0) -> DataFrame:
    """Intervals that touch, overlap or lie at most a gap apart become one, against the running greatest end."""
    w = _w(key, [lo, hi])
    top = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = intervals.withColumn("__n", F.when(top.isNull() | (F.col(lo) > top + gap), 1).otherwise(0)).withColumn("merged", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(key, "merged").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.count(F.lit(1)).alias("parts"))


def subtract_intervals(wholes: DataFrame, cuts: DataFrame, *, key: str) -> DataFrame:
    """What is left of each key's whole (lo, hi) after its cuts (lo, hi): key, lo, hi."""
    c = cuts.select(key, F.col("lo").alias("a"), F.col("hi").alias("b")).join(wholes, key).select(key, "lo", "hi", F.greatest("a", "lo").alias("a"), F.least("b", "hi").alias("b")).where("a < b")
    m = merge_intervals(c.select(key, "a", "b"), key=key, lo="a", hi="b").join(wholes.withColumnsRenamed({"lo": "wlo", "hi": "whi"}), key)
    w = _w(key, ["lo"])
    before = m.select(key, F.coalesce(F.lag("hi").over(w), F.col("wlo")).alias("x"), F.col("lo").alias("y"))
    after = m.groupBy(key).agg(F.max("hi").alias("x"), F.max("whi").alias("y"))
    whole = wholes.join(m.select(key).distinct(), key, "left_anti").select(key, F.col("lo").alias("x"), F.col("hi").alias("y"))
    return before.unionByName(after).unionByName(whole).where("x < y").select(key, F.col("x").alias("lo"), F.col("y").alias("hi"))


def turns(points: DataFrame, *, key: str, order: Sequence[str], x: str, y: str, least_degrees: float) -> DataFrame:
    """Points where the heading changes by at least so many degrees."""
    w = _w(key, order)
    a = F.atan2(F.col(y) - F.lag(y).over(w), F.col(x) - F.lag(x).over(w))
    b = F.atan2(F.lead(y).over(w) - F.col(y), F.lead(x).over(w) - F.col(x))
    d = F.abs(F.pmod(b - a + math.pi, F.lit(2 * math.pi)) - math.pi)
    return points.withColumn("turn", F.degrees(d)).where(F.col("turn") >= least_degrees)


def chaikin(points: DataFrame, *, key: str, order: str, axes: Sequence[str]) -> DataFrame:
    """Corner cutting: each segment gives the points at a quarter and three quarters; ends stay."""
    w = _w(key, [order])
    nxt = {f"n_{a}": F.lead(a).over(w) for a in axes}
    p = points.withColumns(nxt).withColumn("__first", F.lag(order).over(w).isNull()).withColumn("__i", F.row_number().over(w))
    cut = lambda t: F.struct(F.lit(t).alias("t"), *[(F.col(a) * (1 - t) + F.col(f"n_{a}") * t).alias(a) for a in axes])
    own = F.struct(F.lit(0.0).alias("t"), *[F.col(a).cast("double").alias(a) for a in axes])
    made = F.when(F.col(f"n_{axes[0]}").isNull(), F.array(own)).when(F.col("__first"), F.array(own, cut(0.25), cut(0.75))).otherwise(F.array(cut(0.25), cut(0.75)))
    return p.select(key, "__i", F.explode(made).alias("m")).select(key, F.row_number().over(Window.partitionBy(key).orderBy("__i", "m.t")).alias("ord"), *[F.col(f"m.{a}").alias(a) for a in axes])


def smooth_window(points: DataFrame, *, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One pass of 1-2-1 weights; ends stay."""
    w = _w(key, order)
    return points.withColumns({c: F.coalesce((F.lag(c).over(w) + 2 * F.col(c) + F.lead(c).over(w)) / 4, F.col(c)) for c in columns})


def fold(points: DataFrame, key: str, order: Sequence[str], step: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A fold over each polyline's rows in order; a polyline must fit a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return step(pdf.sort_values(list(order), kind="stable").reset_index(drop=True))

    return points.groupBy(key).applyInPandas(run, schema)


def drop_close(points: DataFrame, *, key: str, order: Sequence[str], axes: Sequence[str], least: float) -> DataFrame:
    """Points at least `least` from the last kept one; the first is always kept."""

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[list(axes)].to_numpy(float)
        kept, last = [], None
        for i, q in enumerate(p):
            if last is None or math.dist(q, last) >= least:
                kept.append(i)
                last = q
        return pdf.iloc[kept]

    return fold(points, key, order, step, points.schema)


def dedupe_sorted(values: DataFrame, *, key: str, value: str, tolerance: float) -> DataFrame:
    """Values in order, without those within a tolerance of the last kept."""
    kind = dict(values.dtypes)[value]
    step = lambda a, v: F.when((F.size(a) == 0) | (v - F.element_at(a, -1) > tolerance), F.concat(a, F.array(v))).otherwise(a)
    kept = F.aggregate(F.array_sort(F.collect_list(value)), F.array().cast(f"array<{kind}>"), step)
    return values.groupBy(key).agg(kept.alias("k")).select(key, F.explode("k").alias(value))


def simplify(points: DataFrame, *, key: str, order: Sequence[str], x: str, y: str, tolerance: float) -> DataFrame:
    """Douglas-Peucker: points farther than the tolerance from the chord of those kept around them."""

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[[x, y]].to_numpy(float)
        keep = np.zeros(len(p), bool)
        keep[[0, -1]] = True
        todo = [(0, len(p) - 1)]
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            d, q = p[b] - p[a], p[a + 1 : b] - p[a]
            n = d @ d
            t = np.clip(q @ d / n, 0, 1) if n > 1e-12 else np.zeros(len(q))
            off = np.hypot(*(q - t[:, None] * d).T)
            k = int(off.argmax())
            if off[k] > tolerance:
                keep[a + 1 + k] = True
                todo += [(a, a + 1 + k), (a + 1 + k, b)]
        return pdf[keep]

    return fold(points, key, order, step, points.schema)


def adaptive_stations(points: DataFrame, *, key: str, order: Sequence[str], x: str, y: str, spacing: float, gain: float) -> DataFrame:
    """Distances along each line at a step that shrinks where it turns: step = spacing / (1 + gain * turn); the end is a station."""

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[[x, y]].to_numpy(float)
        d = np.diff(p, axis=0)
        size = np.hypot(*d.T) if len(d) else np.zeros(0)
        along = np.concatenate([[0.0], np.cumsum(size)])
        head = np.unwrap(np.arctan2(d[:, 1], d[:, 0])) if len(d) else np.zeros(0)
        bend = np.abs(np.diff(head, prepend=head[:1])) if len(d) else head
        at, out = 0.0, []
        while at < along[-1]:
            out.append(at)
            k = min(int(np.searchsorted(along, at, "right")) - 1, len(size) - 1)
            at += spacing / (1 + gain * bend[k])
        out.append(along[-1])
        return pd.DataFrame({key: pdf[key].iloc[0], "station": range(len(out)), "distance": out})

    kind = dict(points.dtypes)[key]
    return fold(points, key, order, step, f"{key} {kind}, station int, distance double")


def uncross(points: DataFrame, *, key: str, order: Sequence[str], x: str, y: str, most: int = 32) -> DataFrame:
    """Two-opt: while two segments cross, the points between are turned round, at most so many times."""

    def crossing(p: np.ndarray) -> tuple[int, int] | None:
        side = lambda a, b, c: (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])
        for i in range(len(p) - 3):
            a, b, c, d = p[i], p[i + 1], p[i + 2 : -1], p[i + 3 :]
            hit = np.flatnonzero((side(a, b, c) * side(a, b, d) < -1e-12) & (side(c, d, a) * side(c, d, b) < -1e-12))
            if len(hit):
                return i, i + 2 + int(hit[0])
        return None

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        idx = np.arange(len(pdf))
        p = pdf[[x, y]].to_numpy(float)
        for _ in range(most):
            hit = crossing(p[idx])
            if hit is None:
                break
            i, j = hit
            idx[i + 1 : j + 1] = idx[i + 1 : j + 1][::-1]
        out = pdf.iloc[idx].reset_index(drop=True)
        out["place"] = np.arange(len(out), dtype=np.int32)
        return out

    return fold(points, key, order, step, points.withColumn("place", F.lit(0)).schema)


def round_robin(rows: DataFrame, *, group: str, score: Sequence[Column | str]) -> DataFrame:
    """rows with `turn`: first the best of each group, then the second best, and so on."""
    r = rows.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*score)))
    return r.withColumn("turn", F.struct("__r", group)).drop("__r")


def runs_of(values: Iterator) -> list:
    """(value, length) of equal neighbours; a helper for tests."""
    out: list = []
    for v in values:
        if out and out[-1][0] == v:
            out[-1][1] += 1
        else:
            out.append([v, 1])
    return [tuple(x) for x in out]
