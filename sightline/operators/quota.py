"""Proportional allocation and even selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.order import placed


def largest_remainder(rows: DataFrame, *, weight: str, total: int, key: str, within: Sequence[str] = ()) -> DataFrame:
    """rows with `share`: whole parts of total * weight / sum, the rest by largest remainder (ties: weight, then key).

    Groups without positive weight get nothing. The rows are groups of an aggregate,
    not the data itself: one window per `within`.
    """
    w = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(1))
    clean = F.greatest(F.col(weight), F.lit(0.0))
    exact = F.when(F.sum(clean).over(w) > 0, total * clean / F.sum(clean).over(w)).otherwise(0.0)
    r = rows.withColumn("__e", exact).withColumn("__b", F.floor("__e").cast("long"))
    r = r.withColumn("__left", F.when(F.sum(clean).over(w) > 0, F.lit(total) - F.sum("__b").over(w)).otherwise(0))
    r = r.withColumn("__n", F.row_number().over(w.orderBy(F.desc(F.round(F.col("__e") - F.col("__b"), 9)), F.desc(weight), key)))
    return r.withColumn("share", F.col("__b") + F.when(F.col("__n") <= F.col("__left"), 1).otherwise(0)).drop("__e", "__b", "__left", "__n")


def at_least_one(rows: DataFrame, *, weight: str, total: int, key: str) -> DataFrame:
    """Every row gets one and the rest is shared by largest remainder; with fewer than one each the heaviest get one."""
    w = Window.partitionBy(F.lit(1))
    r = rows.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__r", F.row_number().over(w.orderBy(F.desc(weight), key)))
    n = rows.count()
    if n >= total:
        return r.withColumn("share", (F.col("__r") <= total).cast("long")).drop("__n", "__r")
    more = largest_remainder(r.drop("__n", "__r"), weight=weight, total=total - n, key=key)
    return more.withColumn("share", F.col("share") + 1)


def boosted_shares(rows: DataFrame, *, area: str, total: int, key: str, least: int, boost: float, cap: float = 8.0) -> DataFrame:
    """Shares by area, small ones boosted against the median by up to a cap, on top of a floor."""
    median = rows.agg(F.median(area)).first()[0] or 0.0
    w = F.col(area) * F.least(F.lit(cap), F.pow(F.greatest(F.lit(1.0), F.lit(float(median)) / F.greatest(F.col(area), F.lit(1e-12))), F.lit(boost)))
    n = rows.count()
    base = min(least, total // max(1, n))
    out = largest_remainder(rows.withColumn("__w", w), weight="__w", total=total - base * n, key=key)
    return out.withColumn("share", F.col("share") + base).drop("__w")


def _ranked(rows: DataFrame, order: Sequence[Column | str], within: Sequence[str]) -> DataFrame:
    """rows with __i, the rank from 0, and __n, the number of rows: of each group, or by ranges of the whole table."""
    if within:
        w = Window.partitionBy(*within)
        return rows.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    return placed(rows, order).withColumn("__i", F.col("place") - 1).withColumnRenamed("rows", "__n").drop("place")


def even_ranks(rows: DataFrame, *, order: Sequence[Column | str], count: int, within: Sequence[str] = ()) -> DataFrame:
    """`count` rows at even ranks between the first and the last, half-even rounded; all rows if there are fewer."""
    r = _ranked(rows, order, within)
    if count <= 1:
        return r.where("__i = 0").drop("__i", "__n")
    ranks = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.bround(k * (F.col("__n") - 1) / (count - 1)).cast("long"))
    return r.where((F.col("__n") <= count) | F.array_contains(ranks, F.col("__i").cast("long"))).drop("__i", "__n")


def every_stride(rows: DataFrame, *, order: Sequence[Column | str], stride: int, within: Sequence[str] = ()) -> DataFrame:
    """Every stride-th row and the last one."""
    r = _ranked(rows, order, within)
    return r.where((F.col("__i") % stride == 0) | (F.col("__i") == F.col("__n") - 1)).drop("__i", "__n")


def validation_split(rows: DataFrame, *, order: Sequence[Column | str], ratio: float) -> DataFrame:
    """rows with `split`: ceil(n * ratio) rows, at a stride, validate; ratio is held to 0..0.5."""
    share = min(max(ratio, 0.0), 0.5)
    r = _ranked(rows, order, ())
    want = F.ceil(F.col("__n") * share)
    stride = F.greatest(F.lit(1), F.floor(F.col("__n") / F.greatest(want, F.lit(1))))
    chosen = (want > 0) & (F.col("__i") % stride == 0) & (F.col("__i") / stride < want)
    return r.withColumn("split", F.when(chosen, "validation").otherwise("train")).drop("__i", "__n")


def top_per_group(rows: DataFrame, *, group: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows of each group by order."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def systematic_sample(rows: DataFrame, *, weight: str, order: Sequence[str], count: int | str, within: Sequence[str] = ()) -> DataFrame:
    """rows with `taken`: how many of `count` (a number, or a column of it) evenly spaced marks on the cumulative weight of the table, or of each group, fall in each.

    Sums run over key ranges, so a group of any size is spread over tasks.
    """
    r = placed(rows, [*within, *order], total=weight)
    if within:
        groups = r.groupBy(*within).agg(F.min("before").alias("__first"), F.sum(weight).alias("__sum"))
        r = r.join(groups, list(within)).withColumn("before", F.col("before") - F.col("__first")).withColumn("whole", F.col("__sum"))
    n = F.col(count) if isinstance(count, str) else F.lit(count)
    mark = lambda c: F.floor(c / F.col("whole") * n + 0.5)
    taken = F.when(F.col("whole") > 0, mark(F.col("before") + F.coalesce(F.col(weight), F.lit(0.0))) - mark(F.col("before"))).otherwise(0)
    return r.select(*rows.columns, taken.cast("long").alias("taken"))
