"""Coverage of cells by observations: aggregates, ratios, regions and merges.

An observation says that a candidate (an observer) sees a cell: under an
incidence angle, from a distance, in a direction bin, with a category. All
operators name their columns by parameter and aggregate map-side first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage_by_cell(obs: DataFrame, *, cell: str, candidate: str, incidence: str, distance: str, bin: str, max_incidence: float = 75.0) -> DataFrame:
    """One row per cell seen at an incidence of at most max_incidence degrees: counts, extremes, the set of bins, the candidates."""
    return (
        obs.where(F.col(incidence) <= max_incidence)
        .groupBy(F.col(cell).alias("cell"))
        .agg(
            F.count(F.lit(1)).alias("observations"),
            F.min(incidence).alias("min_incidence"),
            F.min(distance).alias("min_distance"),
            F.max(distance).alias("max_distance"),
            F.array_sort(F.collect_set(bin)).alias("bins"),
            F.array_sort(F.collect_set(candidate)).alias("candidates"),
        )
    )


def best_by_key(obs: DataFrame, keys: Sequence[str], measure: str, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Of each key the row of least measure; of equal ones the first by order."""
    best = F.min(F.struct(F.col(measure), *[F.col(c) for c in order if c != measure], *[F.col(c) for c in keep if c not in (measure, *order)])).alias("b")
    return obs.groupBy(*keys).agg(best).select(*keys, *[F.col(f"b.{c}").alias(c) for c in dict.fromkeys([measure, *order, *keep])])


def merge_first_wins(maps: Sequence[DataFrame], keys: Sequence[str], measure: str) -> DataFrame:
    """A full outer merge that keeps each key's least measure; of equal ones the earlier map's."""
    all_maps = None
    for i, m in enumerate(maps):
        part = m.select(*keys, measure).withColumn("source", F.lit(i))
        all_maps = part if all_maps is None else all_maps.unionByName(part)
    return best_by_key(all_maps, keys, measure, ["source"], [])


def dilate(cells: DataFrame, x: str, y: str, measure: str, radius: int) -> DataFrame:
    """Each cell spreads over a (2r + 1) square; a cell reached more than once keeps the least measure."""
    span = F.sequence(F.lit(-radius), F.lit(radius))
    wide = cells.select(F.col(x), F.col(y), F.col(measure), F.explode(span).alias("dx")).select("*", F.explode(span).alias("dy"))
    return wide.groupBy((F.col(x) + F.col("dx")).alias(x), (F.col(y) + F.col("dy")).alias(y)).agg(F.min(measure).alias(measure))


def ratio(part: Column, whole: Column) -> Column:
    """part / max(1, whole)."""
    return part / F.greatest(F.lit(1), whole)


def category_ratio(obs: DataFrame, visible: DataFrame, *, cell: str, category: str) -> DataFrame:
    """Observed among visible cells for each category of the visible ones; 1.0 where there are none."""
    seen = obs.select(F.col(cell).alias("cell")).distinct().withColumn("seen", F.lit(1))
    return (
        visible.select(F.col(cell).alias("cell"), F.col(category).alias("category")).distinct().join(seen, "cell", "left").groupBy("category")
        .agg(F.count("seen").alias("observed"), F.count(F.lit(1)).alias("visible")).withColumn("ratio", F.when(F.col("visible") == 0, 1.0).otherwise(F.col("observed") / F.col("visible")))
    )


def coverage_statistics(obs: DataFrame, *, cell: str, candidate: str, category: str, object_: str, minimum: int = 3, preferred: int = 5) -> DataFrame:
    """Cells at one, minimum and preferred observations: overall, by category and by object, in one GROUPING SETS."""
    per = obs.groupBy(F.col(object_).alias("object"), F.col(category).alias("category"), F.col(cell).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(candidate).alias("origins"))
    at = lambda k: F.count_if(F.col("n") >= k)
    return per.groupingSets([[], [F.col("category")], [F.col("object")]], F.col("category"), F.col("object")).agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("cells"), at(minimum).alias("at_minimum"), at(preferred).alias("at_preferred"), F.sum("n").alias("observations"), F.max("origins").alias("most_origins"), ratio(at(minimum), F.count(F.lit(1))).alias("ratio_minimum")
    )


def measure_targets(targets: DataFrame, coverage: DataFrame, *, key: str, count: str, bins: str, minimum: int = 3, recommended: int = 5, target_ratio: float = 0.95) -> DataFrame:
    """One row: how many targets have enough observations and two direction bins, their ratios, and whether both ratios reach the target."""
    t = targets.select(F.col(key)).distinct().join(coverage.select(F.col(key), F.col(count).alias("n"), F.col(bins).alias("b")), key, "left")
    n, b = F.coalesce("n", F.lit(0)), F.coalesce("b", F.lit(0))
    out = t.agg(F.count(F.lit(1)).alias("targets"), F.count_if(n >= minimum).alias("at_minimum"), F.count_if(n >= recommended).alias("at_recommended"), F.count_if(b >= 2).alias("parallax"))
    out = out.withColumn("minimum_ratio", ratio(F.col("at_minimum"), F.col("targets"))).withColumn("parallax_ratio", ratio(F.col("parallax"), F.col("targets")))
    return out.withColumn("satisfied", (F.col("minimum_ratio") >= target_ratio) & (F.col("parallax_ratio") >= target_ratio))


def region_summary(cells: DataFrame, *, group: str, x: str, y: str, z: str, category: str, slab: float = 0.2) -> DataFrame:
    """Bounds, centroid and commonest category (ties: the lesser) of each group; a flat one is called slab."""
    modal = cells.groupBy(group, category).agg(F.count(F.lit(1)).alias("n")).groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(category).alias("c"))).alias("m"))
    box = cells.groupBy(group).agg(F.count(F.lit(1)).alias("cells"), *[f(c).alias(f"{name}_{a}") for c, a in ((x, "x"), (y, "y"), (z, "z")) for f, name in ((F.min, "min"), (F.max, "max"))], F.avg(x).alias("center_x"), F.avg(y).alias("center_y"))
    flat = (F.col("max_z") - F.col("min_z")) <= slab * F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    return box.join(modal, group).withColumn("kind", F.when(flat, "slab").otherwise(F.col("m.c"))).drop("m")


def top_groups(rows: DataFrame, group: str, k: int = 8) -> DataFrame:
    """The k largest groups by (-count, name)."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), group).limit(k)


def principal_axes(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Centre, covariance and principal angle of each group's points."""
    d = rows.groupBy(group).agg(F.avg(x).alias("center_x"), F.avg(y).alias("center_y"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.covar_pop(x, y).alias("xy"))
    return d.withColumn("angle", 0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")))


def percentile_or(column: str, p: float, empty: float | None = None) -> Column:
    """The linearly interpolated percentile; on no rows null, or the number given."""
    q = F.percentile(column, F.lit(p))
    return q if empty is None else F.coalesce(q, F.lit(empty))


def upper_median(column: str) -> Column:
    """Of an even number the upper of the middle two."""
    s = F.array_sort(F.collect_list(column))
    return F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))


def first_per_voxel(rows: DataFrame, voxel: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """The first row by order of each voxel."""
    keyed = rows.withColumns({f"__v{i}": c for i, c in enumerate(voxel)})
    names = [f"__v{i}" for i in range(len(voxel))]
    best = keyed.groupBy(*names).agg(F.min(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rows.columns if c not in order])).alias("b"))
    return best.select(*[F.col(f"b.{c}").alias(c) for c in rows.columns])


def near_field_band(nearest: Column, p25: Column, share: Column, *, near: float, mid: float, dominant: float = 0.65) -> Column:
    """NEAR, MID or FAR by the nearest hit, the quarter percentile and the commonest surface's share."""
    return F.when((nearest < near) | ((p25 < near) & (share >= dominant)), "NEAR").when(p25 < mid, "MID").otherwise("FAR")


def near_field(rays: DataFrame, *, candidate: str, distance: str, surface: str, near: float, mid: float) -> DataFrame:
    """Nearest and quarter-percentile distance of each candidate's rays, the commonest surface (ties: the larger) and the band."""
    top = rays.groupBy(candidate, surface).agg(F.count(F.lit(1)).alias("n")).groupBy(candidate).agg(F.max(F.struct("n", F.col(surface).alias("s"))).alias("t"))
    d = rays.groupBy(candidate).agg(F.min(distance).alias("nearest"), F.percentile(distance, F.lit(0.25)).alias("p25"), F.count(F.lit(1)).alias("rays")).join(top, candidate)
    d = d.withColumn("surface", F.col("t.s")).withColumn("share", F.col("t.n") / F.col("rays")).drop("t")
    return d.withColumn("band", near_field_band(F.col("nearest"), F.col("p25"), F.col("share"), near=near, mid=mid))


def under_observed(targets: DataFrame, coverage: DataFrame, *, key: str, count: str, least: int, k: int) -> DataFrame:
    """The k targets with fewest observations below `least`, ties by key."""
    n = F.coalesce(F.col(count), F.lit(0))
    return targets.select(key).distinct().join(coverage, key, "left").select(key, n.alias("n")).where(F.col("n") < least).orderBy("n", key).limit(k)


def set_fingerprint(rows: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """A SHA-256 of each group's rows that doesn't depend on their order: digest by row, sorted, digest again."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    return rows.select(group, row.alias("d")).groupBy(group).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("fingerprint"))


def latest_and_history(runs: DataFrame, *, group: str, order: str, value: str) -> DataFrame:
    """The latest run's value of each group and how many there were."""
    return runs.groupBy(group).agg(F.max_by(value, order).alias("latest"), F.max(order).alias("last_run"), F.count(F.lit(1)).alias("runs"))


def first_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row by order of each key, all columns kept."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
