"""Path, interval and allocation queries: events as polylines (user_id; ts, event_id; value), lineitem as intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators import paths as P
from sightline.operators import quota as Q
from sightline.plans.coverage_queries import t


def line(s, d) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(s, d, "events").select("user_id", "ts", "event_id", F.round("value", 2).alias("y"), (F.row_number().over(w) * 10.0).alias("x"), (F.col("value") > 40).alias("bad"))


LINE = "(select user_id, ts, event_id, round(value, 2) as y, row_number() over (partition by user_id order by ts, event_id) * 10.0::double as x, value > 40 as bad from events)"
W = "over (partition by user_id order by ts, event_id)"
O = dict(key="user_id", order=["ts", "event_id"])
RUNNING = f"(select *, sum(step) {W[:-1]} rows unbounded preceding) as along from (select *, coalesce(sqrt((x - lag(x) {W}) ** 2 + (y - lag(y) {W}) ** 2), 0) as step from {LINE}))"


def stations(s, d):
    segs = P.segments(line(s, d), axes=["x", "y"], **O)
    total = segs.groupBy("user_id").agg(F.max("next_along").alias("total"))
    return P.at_distances(segs, P.uniform_stations(total, key="user_id", total="total", spacing=25.0), key="user_id", axes=["x", "y"])


def counted(s, d):
    segs = P.segments(line(s, d), axes=["x", "y"], **O)
    total = segs.groupBy("user_id").agg(F.max("next_along").alias("total"))
    return P.at_distances(segs, P.uniform_stations(total, key="user_id", total="total", count=F.lit(9)), key="user_id", axes=["x", "y"])


def r(df: DataFrame, *cols: str, n: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in cols})


def spans(s, d) -> DataFrame:
    return t(s, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") / 4.0).alias("lo"), (F.col("l_orderkey") / 4.0 + F.col("l_quantity")).alias("hi"))


SPANS = "(select l_suppkey, l_orderkey / 4.0::double as lo, l_orderkey / 4.0::double + l_quantity as hi from lineitem)"


def subtracted(s, d):
    x = spans(s, d)
    whole = x.groupBy("l_suppkey").agg(F.min("lo").alias("lo"), (F.max("hi") + 10).alias("hi"))
    return P.subtract_intervals(whole, x, key="l_suppkey")


def dil(s, d):
    x = line(s, d).withColumn("wide", P.dilated("bad", "user_id", ["ts", "event_id"], 1))
    return P.islands(x, flag=~F.col("wide"), least=2, **O)


def nations(s, d) -> DataFrame:
    return t(s, d, "customer").groupBy("c_nationkey").agg(F.round(F.sum(F.greatest("c_acctbal", F.lit(0.0))), 2).alias("weight"))


NATIONS = "(select c_nationkey, round(sum(greatest(c_acctbal, 0)), 2) as weight from customer group by 1)"
_MERGED = f"(select l_suppkey, merged, min(lo) as lo, max(hi) as hi, count(*) as parts from (select *, sum(n) over (partition by l_suppkey order by lo, hi rows unbounded preceding) as merged from (select *, case when max(hi) over (partition by l_suppkey order by lo, hi rows between unbounded preceding and 1 preceding) + {{gap}} >= lo then 0 else 1 end as n from {SPANS})) group by 1, 2)"


def islands_sql(flag: str, least: int, source: str = LINE) -> str:
    return f"select user_id, run, min(p) as first, max(p) as last, count(*) as size from (select *, sum(case when f and not coalesce(pf, false) then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from (select *, lag(f) {W} as pf, row_number() {W} as p from (select *, {flag} as f from {source}))) where f group by 1, 2 having count(*) >= {least}"


def shares_sql(total: int, source: str = NATIONS, weight: str = "weight", key: str = "c_nationkey") -> str:
    return f"(select *, b + case when row_number() over (order by round(e - b, 9) desc, {weight} desc, {key}) <= {total} - sum(b) over () then 1 else 0 end as share from (select *, floor({total} * {weight} / sum({weight}) over ())::bigint as b, {total} * {weight} / sum({weight}) over () as e from {source}))"


QUERIES = {
    "f1_running_length": lambda s, d: r(P.running_length(line(s, d), axes=["x", "y"], **O).select("event_id", "along"), "along"),
    "f2_resample_uniform": lambda s, d: r(stations(s, d), "distance", "x", "y"),
    "f6_resample_count": lambda s, d: stations(s, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("points")),
    "f8_resample_evenly": lambda s, d: r(counted(s, d), "distance", "x", "y"),
    "f9_smoothed": lambda s, d: r(P.smooth_window(line(s, d), columns=["y"], **O).select("event_id", "y"), "y", n=6),
    "f10_collision_intervals": dil,
    "f11_merge_close_runs": lambda s, d: P.islands(P.closed_gaps(line(s, d), flag="bad", gap=2, **O), flag=F.col("closed"), **O),
    "f12_heading_changes": lambda s, d: r(P.turns(line(s, d), x="x", y="y", least_degrees=60, **O).select("event_id", "turn"), "turn", n=5),
    "f13_dedupe_distances": lambda s, d: P.dedupe_sorted(t(s, d, "lineitem").select("l_suppkey", "l_quantity"), key="l_suppkey", value="l_quantity", tolerance=4.0),
    "f16_local_step": lambda s, d: t(s, d, "part").select("p_partkey", F.round(F.least(F.greatest(2 * F.col("p_size") / 10 * F.tan(F.radians(F.lit(30.0))) * 0.3, F.lit(0.25)), F.lit(0.65)), 9).alias("step")),
    "f17_reference_depth": lambda s, d: t(s, d, "lineitem").groupBy("l_partkey").agg(F.round(F.coalesce(F.percentile("l_quantity", F.lit(0.4)), F.lit(2.0)), 6).alias("depth")),
    "f18_layer_heights": lambda s, d: t(s, d, "part").select("p_partkey", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.col("p_size") * k / 4.0)).alias("layer", "z")),
    "f19_lane_runs": lambda s, d: P.islands(line(s, d), flag=~F.col("bad"), least=2, **O),
    "f22_closed_gaps": lambda s, d: P.closed_gaps(line(s, d), flag="bad", gap=1, **O).groupBy("bad", "closed").agg(F.count(F.lit(1)).alias("n")),
    "f23_merge_segments": lambda s, d: P.merge_intervals(spans(s, d), key="l_suppkey", lo="lo", hi="hi", gap=1.0).drop("merged"),
    "f28_chaikin": lambda s, d: r(P.chaikin(line(s, d).select("user_id", "event_id", "x", "y"), key="user_id", order="event_id", axes=["x", "y"]), "x", "y"),
    "f33_order_and_overlap": lambda s, d: line(s, d).select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("place"), F.round(F.col("y") - F.lag("y").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), 4).alias("jump")),
    "f34_interval_subtraction": subtracted,
    "f35_round_robin": lambda s, d: P.round_robin(t(s, d, "supplier"), group="s_nationkey", score=[F.desc("s_acctbal"), "s_suppkey"]).select("s_suppkey", F.row_number().over(Window.orderBy("turn")).alias("place")),
    "f36_stepped_points": lambda s, d: t(s, d, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.col("n_nationkey") % 5)).alias("k")).select("n_nationkey", (F.col("k") * 0.5).alias("at")),
    "f41_short_fragments": lambda s, d: P.running_length(line(s, d), axes=["x", "y"], **O).groupBy("user_id").agg(F.round(F.max("along"), 4).alias("length")).where("length >= 150"),
    "f5_adaptive_stations": lambda s, d: P.adaptive_stations(line(s, d), x="x", y="y", spacing=20.0, gain=0.75, **O),
    "f26_simplify": lambda s, d: P.simplify(line(s, d).select("user_id", "ts", "event_id", "x", "y"), x="x", y="y", tolerance=15.0, **O),
    "f30_uncross": lambda s, d: P.uncross(line(s, d).select("user_id", "ts", "event_id", (F.col("x") % 40).alias("x"), "y"), x="x", y="y", **O),
    "j5_record_points": lambda s, d: P.drop_close(line(s, d).select("user_id", "ts", "event_id", "x", "y"), axes=["x", "y"], least=25.0, **O),
    "e24_boosted_shares": lambda s, d: Q.boosted_shares(nations(s, d), area="weight", total=1000, key="c_nationkey", least=8, boost=1.0).select("c_nationkey", "share"),
    "e25_largest_remainder": lambda s, d: Q.largest_remainder(nations(s, d), weight="weight", total=720, key="c_nationkey").select("c_nationkey", "share"),
    "e27_at_least_one": lambda s, d: Q.at_least_one(nations(s, d), weight="weight", total=100, key="c_nationkey").select("c_nationkey", "share"),
    "e28_component_counts": lambda s, d: nations(s, d).select("c_nationkey", F.least(F.lit(40), F.ceil(F.col("weight") / 5000)).cast("long").alias("share")),
    "h4_even_ranks": lambda s, d: Q.even_ranks(t(s, d, "part").select("p_partkey", "p_retailprice"), order=["p_retailprice", "p_partkey"], count=24),
    "h5_even_by_group": lambda s, d: Q.even_ranks(t(s, d, "part").select("p_partkey", "p_brand"), order=["p_partkey"], count=5, within=["p_brand"]),
    "h22_stride_and_last": lambda s, d: Q.every_stride(t(s, d, "part").select("p_partkey", "p_brand"), order=["p_partkey"], stride=7, within=["p_brand"]),
    "h33_systematic_sample": lambda s, d: Q.systematic_sample(t(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("w")), weight="w", order=["p_partkey"], count=500).select("p_partkey", "taken"),
    "b4_validation_split": lambda s, d: Q.validation_split(t(s, d, "part").select("p_partkey"), order=["p_partkey"], ratio=0.1),
    "h12_prefilter": lambda s, d: Q.top_per_group(t(s, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("score")), group=["l_suppkey"], order=[F.desc("score"), "l_partkey"], k=2).orderBy(F.desc("score"), "l_suppkey", "l_partkey").limit(64).select("l_suppkey", "l_partkey", "score"),
}
_SEG = f"(select user_id, x, y, along, lead(x) {W} as nx, lead(y) {W} as ny, lead(along) {W} as na from {RUNNING})"


def _stations_sql(n: str) -> str:
    return f"""with seg as (select * from {_SEG} where na is not null), tot as (select user_id, max(na) as total from seg group by 1),
st as (select user_id, total, n, unnest(range(0, n + 1)) as station from (select *, {n} as n from tot)), pos as (select *, least(greatest(total * station / n, 0), total) as distance from st),
hit as (select a.*, x, y, nx, ny, along, na, row_number() over (partition by a.user_id, station order by along desc) as k from pos a join seg s on s.user_id = a.user_id and along <= distance and (distance < na or distance = total and na = total))
select user_id, cast(station as int) as station, round(distance, 4) as distance, round(x + (nx - x) * case when na > along then (distance - along) / (na - along) else 0 end, 4) as x, round(y + (ny - y) * case when na > along then (distance - along) / (na - along) else 0 end, 4) as y from hit where k = 1"""


_PART = "part"
SQL = {
    "f1_running_length": f"select event_id, round(along, 4) as along from {RUNNING}",
    "f2_resample_uniform": _stations_sql("greatest(1, ceil(total / 25))::int"),
    "f6_resample_count": f"select user_id, greatest(1, ceil(max(na) / 25))::bigint + 1 as points from {_SEG} where na is not null group by 1",
    "f8_resample_evenly": _stations_sql("8"),
    "f9_smoothed": f"select event_id, round(coalesce((lag(y) {W} + 2 * y + lead(y) {W}) / 4, y), 6) as y from {LINE}",
    "f10_collision_intervals": islands_sql("not wide", 2, f"(select *, max(bad::int) {W[:-1]} rows between 1 preceding and 1 following) = 1 as wide from {LINE})"),
    "f11_merge_close_runs": islands_sql("bad or coalesce(after - before - 1 <= 2, false)", 1, f"(select *, max(case when bad then p end) {W[:-1]} rows unbounded preceding) as before, min(case when bad then p end) {W[:-1]} rows between current row and unbounded following) as after from (select *, row_number() {W} as p from {LINE}))"),
    "f12_heading_changes": f"select event_id, round(degrees(abs(m - floor(m / (2 * pi())) * 2 * pi() - pi())), 5) as turn from (select event_id, atan2(lead(y) {W} - y, lead(x) {W} - x) - atan2(y - lag(y) {W}, x - lag(x) {W}) + pi() as m from {LINE}) where degrees(abs(m - floor(m / (2 * pi())) * 2 * pi() - pi())) >= 60",
    "f16_local_step": "select p_partkey, round(least(greatest(2 * p_size / 10.0::double * tan(radians(30)) * 0.3::double, 0.25), 0.65), 9) as step from part",
    "f17_reference_depth": "select l_partkey, round(coalesce(quantile_cont(l_quantity, 0.4), 2), 6) as depth from lineitem group by 1",
    "f18_layer_heights": "select p_partkey, (k - 1)::int as layer, p_size * k / 4.0::double as z from part, range(1, 4) r(k)",
    "f19_lane_runs": islands_sql("not bad", 2),
    "f22_closed_gaps": f"select bad, bad or coalesce(after - before - 1 <= 1, false) as closed, count(*) as n from (select *, max(case when bad then p end) {W[:-1]} rows unbounded preceding) as before, min(case when bad then p end) {W[:-1]} rows between current row and unbounded following) as after from (select *, row_number() {W} as p from {LINE})) group by 1, 2",
    "f23_merge_segments": f"select l_suppkey, lo, hi, parts from {_MERGED.format(gap='1.0')}",
    "f28_chaikin": "with p as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as i, lead(event_id) over (partition by user_id order by event_id) is null as last, x, y, lead(x) over (partition by user_id order by event_id) as nx, lead(y) over (partition by user_id order by event_id) as ny from " + LINE + "), q as (select user_id, i, 0.0 as t, x, y from p where i = 1 or last union all select user_id, i, 0.25, x * 0.75 + nx * 0.25, y * 0.75 + ny * 0.25 from p where not last union all select user_id, i, 0.75, x * 0.25 + nx * 0.75, y * 0.25 + ny * 0.75 from p where not last) select user_id, cast(row_number() over (partition by user_id order by i, t) as int) as ord, round(x, 4) as x, round(y, 4) as y from q",
    "f33_order_and_overlap": f"select event_id, cast(row_number() {W} as int) as place, round(y - lag(y) {W}, 4) as jump from {LINE}",
    "f34_interval_subtraction": f"with m as (select * from {_MERGED.format(gap='0.0')}), w as (select l_suppkey, min(lo) as lo, max(hi) + 10 as hi from {SPANS} group by 1) select l_suppkey, hi as lo, nxt as hi from (select m.l_suppkey, m.hi, coalesce(lead(m.lo) over (partition by m.l_suppkey order by m.lo), w.hi) as nxt from m join w using (l_suppkey)) where hi < nxt",
    "f35_round_robin": "select s_suppkey, cast(row_number() over (order by r, s_nationkey) as int) as place from (select *, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as r from supplier)",
    "f36_stepped_points": "select n_nationkey, k * 0.5::double as at from (select n_nationkey, unnest(range(0, n_nationkey % 5 + 1)) as k from nation)",
    "f41_short_fragments": f"select user_id, round(max(along), 4) as length from {RUNNING} group by 1 having round(max(along), 4) >= 150",
    "e25_largest_remainder": f"select c_nationkey, share from {shares_sql(720)}",
    "e24_boosted_shares": "select c_nationkey, share + 8 as share from " + shares_sql(1000 - 8 * 25, f"(select c_nationkey, weight * least(8.0::double, greatest(1.0::double, (select median(weight) from {NATIONS}) / greatest(weight, 1e-12::double))) as w from {NATIONS})", "w"),
    "e27_at_least_one": f"select c_nationkey, share + 1 as share from {shares_sql(75)}",
    "e28_component_counts": f"select c_nationkey, least(40, ceil(weight / 5000))::bigint as share from {NATIONS}",
    "h4_even_ranks": "select p_partkey, p_retailprice from (select *, row_number() over (order by p_retailprice, p_partkey) - 1 as i, count(*) over () as n from part) where i in (select cast(round_even(k * ((select count(*) from part) - 1) / 23.0::double, 0) as bigint) from range(24) r(k))",
    "h5_even_by_group": "with r as (select p_partkey, p_brand, row_number() over (partition by p_brand order by p_partkey) - 1 as i, count(*) over (partition by p_brand) as n from part) select p_partkey, p_brand from r where n <= 5 or exists (select 1 from range(5) q(k) where cast(round_even(k * (n - 1) / 4.0::double, 0) as bigint) = i)",
    "h22_stride_and_last": "select p_partkey, p_brand from (select *, row_number() over (partition by p_brand order by p_partkey) - 1 as i, count(*) over (partition by p_brand) as n from part) where i % 7 = 0 or i = n - 1",
    "h33_systematic_sample": "select p_partkey, cast(floor(c / t * 500 + 0.5) - floor((c - p_size) / t * 500 + 0.5) as bigint) as taken from (select *, sum(p_size::double) over (order by p_partkey rows unbounded preceding) as c, sum(p_size::double) over () as t from part)",
    "b4_validation_split": "select p_partkey, case when i % s = 0 and i / s::double < w then 'validation' else 'train' end as split from (select *, greatest(1, floor(n / greatest(w, 1))) as s from (select p_partkey, row_number() over (order by p_partkey) - 1 as i, count(*) over () as n, ceil(count(*) over () * 0.1::double) as w from part))",
    "h12_prefilter": "select l_suppkey, l_partkey, score from (select *, row_number() over (partition by l_suppkey order by score desc, l_partkey) as r from (select l_suppkey, l_partkey, sum(l_quantity) as score from lineitem group by 1, 2)) where r <= 2 order by score desc, l_suppkey, l_partkey limit 64",
}
