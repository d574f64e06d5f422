"""Coverage and overlap queries; lineitem serves as the table of observations.

candidate l_suppkey, cell l_partkey, bin l_linenumber, category l_returnflag,
distance l_quantity, incidence l_discount * 900 degrees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators import coverage as C
from sightline.operators import overlap as O


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def obs(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("candidate"), F.col("l_partkey").alias("cell"), F.col("l_linenumber").alias("bin"), F.col("l_returnflag").alias("category"), F.col("l_quantity").alias("distance"), F.bround(F.col("l_discount") * 900, 3).alias("incidence"), (F.col("l_orderkey") % 16).alias("object"), F.col("l_orderkey").alias("ord")
    )


OBS = "(select l_suppkey as candidate, l_partkey as cell, l_linenumber as bin, l_returnflag as category, l_quantity as distance, round_even(l_discount * 900, 3) as incidence, l_orderkey % 16 as object, l_orderkey as ord from lineitem)"


def text(df: DataFrame, *arrays: str) -> DataFrame:
    return df.withColumns({c: F.array_join(F.col(c), ",") for c in arrays})


def e1(s, d):
    return text(C.coverage_by_cell(obs(s, d), cell="cell", candidate="candidate", incidence="incidence", distance="distance", bin="bin"), "bins", "candidates")


def e2(s, d):
    cells = obs(s, d).groupBy((F.col("cell") % 64).alias("x"), F.floor(F.col("cell") / 64).alias("y")).agg(F.min("incidence").alias("incidence"))
    return C.dilate(cells, "x", "y", "incidence", 1)


def e4(s, d):
    o = obs(s, d)
    return C.category_ratio(o.where("incidence <= 45"), o, cell="cell", category="category")


def e5(s, d):
    return C.coverage_statistics(obs(s, d), cell="cell", candidate="candidate", category="category", object_="object")


def e11(s, d):
    cov = obs(s, d).where("incidence <= 75").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("bin").alias("b"))
    return C.measure_targets(t(s, d, "part").select(F.col("p_partkey").alias("cell")), cov, key="cell", count="n", bins="b")


def e12(s, d):
    return C.region_summary(obs(s, d), group="object", x="cell", y="candidate", z="bin", category="category").withColumns({c: F.round(c, 6) for c in ("center_x", "center_y")})


def e35(s, d):
    cov = obs(s, d).where("incidence <= 20").groupBy("cell").agg(F.count(F.lit(1)).alias("m"))
    return C.under_observed(t(s, d, "part").select(F.col("p_partkey").alias("cell")), cov, key="cell", count="m", least=3, k=48)


def d16(s, d):
    o = obs(s, d)
    a, b = (o.where(f"category = '{x}'").groupBy("cell").agg(F.min("incidence").alias("incidence")) for x in "AN")
    return C.merge_first_wins([a, b], ["cell"], "incidence")


def supplier_edges(s, d):
    return O.overlap_edges(obs(s, d), candidate="candidate", cell="cell", least=0.01, strong=0.2)


EDGES = """(with seen as (select distinct candidate as c, cell from {obs}), n as (select c, count(*) as n from seen group by 1),
 p as (select x.c as a, y.c as b, count(*) as shared from seen x join seen y on x.cell = y.cell and x.c < y.c group by 1, 2)
 select a, b, shared, shared / least(na.n, nb.n)::double as ratio, shared / least(na.n, nb.n)::double >= 0.2 as strong from p join n na on na.c = a join n nb on nb.c = b where shared / least(na.n, nb.n)::double >= 0.01)""".format(obs=OBS)
BOTH = f"(select a as candidate, b as other, ratio from {EDGES} union all select b, a, ratio from {EDGES})"

QUERIES = {
    "e1_coverage_by_cell": e1,
    "e2_dilated_cells": e2,
    "e3_quality_cells": lambda s, d: C.best_by_key(obs(s, d).where("incidence <= 75"), ["candidate", "cell"], "incidence", ["distance", "bin"], []).groupBy("candidate").agg(F.count(F.lit(1)).alias("cells"), F.min("incidence").alias("least")),
    "e4_category_ratio": e4,
    "e5_coverage_statistics": e5,
    "e6_percentile": lambda s, d: obs(s, d).groupBy("object").agg(C.percentile_or("distance", 0.4).alias("p40"), C.percentile_or("incidence", 0.25).alias("p25")),
    "e7_percentile_or_zero": lambda s, d: obs(s, d).where("incidence > 1000").agg(C.percentile_or("distance", 0.4, 0.0).alias("p40"), C.percentile_or("distance", 0.4).alias("p40_null")),
    "e8_principal_axes": lambda s, d: C.principal_axes(obs(s, d), "object", "bin", "distance").select("object", *[F.round(c, 6).alias(c) for c in ("center_x", "center_y", "xx", "yy", "xy", "angle")]),
    "e9_floorplan_axes": lambda s, d: C.principal_axes(obs(s, d), "category", "distance", "incidence").select("category", *[F.round(c, 5).alias(c) for c in ("center_x", "center_y", "angle")]),
    "e10_median": lambda s, d: obs(s, d).groupBy("candidate").agg(F.median("distance").alias("median")),
    "e11_measure_targets": e11,
    "e12_region_summary": e12,
    "e13_top_regions": lambda s, d: C.top_groups(obs(s, d), "candidate", 8),
    "e14_existing_analysis": lambda s, d: text(C.coverage_by_cell(obs(s, d).join(t(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("candidate")), "candidate", "left_semi"), cell="cell", candidate="candidate", incidence="incidence", distance="distance", bin="bin"), "bins", "candidates"),
    "e15_sequence_report": lambda s, d: t(s, d, "orders").agg(F.count(F.lit(1)).alias("frames"), *[F.count_if(F.col("o_orderstatus") == x).alias(f"status_{x.lower()}") for x in "FOP"], F.count_if(F.col("o_totalprice") > 150000).alias("large")),
    "e16_consistency_report": lambda s, d: t(s, d, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_size")), ",").alias("sizes"), F.array_join(F.array_compact(F.array(F.when(F.count_distinct("p_size") > 1, F.lit("mixed sizes")), F.when(F.max("p_retailprice") > 1500, F.lit("price")))), ";").alias("warnings")),
    "e17_planning_report": lambda s, d: obs(s, d).groupBy("category").agg(F.count(F.lit(1)).alias("cameras"), (F.count(F.lit(1)) - F.count_distinct(F.struct(F.bround(F.col("distance") / 5), F.col("bin")))).alias("duplicate_origins")),
    "e18_duplicate_origins": lambda s, d: obs(s, d).agg((F.count(F.lit(1)) - F.count_distinct(F.struct("candidate", "cell", F.bround(F.col("distance") / 2)))).alias("duplicates")),
    "e19_first_per_voxel": lambda s, d: C.first_per_voxel(obs(s, d).select("candidate", "cell", "bin", "distance", "ord"), [F.bround(F.col("distance") / 10), F.bround(F.col("cell") / 100)], ["candidate", "ord", "bin", "cell", "distance"]),
    "e20_upper_median": lambda s, d: obs(s, d).groupBy("object").agg(F.round(F.avg("distance"), 9).alias("mean"), C.upper_median("distance").alias("median"), F.count_if(F.col("distance") < 5).alias("short")),
    "e29_set_fingerprint": lambda s, d: C.set_fingerprint(obs(s, d), "object", ["candidate", "cell", "bin"]),
    "e32_settings_signature": lambda s, d: t(s, d, "nation").select("n_nationkey", F.substring(F.sha1(F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string"))), 1, 16).alias("signature")),
    "e35_under_observed": e35,
    "e36_latest_and_history": lambda s, d: C.latest_and_history(t(s, d, "events"), group="user_id", order="event_id", value="value"),
    "c5_near_field": lambda s, d: C.near_field(obs(s, d), candidate="candidate", distance="distance", surface="category", near=5.0, mid=20.0),
    "c40_satisfied": lambda s, d: e11(s, d).select("satisfied"),
    "d2_best_observation": lambda s, d: C.best_by_key(obs(s, d), ["candidate", "cell"], "incidence", ["distance", "bin", "ord"], []),
    "d12_overlap_edges": supplier_edges,
    "d13_neighbour_mean": lambda s, d: O.neighbour_counts(supplier_edges(s, d), 0.05),
    "d14_strong_neighbours": lambda s, d: O.neighbour_counts(supplier_edges(s, d), 0.2).select("candidate", "neighbours"),
    "d15_context_overlap": lambda s, d: O.context_overlap(obs(s, d).where("candidate % 2 = 0"), obs(s, d).where("candidate % 2 = 1"), candidate="candidate", cell="cell", least=0.02),
    "d16_merge_first_wins": d16,
    "d17_all_visible": lambda s, d: obs(s, d).groupBy("cell").agg(F.min("incidence").alias("incidence")),
    "d31_edge_lookup": lambda s, d: O.edge_lookup(supplier_edges(s, d).select(F.col("b").alias("a"), F.col("a").alias("b"), "ratio")),
}

_COV = "select cell, count(*) as observations, min(incidence) as min_incidence, min(distance) as min_distance, max(distance) as max_distance, array_to_string(list_sort(list(distinct bin)), ',') as bins, array_to_string(list_sort(list(distinct candidate)), ',') as candidates from {o} where incidence <= 75 group by cell"
_E11 = f"(with c as (select cell, count(*) as n, count(distinct bin) as b from {OBS} where incidence <= 75 group by 1), x as (select count(*) as targets, count(*) filter (where coalesce(n, 0) >= 3) as at_minimum, count(*) filter (where coalesce(n, 0) >= 5) as at_recommended, count(*) filter (where coalesce(b, 0) >= 2) as parallax from (select distinct p_partkey as cell from part) left join c using (cell)) select *, at_minimum / greatest(1, targets)::double as minimum_ratio, parallax / greatest(1, targets)::double as parallax_ratio, at_minimum / greatest(1, targets)::double >= 0.95 and parallax / greatest(1, targets)::double >= 0.95 as satisfied from x)"
SQL = {
    "e1_coverage_by_cell": _COV.format(o=OBS),
    "e2_dilated_cells": f"with c as (select cell % 64 as x, cell // 64 as y, min(incidence) as incidence from {OBS} group by 1, 2) select x + dx as x, y + dy as y, min(incidence) as incidence from c, range(-1, 2) r(dx), range(-1, 2) q(dy) group by 1, 2",
    "e3_quality_cells": f"select candidate, count(*) as cells, min(i) as least from (select candidate, cell, min(incidence) as i from {OBS} where incidence <= 75 group by 1, 2) group by 1",
    "e4_category_ratio": f"with v as (select distinct cell, category from {OBS}), s as (select distinct cell from {OBS} where incidence <= 45) select category, count(s.cell) as observed, count(*) as visible, count(s.cell) / count(*)::double as ratio from v left join s using (cell) group by 1",
    "e5_coverage_statistics": f"with p as (select object, category, cell, count(*) as n, count(distinct candidate) as origins from {OBS} group by 1, 2, 3) select category, object, grouping(category, object) as level, count(*) as cells, count(*) filter (where n >= 3) as at_minimum, count(*) filter (where n >= 5) as at_preferred, cast(sum(n) as bigint) as observations, max(origins) as most_origins, count(*) filter (where n >= 3) / greatest(1, count(*))::double as ratio_minimum from p group by grouping sets ((), (category), (object))",
    "e6_percentile": f"select object, quantile_cont(distance, 0.4) as p40, quantile_cont(incidence, 0.25) as p25 from {OBS} group by 1",
    "e7_percentile_or_zero": f"select coalesce(quantile_cont(distance, 0.4), 0.0) as p40, quantile_cont(distance, 0.4) as p40_null from {OBS} where incidence > 1000",
    "e8_principal_axes": f"select object, round(avg(bin), 6) as center_x, round(avg(distance), 6) as center_y, round(var_pop(bin), 6) as xx, round(var_pop(distance), 6) as yy, round(covar_pop(bin, distance), 6) as xy, round(0.5 * atan2(2 * covar_pop(bin, distance), var_pop(bin) - var_pop(distance)), 6) as angle from {OBS} group by 1",
    "e9_floorplan_axes": f"select category, round(avg(distance), 5) as center_x, round(avg(incidence), 5) as center_y, round(0.5 * atan2(2 * covar_pop(distance, incidence), var_pop(distance) - var_pop(incidence)), 5) as angle from {OBS} group by 1",
    "e10_median": f"select candidate, median(distance) as median from {OBS} group by 1",
    "e11_measure_targets": f"select * from {_E11}",
    "e12_region_summary": f"with m as (select object, category, count(*) as n from {OBS} group by 1, 2), k as (select object, arg_min(category, (-n, category)) as c from m group by 1), b as (select object, count(*) as cells, min(cell) as min_x, max(cell) as max_x, min(candidate) as min_y, max(candidate) as max_y, min(bin) as min_z, max(bin) as max_z, round(avg(cell), 6) as center_x, round(avg(candidate), 6) as center_y from {OBS} group by 1) select b.*, case when max_z - min_z <= 0.2 * greatest(max_x - min_x, max_y - min_y) then 'slab' else c end as kind from b join k using (object)",
    "e13_top_regions": f"select candidate, count(*) as n from {OBS} group by 1 order by n desc, candidate limit 8",
    "e14_existing_analysis": _COV.format(o=f"(select * from {OBS} where candidate in (select s_suppkey from supplier where s_acctbal > 0))"),
    "e15_sequence_report": "select count(*) as frames, count(*) filter (where o_orderstatus = 'F') as status_f, count(*) filter (where o_orderstatus = 'O') as status_o, count(*) filter (where o_orderstatus = 'P') as status_p, count(*) filter (where o_totalprice > 150000) as large from orders",
    "e16_consistency_report": "select p_brand, array_to_string(list_sort(list(distinct p_size)), ',') as sizes, concat_ws(';', case when count(distinct p_size) > 1 then 'mixed sizes' end, case when max(p_retailprice) > 1500 then 'price' end) as warnings from part group by 1",
    "e17_planning_report": f"select category, count(*) as cameras, count(*) - count(distinct (round_even(distance / 5, 0), bin)) as duplicate_origins from {OBS} group by 1",
    "e18_duplicate_origins": f"select count(*) - count(distinct (candidate, cell, round_even(distance / 2, 0))) as duplicates from {OBS}",
    "e19_first_per_voxel": f"select candidate, cell, bin, distance, ord from (select *, row_number() over (partition by round_even(distance / 10, 0), round_even(cell / 100.0::double, 0) order by candidate, ord, bin, cell, distance) as n from {OBS}) where n = 1",
    "e20_upper_median": f"select object, round(avg(distance), 9) as mean, list_sort(list(distance))[count(*) // 2 + 1] as median, count(*) filter (where distance < 5) as short from {OBS} group by 1",
    "e29_set_fingerprint": f"select object, sha256(string_agg(d, '' order by d)) as fingerprint from (select object, sha256(concat_ws('|', candidate, cell, bin)) as d from {OBS}) group by 1",
    "e32_settings_signature": "select n_nationkey, left(sha1(concat_ws('|', n_nationkey, n_name, n_regionkey)), 16) as signature from nation",
    "e35_under_observed": f"with c as (select cell, count(*) as m from {OBS} where incidence <= 20 group by 1) select cell, coalesce(m, 0) as n from (select distinct p_partkey as cell from part) left join c using (cell) where coalesce(m, 0) < 3 order by n, cell limit 48",
    "e36_latest_and_history": "select user_id, arg_max(value, event_id) as latest, max(event_id) as last_run, count(*) as runs from events group by 1",
    "c5_near_field": f"with k as (select candidate, category, count(*) as n from {OBS} group by 1, 2), m as (select candidate, arg_max(category, (n, category)) as surface, max(n) as n from k group by 1), d as (select candidate, min(distance) as nearest, quantile_cont(distance, 0.25) as p25, count(*) as rays from {OBS} group by 1) select candidate, nearest, p25, rays, surface, n / rays::double as share, case when nearest < 5 or p25 < 5 and n / rays::double >= 0.65 then 'NEAR' when p25 < 20 then 'MID' else 'FAR' end as band from d join m using (candidate)",
    "c40_satisfied": f"select satisfied from {_E11}",
    "d2_best_observation": f"select candidate, cell, incidence, distance, bin, ord from (select *, row_number() over (partition by candidate, cell order by incidence, distance, bin, ord) as n from {OBS}) where n = 1",
    "d12_overlap_edges": f"select * from {EDGES}",
    "d13_neighbour_mean": f"select candidate, count(*) filter (where ratio >= 0.05) as neighbours, round(avg(ratio), 9) as mean_ratio, arg_min(other, (-ratio, other)) as best, max(ratio) as best_ratio from {BOTH} group by 1",
    "d14_strong_neighbours": f"select candidate, count(*) filter (where ratio >= 0.2) as neighbours from {BOTH} group by 1",
    "d15_context_overlap": f"with a as (select distinct candidate as c, cell from {OBS} where candidate % 2 = 0), b as (select distinct candidate as o, cell from {OBS} where candidate % 2 = 1), p as (select c, o, count(*) as k from a join b using (cell) group by 1, 2), r as (select c, o, k / least((select count(*) from a x where x.c = p.c), (select count(*) from b y where y.o = p.o))::double as ratio from p) select c as candidate, arg_min(o, (-ratio, o)) as best, max(ratio) as ratio, count(*) filter (where ratio >= 0.02) as connected from r group by 1",
    "d16_merge_first_wins": f"select cell, incidence, source from (select *, row_number() over (partition by cell order by incidence, source) as n from (select cell, min(incidence) as incidence, 0 as source from {OBS} where category = 'A' group by 1 union all select cell, min(incidence), 1 from {OBS} where category = 'N' group by 1)) where n = 1",
    "d17_all_visible": f"select cell, min(incidence) as incidence from {OBS} group by 1",
    "d31_edge_lookup": f"select a as lo, b as hi, ratio from {EDGES}",
}
