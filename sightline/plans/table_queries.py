"""Validation, update and stateful queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline.operators import validate as V
from sightline.operators.order import placed
from sightline.plans.coverage_queries import t

RULES = {"positive": "l_quantity > 30", "discount_range": "l_discount between 0.0D and 0.09D", "finite": "not isnan(l_extendedprice)", "shipped": "l_shipdate is not null"}
NEEDS = {"O": ["depth", "mask"], "F": ["normal"], "depth": ["mask"], "mask": ["ids"], "normal": ["ids"]}
FAULTS = {"twos": "2[0-9]", "sevens": "7", "key": '"k"'}


def known(s, d):
    return t(s, d, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("n"), F.col("s_nationkey")).alias("name"), F.col("s_suppkey").alias("id"))


def painted(s, d):
    e = t(s, d, "events").select((F.col("user_id") % 40).alias("cell"), "event_id", "value", (F.col("event_type") == "purchase").alias("erase"))
    base = s.range(30).select(F.col("id").alias("cell"), F.lit(-1).cast("long").alias("event_id"), F.lit(0.0).alias("value"))
    return V.upsert(base, e, ["cell"], "event_id", "erase")


def frames(s, d):
    return t(s, d, "orders").select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") < 300) | (F.col("o_orderstatus") == "F")).alias("done"))


def numbered(s, d):
    p = placed(t(s, d, "part").select("p_partkey", (F.col("p_size") > 40).alias("patch"), (F.col("p_size") <= 40).cast("long").alias("own")), ["p_partkey"], total="own")
    pad = lambda c: F.lpad(c.cast("string"), 4, "0")
    return p.select("p_partkey", F.when(F.col("patch"), F.concat(F.lit("patch_"), pad(F.col("p_partkey")))).otherwise(F.concat(F.lit("image_"), pad(F.col("before") + F.col("own")))).alias("stem"))


QUERIES = {
    "i1_snapshot": lambda s, d: t(s, d, "nation").select("n_nationkey", "n_name"),
    "i2_append_with_ids": lambda s, d: V.append_with_ids(t(s, d, "nation").select("n_nationkey", "n_name"), t(s, d, "region").select(F.lit(0).alias("n_nationkey"), F.col("r_name").alias("n_name")), "n_nationkey", ["n_name"]),
    "i3_promote": lambda s, d: V.promote(t(s, d, "nation").where("n_nationkey % 2 = 0").select("n_nationkey", "n_name"), t(s, d, "nation").where("n_nationkey % 3 = 0").select("n_nationkey", "n_name"), "n_name"),
    "i4_stable_ids": lambda s, d: V.stable_ids(t(s, d, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey")).alias("name")), known(s, d), "name", "id"),
    "i5_row_rules": lambda s, d: V.row_rules(t(s, d, "lineitem"), RULES),
    "i6_orphans": lambda s, d: V.orphans(t(s, d, "lineitem").select("l_orderkey", "l_linenumber"), t(s, d, "orders").where("o_orderkey % 50 <> 7"), "l_orderkey", "o_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines")),
    "i7_completeness": lambda s, d: V.completeness(t(s, d, "lineitem").select("l_suppkey", "l_returnflag"), t(s, d, "lineitem").where("l_quantity > 40").select("l_suppkey", "l_returnflag"), ["l_suppkey"], "l_returnflag"),
    "i9_violations": lambda s, d: V.with_violations(t(s, d, "lineitem"), RULES).groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count(F.lit(1)).alias("n")),
    "i10_all_match": lambda s, d: V.all_match(t(s, d, "part"), "p_brand", F.lit("Brand#1")),
    "i13_chunk_bounds": lambda s, d: V.chunk(frames(s, d), "id", "done", 25),
    "i14_required_passes": lambda s, d: V.closure(t(s, d, "orders").select("o_orderkey", F.array("o_orderstatus").alias("w")), NEEDS, "w").select("o_orderkey", F.array_join("required", ",").alias("required")),
    "i16_finish": lambda s, d: frames(s, d).agg(F.bool_and("done").alias("finished"), F.min(F.when(~F.col("done"), F.col("id"))).alias("next")),
    "i17_freeze": lambda s, d: t(s, d, "orders").groupBy(F.when(F.col("o_orderstatus") == "P", "O").otherwise(F.col("o_orderstatus")).alias("state")).agg(F.count(F.lit(1)).alias("n")),
    "i18_adapters": lambda s, d: t(s, d, "orders").where("o_orderstatus = 'O' and o_orderpriority = '1-URGENT'").select("o_orderkey"),
    "j3_log_faults": lambda s, d: V.log_faults(t(s, d, "events"), "props", FAULTS).select("event_id", F.array_join("faults", ",").alias("faults")),
    "j4_log_faults_backend": lambda s, d: V.log_faults(t(s, d, "events"), "props", FAULTS, ignore=["key"]).groupBy(F.array_join("faults", ",").alias("faults")).agg(F.count(F.lit(1)).alias("n")),
    "j6_paint": painted,
    "j7_undo_log": lambda s, d: V.last_operations(t(s, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", 5),
    "a2_distinct_instances": lambda s, d: t(s, d, "part").where("p_size > 10").groupBy("p_brand", F.round("p_retailprice", -1).alias("price")).agg(F.min("p_partkey").alias("first")),
    "a4_bounds": lambda s, d: t(s, d, "part").agg(F.coalesce(F.min("p_size"), F.lit(0)).alias("lo"), F.coalesce(F.max("p_size"), F.lit(1)).alias("hi"), F.min("p_retailprice").alias("price_lo"), F.max("p_retailprice").alias("price_hi")),
    "a13_object_groups": lambda s, d: t(s, d, "nation").join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("members"), F.min("n_nationkey").alias("first")),
    "a17_conditional_numbers": numbered,
    "a20_conflicts": lambda s, d: t(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("l_partkey").alias("versions")).where("versions > 1"),
    "a23_json_defaults": lambda s, d: t(s, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("k"), F.coalesce(F.get_json_object("props", "$.none"), F.lit("default")).alias("missing")),
    "a24_union_parts": lambda s, d: t(s, d, "supplier").select(F.lit(0).alias("part"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance")).unionByName(t(s, d, "customer").select(F.lit(1).alias("part"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))),
    "a28_material_ids": lambda s, d: t(s, d, "part").select("p_type").distinct().withColumn("id", F.row_number().over(Window.orderBy("p_type"))),
    "a30_candidates": lambda s, d: t(s, d, "events").select("event_id", F.round(F.degrees(F.atan2(F.col("value") - 50, F.col("user_id") + 1.0)), 6).alias("yaw")),
    "b1_intrinsics_profiles": lambda s, d: t(s, d, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("first"), F.count(F.lit(1)).alias("cameras")).withColumn("camera_id", F.row_number().over(Window.orderBy("first"))),
    "b3_report": lambda s, d: t(s, d, "orders").agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("o_custkey").alias("customers"), F.round(F.max("o_totalprice"), 2).alias("largest"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last")),
    "b7_global_triangles": lambda s, d: t(s, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("triangles")).withColumn("offset", F.coalesce(F.sum("triangles").over(Window.orderBy("l_suppkey").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))),
    "b20_commit_markers": lambda s, d: t(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_linenumber")), ",").alias("files")),
}
_RULES = [("positive", "l_quantity > 30"), ("discount_range", "l_discount between 0.0 and 0.09::double"), ("finite", "not isnan(l_extendedprice)"), ("shipped", "l_shipdate is not null")]
_FAULT = "concat_ws(',', case when regexp_matches(props, '2[0-9]') then 'twos' end, case when regexp_matches(props, '7') then 'sevens' end{k})"
SQL = {
    "i1_snapshot": "select n_nationkey, n_name from nation",
    "i2_append_with_ids": "select n_nationkey, n_name from nation union all select cast((select max(n_nationkey) from nation) + row_number() over (order by r_name) as int), r_name from region",
    "i3_promote": "select n_nationkey, n_name from nation where n_nationkey % 2 = 0 or n_nationkey % 3 = 0",
    "i4_stable_ids": "with k as (select 'n' || s_nationkey as name, min(s_suppkey) as id from supplier where s_suppkey % 3 = 0 group by 1), top as (select coalesce(max(s_suppkey), 0) as m from supplier where s_suppkey % 3 = 0), n as (select distinct 'n' || c_nationkey as name from customer) select name, id from n join k using (name) union all select name, cast(m + row_number() over (order by name) as bigint) from n, top where name not in (select name from k)",
    "i5_row_rules": " union all ".join(f"select '{n}' as rule, count(*) filter (where not ({c})) as broken, count(*) as rows, count(*) filter (where not ({c})) = 0 as valid from lineitem" for n, c in _RULES),
    "i6_orphans": "select l_orderkey, count(*) as lines from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 50 <> 7) group by 1",
    "i7_completeness": "with e as (select distinct l_suppkey, l_returnflag from lineitem), f as (select distinct l_suppkey, l_returnflag from lineitem where l_quantity > 40) select l_returnflag, count(*) as expected, count(f.l_suppkey) as found, count(*) - count(f.l_suppkey) as missing, count(*) = count(f.l_suppkey) as complete from e left join f using (l_suppkey, l_returnflag) group by 1",
    "i9_violations": "select concat_ws(',', " + ", ".join(f"case when not ({c}) then '{n}' end" for n, c in _RULES) + ") as violations, count(*) as n from lineitem group by 1",
    "i10_all_match": "select bool_and(p_brand = 'Brand#1') as match, count(distinct p_brand) as kinds from part",
    "i13_chunk_bounds": "select start, least(start + 24, last) as \"end\", open, open = 0 as finished from (select min(o_orderkey) filter (where not (o_orderkey < 300 or o_orderstatus = 'F')) as start, max(o_orderkey) as last, count(*) filter (where not (o_orderkey < 300 or o_orderstatus = 'F')) as open from orders)",
    "i14_required_passes": "select o_orderkey, case o_orderstatus when 'O' then 'O,depth,ids,mask' when 'F' then 'F,ids,normal' else o_orderstatus end as required from orders",
    "i16_finish": "select bool_and(o_orderkey < 300 or o_orderstatus = 'F') as finished, min(o_orderkey) filter (where not (o_orderkey < 300 or o_orderstatus = 'F')) as next from orders",
    "i17_freeze": "select case when o_orderstatus = 'P' then 'O' else o_orderstatus end as state, count(*) as n from orders group by 1",
    "i18_adapters": "select o_orderkey from orders where o_orderstatus = 'O' and o_orderpriority = '1-URGENT'",
    "j3_log_faults": "select event_id, " + _FAULT.format(k=", case when regexp_matches(props, '\"k\"') then 'key' end") + " as faults from events",
    "j4_log_faults_backend": "select " + _FAULT.format(k="") + " as faults, count(*) as n from events group by 1",
    "j6_paint": "with l as (select user_id % 40 as cell, arg_max(event_type, event_id) as k, max(event_id) as event_id, arg_max(value, event_id) as value from events group by 1) select r.cell, -1::bigint as event_id, 0.0::double as value from range(30) r(cell) where cell not in (select cell from l) union all select cell, event_id, value from l where k <> 'purchase'",
    "j7_undo_log": "select user_id, event_id, event_type, cast(depth as int) as depth from (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id desc) as depth from events) where depth <= 5",
    "a2_distinct_instances": "select p_brand, round(p_retailprice, -1) as price, min(p_partkey) as first from part where p_size > 10 group by 1, 2",
    "a4_bounds": "select min(p_size) as lo, max(p_size) as hi, min(p_retailprice) as price_lo, max(p_retailprice) as price_hi from part",
    "a13_object_groups": "select r_name, string_agg(n_name, ',' order by n_name) as members, min(n_nationkey) as first from nation join region on n_regionkey = r_regionkey group by 1",
    "a17_conditional_numbers": "select p_partkey, case when p_size > 40 then 'patch_' || lpad(p_partkey::varchar, 4, '0') else 'image_' || lpad((sum(case when p_size > 40 then 0 else 1 end) over (order by p_partkey rows unbounded preceding))::varchar, 4, '0') end as stem from part",
    "a20_conflicts": "select l_orderkey, l_linenumber, count(*) as rows, count(distinct l_partkey) as versions from lineitem group by 1, 2 having count(distinct l_partkey) > 1",
    "a23_json_defaults": "select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as bigint), 0) as k, coalesce(json_extract_string(props, '$.none'), 'default') as missing from events",
    "a24_union_parts": "select 0 as part, s_suppkey as key, s_acctbal as balance from supplier union all select 1, c_custkey, c_acctbal from customer",
    "a28_material_ids": "select p_type, cast(row_number() over (order by p_type) as int) as id from (select distinct p_type from part)",
    "a30_candidates": "select event_id, round(degrees(atan2(value - 50, user_id + 1.0::double)), 6) as yaw from events",
    "b1_intrinsics_profiles": "select p_brand, first, cameras, cast(row_number() over (order by first) as int) as camera_id from (select p_brand, min(p_partkey) as first, count(*) as cameras from part group by 1)",
    "b3_report": "select count(*) as orders, count(distinct o_custkey) as customers, round(max(o_totalprice), 2) as largest, min(o_orderdate) as first, max(o_orderdate) as last from orders",
    "b7_global_triangles": "select l_suppkey, triangles, cast(coalesce(sum(triangles) over (order by l_suppkey rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\" from (select l_suppkey, count(*) as triangles from lineitem group by 1)",
    "b20_commit_markers": "select l_orderkey, array_to_string(list_sort(list(distinct l_linenumber)), ',') as files from lineitem group by 1",
}
