"""Pixel and resumption queries: lineitem as pixels of frames, part as points and files, nation as a legend."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import pixels as P
from sightline.operators import resume as R
from sightline.plans.coverage_queries import t


def lit_pixels(s, d):
    """Pixels of one frame an order key modulo 16, one a line item, with depth, alpha and a normal."""
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return t(s, d, "lineitem").select(k.alias("id"), (F.col("l_orderkey") % 16).alias("frame"), F.col("l_quantity").cast("double").alias("depth"), F.when(F.col("l_returnflag") == "A", 0.2).otherwise(1.0).alias("alpha"), F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.when(F.col("l_orderkey") % 16 == 3, 0.9).otherwise(1.0).alias("nz"), (F.col("l_suppkey") - F.when(F.col("l_orderkey") % 16 == 5, 1).otherwise(0)).alias("triangle"), (F.col("l_linenumber") % 4 / 3.0).alias("r"), (F.col("l_suppkey") % 3 / 2.0).alias("g"), (F.col("l_quantity") % 2 / 4.0).cast("double").alias("b"))


def legend(s, d):
    n = F.col("n_nationkey")
    return t(s, d, "nation").where("n_nationkey < 12").select(n.alias("position"), F.concat(F.lit("obj "), n.cast("string")).alias("name"), (n % 4 / 3.0).alias("r"), (F.floor(n / 4) / 2.0).alias("g"), F.lit(0.0).alias("b"))


def split(s, d, valid=None):
    return P.split_by_object(lit_pixels(s, d), legend(s, d), valid=valid)


def texels(s, d):
    """One 8 x 6 texture a region."""
    cell = F.explode(F.sequence(F.lit(0), F.lit(47)))
    k = F.col("k")
    return t(s, d, "region").select(F.col("r_regionkey").alias("image"), cell.alias("k")).select("image", (k % 8).cast("long").alias("ix"), F.floor(k / 8).alias("iy"), ((k * 7 + F.col("image")) % 10 / 10.0).alias("r"), (k % 3 / 2.0).alias("g"), F.lit(0.25).alias("b"))


def sizes(s, d):
    return t(s, d, "region").select(F.col("r_regionkey").alias("image"), F.lit(8).alias("width"), F.lit(6).alias("height"))


def uv(s, d):
    return t(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 7).alias("image"), (F.col("p_size") / 20.0 - 1).alias("s"), (F.col("p_partkey") % 13 / 10.0).alias("t"))


def sampled(s, d):
    m = t(s, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("material"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey") % 5).alias("image"), F.when(F.col("n_nationkey") % 4 != 0, F.lit(0.3)).alias("rough"), F.lit(0.9).alias("r"), F.lit(0.8).alias("g"), F.lit(0.7).alias("b"))
    p = uv(s, d).select("id", (F.col("id") % 25).cast("int").alias("material"), "s", "t")
    return P.sampled_materials(p, m, texels(s, d), sizes(s, d), defaults={"r": 0.5, "g": 0.5, "b": 0.5, "rough": 0.6})


def files(s, d):
    """Two files a part; every seventh is missing and every eleventh invalid."""
    k = F.col("p_partkey")
    e = t(s, d, "part").select(k.alias("frame"), F.concat(F.lit("s"), k.cast("string")).alias("stem"), F.explode(F.array(F.lit("rgb"), F.lit("depth"))).alias("kind")).withColumn("path", F.concat_ws("/", "kind", "stem"))
    listing = e.where("frame % 7 <> 0 or kind = 'rgb'").select("path", (F.col("frame") % 11 != 0).alias("valid"))
    markers = t(s, d, "part").where("p_partkey % 3 <> 0").select(k.alias("frame"), F.when(k % 5 == 0, "OTHER").otherwise("CAMERA_OBJECTS").alias("backend"), F.concat(F.lit("s"), k.cast("string")).alias("stem"), F.when(k % 4 == 0, F.array(F.lit("rgb/none"))).otherwise(F.array(F.concat(F.lit("rgb/s"), k.cast("string")))).alias("files"))
    return e, listing, markers


def complete(s, d):
    e, listing, markers = files(s, d)
    return R.complete(e, listing, markers)


def legacy(s, d, per_object=False):
    e, listing, markers = files(s, d)
    return R.legacy_complete(e, listing, markers, per_object=per_object)


QUERIES = {
    "a22_latest_state": lambda s, d: R.latest_state(t(s, d, "orders").select((F.col("o_custkey") % 50).alias("root"), F.concat(F.lit("p"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("path"), (F.col("o_orderstatus") != "P").alias("finished"), F.col("o_orderdate").alias("modified")), group=["root"]).select("root", "path", "finished"),
    "a27_described": lambda s, d: P.described(t(s, d, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, 0.1).alias("node_rough"), F.lit(0.4).alias("plain_rough"), F.when(F.col("n_nationkey") % 3 == 0, 1.0).alias("node_metal"), F.when(F.col("n_nationkey") % 4 == 0, "x").alias("image"), F.when(F.col("n_nationkey") % 5 == 0, True).alias("packed")), ["node", "plain"], defaults={"rough": 0.5, "metal": 0.0}),
    "b17_zipped": lambda s, d: P.zipped(t(s, d, "part").select(F.format_string("f%07d", "p_partkey").alias("name")), t(s, d, "part").select(F.format_string("c%07d", F.col("p_partkey") * 2).alias("camera"))).select("position", "name", "camera", "split"),
    "b21_mask_images": lambda s, d: P.images(lit_pixels(s, d).select("frame", (F.col("id") % 64).alias("u"), (F.floor(F.col("id") / 64) % 48).alias("v"), F.lit(255).alias("white")), group=["frame"], value="white", width=64, height=48).select("frame", (F.substring("content", 2, 3) == F.lit(b"PNG")).alias("png"), F.hex(F.substring("content", 17, 8)).alias("size")),
    "b22_object_depth": lambda s, d: split(s, d, F.col("depth") > 10).groupBy("frame", "object").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("depth")),
    "b23_object_masks": lambda s, d: split(s, d).groupBy("frame", "object").agg(F.count(F.lit(1)).alias("n")),
    "b24_object_normals": lambda s, d: split(s, d, F.col("alpha") > 0.5).groupBy("frame", "object").agg(F.count(F.lit(1)).alias("n"), F.min("nz").alias("nz")),
    "c34_sampled_materials": lambda s, d: sampled(s, d).select("id", *[F.round(c, 9).alias(c) for c in ("r", "g", "b", "rough")]),
    "c35_bilinear": lambda s, d: P.bilinear(uv(s, d), texels(s, d), sizes(s, d), channels=["r", "g"]).select("id", F.round("r", 9).alias("r"), F.round("g", 9).alias("g")),
    "d23_flipped_ids": lambda s, d: P.flipped_ids(lit_pixels(s, d).withColumn("u", F.col("id") % 64).withColumn("v", F.floor(F.col("id") / 64) % 48), legend(s, d), height=48).groupBy("v", "value").agg(F.count(F.lit(1)).alias("n")),
    "i8_frame_checks": lambda s, d: P.frame_checks(s.range(18).select(F.col("id").alias("frame")), lit_pixels(s, d), triangles=1_000_000_000).select("frame", F.array_join("errors", ",").alias("errors")),
    "i11_complete": complete,
    "i12_recovered": lambda s, d: R.recovered(legacy(s, d)),
    "i15_legacy_complete": lambda s, d: legacy(s, d, True).select("frame", "complete"),
}

_PX = "(select l_orderkey * 10 + l_linenumber as id, l_orderkey % 16 as frame, l_quantity::double as depth, case when l_returnflag = 'A' then 0.2::double else 1 end as alpha, case when l_orderkey % 16 = 3 then 0.9::double else 1 end as nz, l_linenumber % 4 as i, l_suppkey % 3 as j, l_quantity::int % 2 as h, l_suppkey from lineitem)"
#: the legend's colours are the pixels' own, but for the blue of odd quantities, which is too far
_OBJ = f"(select *, 'obj_' || (j * 4 + i) as object from {_PX} where h = 0)"
_TAP = """(with uv as (select p_partkey as id, {image} as image, p_size / 20.0::double - 1 as s, p_partkey % 13 / 10.0::double as t from part),
f as (select *, (s - floor(s)) * 7 as fx, (t - floor(t)) * 5 as fy from uv where image between 0 and 4),
k as (select id, image, least(floor(fx) + dx, 7)::bigint * 1 as ix, least(floor(fy) + dy, 5)::bigint as iy, (case when dx = 1 then fx - floor(fx) else 1 - (fx - floor(fx)) end) * (case when dy = 1 then fy - floor(fy) else 1 - (fy - floor(fy)) end) as w from f, (values (0), (1)) a(dx), (values (0), (1)) b(dy))
select id, sum(w * (((iy * 8 + ix) * 7 + image) % 10 / 10.0::double)) as r, sum(w * ((iy * 8 + ix) % 3 / 2.0::double)) as g, sum(w * 0.25::double) as b from k group by id)"""
_FILES = "(select p_partkey as frame, p_partkey % 7 <> 0 and p_partkey % 11 <> 0 as have, p_partkey % 3 <> 0 as mark, p_partkey % 5 <> 0 as own, p_partkey % 4 <> 0 and p_partkey % 11 <> 0 as marked from part)"
SQL = {
    "a22_latest_state": "select root, path, finished from (select o_custkey % 50 as root, 'p' || lpad(o_orderkey::varchar, 9, '0') as path, o_orderstatus <> 'P' as finished, row_number() over (partition by o_custkey % 50 order by o_orderstatus <> 'P', o_orderdate desc, 'p' || lpad(o_orderkey::varchar, 9, '0') desc) as k from orders) where k = 1",
    "a27_described": "select n_name as name, case when n_nationkey % 2 = 0 then 0.1::double else 0.4 end as rough, case when n_nationkey % 3 = 0 then 1.0::double else 0 end as metal, n_nationkey % 4 <> 0 as procedural, n_nationkey % 5 = 0 as packed from nation",
    "b17_zipped": "select k as position, 'f' || lpad(p::varchar, 7, '0') as name, 'c' || lpad((p * 2)::varchar, 7, '0') as camera, case when k % 8 = 0 then 'validation' else 'train' end as split from (select p_partkey as p, row_number() over (order by p_partkey) - 1 as k from part)",
    "b21_mask_images": "select distinct l_orderkey % 16 as frame, true as png, '0000004000000030' as size from lineitem",
    "b22_object_depth": f"select frame, object, count(*) as n, max(depth) as depth from {_OBJ} where depth > 10 group by 1, 2",
    "b23_object_masks": f"select frame, object, count(*) as n from {_OBJ} group by 1, 2",
    "b24_object_normals": f"select frame, object, count(*) as n, min(nz) as nz from {_OBJ} where alpha > 0.5 group by 1, 2",
    "c34_sampled_materials": f"select p_partkey as id, round(case when m >= 20 then 0.5::double when m % 3 = 0 then x.r else 0.9 end, 9) as r, round(case when m >= 20 then 0.5::double when m % 3 = 0 then x.g else 0.8 end, 9) as g, round(case when m >= 20 then 0.5::double when m % 3 = 0 then x.b else 0.7 end, 9) as b, case when m >= 20 or m % 4 = 0 then 0.6::double else 0.3 end as rough from (select *, p_partkey % 25 as m from part) left join {_TAP.format(image='case when p_partkey % 25 < 20 and p_partkey % 25 % 3 = 0 then p_partkey % 25 % 5 else -1 end')} x on x.id = p_partkey",
    "c35_bilinear": f"select p_partkey as id, round(x.r, 9) as r, round(x.g, 9) as g from part left join {_TAP.format(image='p_partkey % 7')} x on x.id = p_partkey",
    "d23_flipped_ids": f"select 47 - id // 64 % 48 as v, case when h = 0 then j * 4 + i + 1 else -1 end::int as value, count(*) as n from {_PX} group by 1, 2",
    "i8_frame_checks": f"select f as frame, case when n is null then 'no pixels' else concat_ws(',', case when nz then 'normal' end, case when tri then 'triangle' end) end as errors from range(18) r(f) left join (select frame, count(*) as n, bool_or(alpha > 0.5 and nz < 0.98) as nz, bool_or(alpha > 0.5 and frame = 5 and l_suppkey < 1) as tri from {_PX} group by 1) x on x.frame = f",
    "i11_complete": f"select frame, have and mark and marked as complete from {_FILES}",
    "i12_recovered": f"select frame, case when not (have and (not mark or own and marked)) then 'render' when mark then 'done' else 'recover' end as action from {_FILES}",
    "i15_legacy_complete": f"select frame, have and mark and own and marked as complete from {_FILES}",
}
