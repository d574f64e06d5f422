"""Candidate queries: supplier as candidates, lineitem as what they see, part as cells and rays, nation as regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import candidates as K
from sightline.operators import spatial as S
from sightline.plans.coverage_queries import supplier_edges, t
from sightline.plans.space_queries import POINTS, points


def obs(s, d):
    return t(s, d, "lineitem").select(F.col("l_suppkey").alias("candidate"), F.col("l_partkey").alias("cell"), F.col("l_returnflag").alias("category"), F.col("l_linenumber").alias("bin"))


def regions(s, d):
    n = F.col("n_nationkey")
    return t(s, d, "nation").select(n.alias("region"), (n % 5 * 2 + 1.0).alias("x"), (F.floor(n / 5) + 1.0).alias("y"), F.lit(1.0).alias("z"))


def chosen(s, d):
    k = F.col("s_suppkey")
    return t(s, d, "supplier").where("s_suppkey % 2 = 0").select(k.alias("candidate"), F.when(k % 3 == 0, "NEAR").otherwise("MID").alias("band"), F.when(k % 10 == 0, "CURVE").otherwise("FREE").alias("provider"))


def patch(s, d, profile):
    """Line items of one supplier in four as hits, those of the others as coverage."""
    o = obs(s, d)
    hits = o.where("candidate % 4 = 0").groupBy("candidate", "cell").agg(F.min("bin").alias("bin"))
    cover = o.where("candidate % 4 = 1").groupBy("cell").agg(F.count(F.lit(1)).alias("observations"), F.collect_set("bin").alias("bins"))
    k = F.col("s_suppkey")
    context = t(s, d, "supplier").select(k.alias("candidate"), (k % 11 / 20.0).alias("overlap"), (k % 7 / 5.0).alias("baseline"), F.lit(2.0).alias("target_distance"), (k % 5).alias("connected"))
    return K.patch_scores(hits, cover, context, required_overlap=0.1, profile=profile).select("candidate", F.round("score", 9).alias("score"), F.round("under", 9).alias("under"), "fresh", "diverse", "hits", F.lit(profile).alias("profile"))


def rays(s, d):
    return t(s, d, "part").select(F.floor(F.col("p_partkey") / 36).alias("sample"), (F.col("p_partkey") % 36).alias("ray"), (F.col("p_size") / 15.0).alias("distance"))


def chain_nodes(s, d):
    k = F.col("s_suppkey")
    return t(s, d, "supplier").select(F.col("s_nationkey").alias("zone"), k.alias("id"), (k * 7 % 50).alias("along"), F.lit(1.0).alias("step"), (k % 10 / 1.0).alias("x"), (F.floor(k / 10) / 1.0).alias("y"), F.lit(0.0).alias("z"), F.cos(k / 20.0).alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(k / 20.0).alias("qz"))


def neighbours(s, d):
    """Supplier pairs with overlaps as edges; five suppliers an origin."""
    e = supplier_edges(s, d)
    both = e.select("a", "b", "ratio").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "ratio"))
    k = F.col("s_suppkey")
    groups = t(s, d, "supplier").select(F.floor(k / 5).alias("origin"), k.alias("candidate"), (k % 13).alias("observations"), (k % 5 == 0).alias("is_base"), (k % 5 / 10.0).alias("pitch"))
    first = groups.groupBy("origin").agg(F.min("candidate").alias("candidate"))
    return K.repaired_neighbours(first, groups, both, strong=0.1, wanted=3)


def grown(s, d):
    o = obs(s, d).withColumn("category", F.when(F.col("category") == "N", "N").otherwise("AR"))
    start = t(s, d, "supplier").where("s_suppkey % 10 = 1").select(F.col("s_suppkey").alias("candidate"))
    return K.repaired_categories(o, start, targets={"AR": 0.9}, keep_ratio=0.0, swaps=3)


def surfaces(s, d):
    return points(s, d).select((F.col("id") % 7).alias("object"), "id", "x", "y", "z")


QUERIES = {
    "d26_diverse": lambda s, d: S.greedy_independent(t(s, d, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), S.V.vec(F.col("l_quantity") / 50.0, F.col("l_discount"), 0.3).alias("pos"), S.V.vec(0.0, 0.0, 0.0).alias("at")), target="l_partkey", order="o", pos="pos", at="at", baseline=0.12, degrees=12.0, most=5),
    "d32_path_origins": lambda s, d: K.path_origins(regions(s, d), points(s, d), radius=0.8).select("region", "rank", "x", "y", "z"),
    "e26_detail_counts": lambda s, d: K.detail_counts(t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 4).alias("base"), (F.col("s_suppkey") % 3).alias("least"), F.col("s_acctbal").cast("double").alias("length"), F.lit(0.5).alias("gain"), (F.col("s_suppkey") % 10 / 1.0).alias("x"), (F.col("s_suppkey") / 10.0).alias("y"), F.lit(0.0).alias("z")), base="base", minimum="least", length="length", gain="gain", key="id"),
    "f31_greedy_chain": lambda s, d: K.affinity_chain(chain_nodes(s, d), supplier_edges(s, d).select("a", "b", "ratio"), group="zone"),
    "f32_ordered_segments": lambda s, d: K.ordered_segments(chain_nodes(s, d).withColumn("layer", F.col("id") % 2), supplier_edges(s, d).select("a", "b", "ratio"), keys=["zone", "layer"]),
    "h6_near_field_first": lambda s, d: K.near_field_first(t(s, d, "part").select(F.col("p_partkey").alias("group"), (F.col("p_size") % 3).alias("priority")), 150),
    "h7_near_field_rejects": lambda s, d: K.near_field_rejects(chosen(s, d), obs(s, d), reject_score=0.02, near_most=3),
    "h9_repaired_categories": grown,
    "h10_repaired_neighbours": neighbours,
    "h11_patch_scores": lambda s, d: patch(s, d, "MINIMAL").unionByName(patch(s, d, "CONNECTIVITY")),
    "h14_patch_groups": lambda s, d: K.patch_groups(points(s, d).select(F.col("id").alias("origin"), (F.col("id") % 25).cast("int").alias("region"), "x", "y", "z"), points(s, d).where("id % 10 = 0").select("x", "y", "z"), regions(s, d)).select("origin", "view", F.round("yaw", 6).alias("yaw"), F.round("pitch", 6).alias("pitch")),
    "h17_audit_sample": lambda s, d: K.audit_sample(surfaces(s, d), object_="object", order="id").select("object", "id"),
    "h18_spaced_top": lambda s, d: K.spaced_top(surfaces(s, d), group="object", order=[F.desc("z"), "id"], axes=["x", "y"], apart=1.1, most=12).select("object", "id"),
    "h19_openings": lambda s, d: K.openings(rays(s, d)).select("sample", "ray", F.round("jump", 9).alias("jump"), F.round("score", 9).alias("score")),
    "h27_free_space_origins": lambda s, d: K.origins_of("FREE_SPACE", cells=surfaces(s, d).select("id", F.col("object").alias("region"), "x", "y", "z", (F.col("z") / 5).alias("clearance")), total=60).groupBy("provider").agg(F.count(F.lit(1)).alias("n")),
    "h28_doorway_origins": lambda s, d: K.doorway_origins(regions(s, d).select(F.col("region").alias("id"), "x", "y", F.lit(0.8).alias("dx"), F.lit(0.6).alias("dy")), points(s, d), tiers=((0.0, 0.0), (0.1, 0.0), (-0.1, 0.0), (0.3, 0.0), (-0.3, 0.0), (0.0, 0.2), (0.0, -0.2)), reach=0.6),
    "h29_driven_origins": lambda s, d: K.driven_origins(points(s, d).where("z < 0.6").select("id", "x", "y", "z", (F.col("id") % 5).alias("deficit")), points(s, d).where("z >= 0.6"), points(s, d).where("id % 9 = 0"), reach=1.2).select("target", "cell"),
    "h30_hybrid_origins": lambda s, d: K.hybrid_origins(points(s, d).where("id % 3 = 0").select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("origin"), "x", "y", "z"), points(s, d).where("id % 2 = 0").select(F.concat(F.lit("b"), F.col("id").cast("string")).alias("origin"), (F.col("x") + 0.01).alias("x"), "y", "z")).select("origin"),
    "h31_curve_origins": lambda s, d: K.origins_of("CURVE", stations=points(s, d).select("id", "x", "y", "z", F.lit(0.6).alias("fx"), F.lit(0.8).alias("fy")), slots=((0.0, 0.0), (0.5, 0.0), (-0.5, 0.0), (0.0, 0.4), (0.5, 0.4), (-0.5, 0.4))).select("origin", *[F.round(c, 9).alias(c) for c in "xyz"]),
}

_REG = "(select n_nationkey as region, n_nationkey % 5 * 2 + 1.0::double as x, n_nationkey // 5 + 1.0::double as y, 1.0::double as z from nation)"
_SURF = f"(select id % 7 as object, id, x, y, z from {POINTS})"
_OBS = "(select distinct l_suppkey as candidate, l_partkey as cell from lineitem)"


def _patch_sql(profile):
    w = K.PATCH_WEIGHTS[profile]
    return f"""select candidate, round({w[0]}::double * under / hits + {w[1]}::double * fresh / hits + {w[2]}::double * diverse / hits + {w[3]}::double * least(overlap / 0.45, 1) + {w[4]}::double * (case when r < 0.03 then 0 when r <= 0.35 then least(r / 0.2, 1) else least(greatest(1 - (r - 0.35) / 1.15, 0), 1) end) + {w[5]}::double * least(connected / 3.0::double, 1), 9) as score, round(under, 9) as under, fresh, diverse, hits, '{profile}' as profile
from (select h.candidate, sum(case when n is null then 1.0::double when n < 3 then (3 - n) / 3.0::double when n < 5 then 0.25::double * (5 - n) / 2 else 0 end) as under, count(*) filter (where n is null) as fresh, count(*) filter (where n is null or not list_contains(bins, bin)) as diverse, count(*) as hits
from (select l_suppkey as candidate, l_partkey as cell, min(l_linenumber) as bin from lineitem where l_suppkey % 4 = 0 group by 1, 2) h left join (select l_partkey as cell, count(*) as n, list(distinct l_linenumber) as bins from lineitem where l_suppkey % 4 = 1 group by 1) c using (cell) group by 1) join (select s_suppkey as candidate, s_suppkey % 11 / 20.0::double as overlap, s_suppkey % 7 / 10.0::double as r, s_suppkey % 5 as connected from supplier) using (candidate) where overlap >= 0.1"""


SQL = {
    "d32_path_origins": f"with p as (select r.region, round((p.x - r.x) ** 2 + (p.y - r.y) ** 2 + (p.z - r.z) ** 2, 9) as far, p.x, p.y, p.z from {_REG} r, {POINTS} p where (p.x - r.x) ** 2 + (p.y - r.y) ** 2 <= 4), k as (select *, row_number() over (partition by region order by far, x, y, z) - 1 as rank, count(*) over (partition by region) as n from p) select region, rank, x, y, z from k where n <= 48 or rank in (select round_even(i * (n - 1) / 47.0::double, 0)::bigint from range(48) v(i))",
    "h6_near_field_first": "with g as (select p_partkey as g, p_size % 3 as priority, p_size % 3 = 2 as near from part), k as (select *, row_number() over (partition by near order by g) - 1 as k, count(*) over (partition by near) as n from g), q as (select *, case when near then least(150 - least(150, (select count(*) from g where not near)), n) else least(150, (select count(*) from g where not near)) end as q from k) select g as \"group\", priority from q where q > 0 and (q >= n or k in (select case when q = 1 then 0 else round_even((i * (n - 1))::double / greatest(q - 1, 1), 0)::bigint end from range(q) v(i)))",
    "h7_near_field_rejects": f"with c as (select s_suppkey as candidate, case when s_suppkey % 3 = 0 then 'NEAR' else 'MID' end as band, s_suppkey % 10 = 0 as curve from supplier where s_suppkey % 2 = 0), o as (select * from {_OBS} where candidate in (select candidate from c)), n as (select cell, count(*) as n from o group by 1), x as (select candidate, count(*) filter (where n = 1) / count(*)::double as score from o join n using (cell) group by 1), s as (select c.*, coalesce(score, 0) as score from c left join x using (candidate) where not curve) select candidate, 'score' as reason from s where score <= 0.02 union all select candidate, 'near_camera_quota' from (select candidate, row_number() over (order by score desc, candidate desc) as k from s where score > 0.02 and band = 'NEAR') where k > 3",
    "h11_patch_scores": _patch_sql("MINIMAL") + " union all " + _patch_sql("CONNECTIVITY"),
    "h14_patch_groups": f"with o as (select id as origin, id % 25 as region, x, y, z from {POINTS} q where not exists (select 1 from {POINTS} e where e.id % 10 = 0 and (q.x - e.x) ** 2 + (q.y - e.y) ** 2 + (q.z - e.z) ** 2 < 0.0025)), l as (select origin, atan2(r.y - o.y, r.x - o.x) as yaw, asin(least(greatest((r.z - o.z) / d, -1), 1)) as pitch, d from (select o.*, sqrt((r.x - o.x) ** 2 + (r.y - o.y) ** 2 + (r.z - o.z) ** 2) as d from o join {_REG} r using (region)) o join {_REG} r using (region)), v as (select origin, view, case when d > 1e-9 then yaw else 0 end + radians(a) as w, case when d > 1e-9 then pitch else 0 end + radians(b) as p from l, (values (0, 0, 0), (1, -12, 0), (2, 12, 0), (3, 0, -12), (4, 0, 12)) t(view, a, b)) select origin, view, round(w - floor(w / (2 * pi())) * 2 * pi(), 6) as yaw, round(least(greatest(p, -radians(75)), radians(75)), 6) as pitch from v",
    "h17_audit_sample": f"with f as (select *, row_number() over (partition by object order by id) - 1 as k, greatest(1, count(*) over (partition by object) // 18) as stride from {_SURF}), c as (select *, row_number() over (partition by round_even(x / 0.16::double, 0), round_even(y / 0.16::double, 0), round_even(z / 0.16::double, 0) order by object, id) as i from f where k % stride = 0 and k // stride < 20) select object, id from c where i = 1",
    "h19_openings": "with r as (select p_partkey // 36 as sample, p_partkey % 36 as ray, p_size / 15.0::double as distance from part), b as (select sample, (ray + s + 36) % 36 as ray, min(distance) as near, max(distance) as far from r, (values (-2), (2)) v(s) group by 1, 2) select sample, ray, round(distance - near, 9) as jump, round(distance - near + near * 0.1 + case when far < distance - 0.35 then 1 else 0 end, 9) as score from r join b using (sample, ray) where distance - near >= 0.5 and distance >= 0.75",
    "h29_driven_origins": f"with w as (select id, x, y, z, id % 5 as deficit from {POINTS} where z < 0.6), f as (select * from {POINTS} c where z >= 0.6 and not exists (select 1 from {POINTS} t where t.id % 9 = 0 and (c.x - t.x) ** 2 + (c.y - t.y) ** 2 + (c.z - t.z) ** 2 <= 0.0025)), n as (select w.id as target, f.id as cell, deficit, row_number() over (partition by w.id order by (w.x - f.x) ** 2 + (w.y - f.y) ** 2 + (w.z - f.z) ** 2, f.id) as rank from w, f where (w.x - f.x) ** 2 + (w.y - f.y) ** 2 + (w.z - f.z) ** 2 <= 1.44), o as (select *, row_number() over (partition by cell order by deficit desc, rank, target) as k from n where rank <= 8) select target, cell from (select *, row_number() over (order by deficit desc, target, rank) as j from o where k = 1) where j <= 256",
    "h30_hybrid_origins": f"select 'a' || id as origin from {POINTS} where id % 3 = 0 union all select 'b' || id from {POINTS} q where id % 2 = 0 and not exists (select 1 from {POINTS} p where p.id % 3 = 0 and (p.x - q.x - 0.01) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2 < 0.0025)",
    "h31_curve_origins": f"select id || '_' || k as origin, round(x - 0.8::double * side, 9) as x, round(y + 0.6::double * side, 9) as y, round(z + up, 9) as z from {POINTS}, (values (0, 0.0::double, 0.0::double), (1, 0.5, 0), (2, -0.5, 0), (3, 0, 0.4), (4, 0.5, 0.4), (5, -0.5, 0.4)) v(k, side, up)",
}
