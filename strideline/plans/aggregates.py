"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideline.functions import posterior as P
from strideline.operators import aggregate as G
from strideline.operators import kinematics as K
from strideline.operators import learn as L
from strideline.operators import timeseries as ts
from strideline.plans import views as v
from strideline.plans.evaluate import rounded, whole_ratio
from strideline.plans.fusion import scored
from strideline.plans.registry import query

R6 = lambda c: F.round(c, 6)
CORNERS = ["x0", "y0", "x1", "y1"]
TIES = ["tie1", "tie2", "tie3"]


def _stats_ctes(long: str) -> str:
    """The 13 statistics in SQL over a table `long`(clip, device, channel, t, sample_id, v)."""
    return f"""o as (select *, row_number() over w - 1 as i, lag(v) over w as pv, first_value(v) over w as fv, last_value(v) over (partition by clip, device, channel order by t, sample_id rows between unbounded preceding and unbounded following) as lv,
       avg(v) over (partition by clip, device, channel) as mu, count(*) over (partition by clip, device, channel) as n from {long} window w as (partition by clip, device, channel order by t, sample_id)),
     st as (select clip, device, channel, count(*) as n, avg(v) as mean, stddev_pop(v) as sd, min(v) as mn, max(v) as mx, quantile_cont(v, 0.25) as p25, quantile_cont(v, 0.75) as p75, any_value(lv - fv) as last_first,
       coalesce(avg(abs(v - pv)), 0) as mean_abs_step, coalesce(stddev_pop(v - pv), 0) as sd_step, coalesce(max(abs(v - pv)), 0) as max_abs_step,
       case when count(*) > 2 then avg(case when pv is not null then (sign(v - mu) <> sign(pv - mu))::int end) else 0 end as zero_cross from o group by 1, 2, 3),
     fr as (select clip, device, channel, n, unnest(range(0, n // 2 + 1)) as k from st),
     am as (select clip, device, channel, fr.n, k, sqrt(pow(sum((v - mu) * cos(2 * pi() * ((k * i) % fr.n) / fr.n)), 2) + pow(sum((v - mu) * sin(2 * pi() * ((k * i) % fr.n) / fr.n)), 2)) as amp from fr join o using (clip, device, channel) group by clip, device, channel, fr.n, k),
     ra as (select *, row_number() over (partition by clip, device, channel order by (k = 0), round(amp, 6) desc, k) as rk from am),
     sp as (select clip, device, channel, case when n > 3 then sum(case when k < greatest(1, (n // 2 + 1) // 4) then amp else 0 end) / (sum(amp) + 1e-9) else 0e0 end as low_share,
       case when n > 3 then max(case when rk = 1 then k end) else 0 end as peak_bin from ra group by clip, device, channel, n),
     cs as (select * from st join sp using (clip, device, channel))"""


_LONG = "lg as (select clip, device, 'x' as channel, t, sample_id, x as v from sensor union all select clip, device, 'z', t, sample_id, z from sensor)"


@query(
    "a2_channel_statistics",
    f"""with {_LONG}, {_stats_ctes('lg')} select clip, device, channel, n, round(mean, 6) as mean, round(sd, 6) as sd, round(mn, 6) as min, round(mx, 6) as max, round(p25, 6) as p25, round(p75, 6) as p75,
        round(last_first, 6) as last_first, round(mean_abs_step, 6) as mean_abs_step, round(sd_step, 6) as sd_step, round(max_abs_step, 6) as max_abs_step, round(zero_cross, 6) as zero_cross, round(low_share, 4) as low_share, peak_bin from cs""",
    "sensor",
)
def a2(spark, sf):
    s = v.sensor(spark, sf)
    pairs = F.array(F.struct(F.lit("x").alias("channel"), F.col("x").alias("v")), F.struct(F.lit("z").alias("channel"), F.col("z").alias("v")))
    long = s.select("clip", "device", "t", "sample_id", F.floor(F.col("t") / v.DAY).alias("seg"), F.explode(pairs).alias("c")).select("*", "c.*").drop("c")
    d = ts.channel_statistics(long, ["clip", "device", "channel"], "t", "sample_id", "v", "seg")
    return rounded(d, "low_share").withColumn("low_share", F.round("low_share", 4))


_STAT_SQL = {"mean": "mean", "sd": "sd", "min": "mn", "max": "mx", **{s: s for s in ts.STATISTICS[4:]}}
_PAIRS = [(a, b) for i, a in enumerate(v.DEVICES) for b in v.DEVICES[i + 1:]]


def _feature_sql() -> str:
    digits = lambda s: 4 if s == "low_share" else 9
    cells = [f"round(coalesce(max(case when device = '{d}' and channel = '{c}' then {_STAT_SQL[s]} end), 0)::double, {digits(s)}) as {d}_{c}_{s}" for d in v.DEVICES for c in "xz" for s in ts.STATISTICS]
    counts = [f"coalesce(max(case when device = '{d}' then n end), 0)::double as {d}_count" for d in v.DEVICES]
    pairs = [
        f"round(case when stddev_pop({a}) <= 1e-9 or stddev_pop({b}) <= 1e-9 then 0 else corr({a}, {b}) end, 9) as corr_{a}_{b}, round(avg(abs({a} - {b})), 9) as mad_{a}_{b}" for a, b in _PAIRS
    ]
    grid = ", ".join(f"max(case when device = '{d}' then val else 0 end) as {d}" for d in v.DEVICES)
    return f"""with {_LONG}, {_stats_ctes('lg')}, gx as (select clip, device, n, s as step, s * (n - 1) / 31e0 as ps from (select clip, device, n from cs where channel = 'x'), (select unnest(range(0, 32)) as s)),
      gv as (select gx.clip, gx.device, step, case when gx.n > 1 then lo.v * (1 - (ps - floor(ps))) + coalesce(hi.v, 0) * (ps - floor(ps)) else 0 end as val from gx join o lo on lo.clip = gx.clip and lo.device = gx.device and lo.channel = 'x' and lo.i = floor(ps)
             left join o hi on hi.clip = gx.clip and hi.device = gx.device and hi.channel = 'x' and hi.i = floor(ps) + 1),
      gw as (select clip, step, {grid} from gv group by 1, 2), cp as (select clip, {", ".join(pairs)} from gw group by 1),
      ft as (select clip, {", ".join(cells + counts)} from cs group by 1) select * from ft join cp using (clip)"""


@query("a3_clip_feature_vector", _feature_sql(), "sensor")
def a3(spark, sf):
    s = v.sensor(spark, sf).withColumn("seg", F.floor(F.col("t") / v.DAY))
    d = ts.clip_feature_vector(s, "clip", "device", "t", "sample_id", {"x": F.col("x"), "z": F.col("z")}, v.DEVICES, "x", "seg")
    return d.select("clip", *[F.round(c, 4 if c.endswith("low_share") else 9).alias(c) if t == "double" else c for c, t in d.dtypes if c != "clip"])


@query(
    "a4_device_coupling",
    f"""with o as (select clip, device, x as v, row_number() over (partition by clip, device order by t, sample_id) - 1 as i, count(*) over (partition by clip, device) as n from sensor),
      gx as (select clip, device, n, s as step, s * (n - 1) / 31e0 as ps from (select distinct clip, device, n from o), (select unnest(range(0, 32)) as s)),
      gv as (select gx.clip, gx.device, step, case when gx.n > 1 then lo.v * (1 - (ps - floor(ps))) + coalesce(hi.v, 0) * (ps - floor(ps)) else 0 end as val from gx join o lo on lo.clip = gx.clip and lo.device = gx.device and lo.i = floor(ps)
             left join o hi on hi.clip = gx.clip and hi.device = gx.device and hi.i = floor(ps) + 1),
      gw as (select clip, step, {", ".join(f"max(case when device = '{d}' then val else 0 end) as {d}" for d in v.DEVICES)} from gv group by 1, 2)
      select clip, {", ".join(f"round(case when stddev_pop({a}) <= 1e-9 or stddev_pop({b}) <= 1e-9 then 0 else corr({a}, {b}) end, 9) as corr_{a}_{b}, round(avg(abs({a} - {b})), 9) as mad_{a}_{b}" for a, b in _PAIRS)} from gw group by 1""",
    "sensor",
)
def a4(spark, sf):
    s = v.sensor(spark, sf).withColumn("seg", F.floor(F.col("t") / v.DAY))
    g = ts.index_grid(s, ["clip", "device"], ["t", "sample_id"], "seg", "x", 32)
    d = ts.device_coupling(g, "clip", "device", "x", v.DEVICES, 32)
    return d.select("clip", *[F.round(c, 9).alias(c) for c in d.columns if c != "clip"])


@query(
    "a5_bone_template",
    """with l as (select clip, subject, joint, sqrt(dx*dx + dy*dy + dz*dz) as len from bones where joint > 0), m as (select clip, subject, joint, quantile_cont(len, 0.5) as len from l where len > 1e-5 group by 1, 2, 3),
            t as (select subject, joint, quantile_cont(len, 0.5) as len from m group by 1, 2)
       select subject, count(*) = 16 and min(len) > 1e-5 as complete, round(max(case when joint = 1 then len end), 6) as bone_1, round(max(case when joint = 16 then len end), 6) as bone_16, round(1 + sum(len), 6) as total from t group by 1""",
    "bones",
)
def a5(spark, sf):
    t = K.group_template(K.clip_bone_medians(v.frames(spark, sf), "clip", "pose", ["subject"]), "subject")
    return t.select("subject", "complete", R6(F.col("template")[1]).alias("bone_1"), R6(F.col("template")[16]).alias("bone_16"), R6(P.total("template")).alias("total"))


@query(
    "a6_dominant_person",
    """with p as (select *, lag(coords) over w as pc, lag(frame) over w as pf, count(*) over (partition by clip, person) as n from persons window w as (partition by clip, person order by frame)),
            e as (select clip, person, any_value(n) as n, coalesce(sum(case when frame - pf = 1 then list_sum([abs(coords[i] - pc[i]) for i in range(1, 31)]) end), 0) as e from p group by 1, 2),
            b as (select clip, arg_max(person, (e, -person)) as chosen, max(e) as energy from e where n >= 2 group by 1)
       select p.clip, p.frame, coalesce(chosen, 0)::int as chosen, round(energy, 6) as energy, round(coalesce(max(case when person = coalesce(chosen, 0) then coords[1] end), max(case when person = 0 then coords[1] end)), 6) as first_coord
       from persons p left join b using (clip) group by p.clip, p.frame, chosen, energy""",
    "persons",
)
def a6(spark, sf):
    d = K.dominant_person(v.persons(spark, sf), "clip", "frame", "person", "coords")
    return d.select("clip", F.col("frame").cast("long").alias("frame"), "chosen", R6("energy").alias("energy"), R6(F.col("pose")[0]).alias("first_coord"))


@query(
    "a7_crosstab",
    """select day, count(*) filter (where label = 'click') as click, count(*) filter (where label = 'error') as error, count(*) filter (where label = 'purchase') as purchase, count(*) filter (where label = 'signup') as signup,
       count(*) filter (where label = 'view') as view, least(count(*) filter (where label = 'click'), count(*) filter (where label = 'error'), count(*) filter (where label = 'purchase'), count(*) filter (where label = 'signup'), count(*) filter (where label = 'view')) as min_cell from clips group by 1""",
    "clips",
)
def a7(spark, sf):
    return G.label_crosstab(v.clips(spark, sf), "day", "label", v.DEVICES)


@query("a8_coverage", "select subject, count(*) as n, count(distinct label) as n_distinct from seq group by 1", "seq")
def a8(spark, sf):
    return G.coverage(v.seq(spark, sf), "subject", "label")


@query(
    "a9_dominant_value",
    """with c as (select subject, year, count(*) as c from seq group by 1, 2) select subject, arg_max(year, (c, -year)) as dominant, max(c) as n from c group by 1""",
    "seq",
)
def a9(spark, sf):
    return G.dominant_value(v.seq(spark, sf), "subject", "year")


@query("a10_centroids", "select label, d::int as dim, round(avg(v), 6) as mean from vecdim group by 1, 2", "vecdim")
def a10(spark, sf):
    c = L.centroids(v.vectors(spark, sf), "label", "vec", v.EMB_DIM)
    return c.select("label", F.posexplode("centroid").alias("dim", "mean")).select("label", (F.col("dim") + 1).alias("dim"), R6("mean").alias("mean"))


@query(
    "a11_vector_soup",
    """with s as (select sample_id // 4 as key, fold, label, d, v from vecdim), m as (select key, d, avg(v) as m from s group by 1, 2), o as (select key, arg_min(label, fold) as label, min(label) <> max(label) as differs, count(distinct fold) as n_sources from s group by 1)
       select key, label, differs, n_sources, round(max(case when d = 1 then m end), 6) as first, round(sum(m), 6) as total from m join o using (key) group by 1, 2, 3, 4""",
    "vecdim",
)
def a11(spark, sf):
    d = v.vectors(spark, sf).withColumn("key", F.floor(F.col("sample_id") / 4))
    s = G.vector_soup(d, "key", "fold", "vec", v.EMB_DIM, "label")
    return s.select("key", "label", "differs", "n_sources", R6(F.col("soup")[0]).alias("first"), R6(P.total("soup")).alias("total"))


_BEST = """best as (select *, count(*) over (partition by clip, frame) as n_boxes from boxes qualify row_number() over (partition by clip, frame order by conf desc, tie1, tie2, tie3) = 1)"""


@query(
    "a12_union_window",
    f"""with {_BEST}, u as (select clip, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from best group by 1),
        s as (select *, least(greatest(greatest(x1 - x0, y1 - y0) * 1.4e0, 224e0), 480e0) / 2 as half from u), c as (select clip, half, greatest(least((x0 + x1) / 2, 640 - half), half) as cx, greatest(least((y0 + y1) / 2, 480 - half), half) as cy from s)
        select clip, round_even(cx - half, 0)::int as wx0, round_even(cy - half, 0)::int as wy0, round_even(cx + half, 0)::int as wx1, round_even(cy + half, 0)::int as wy1 from c""",
    "boxes",
)
def a12(spark, sf):
    b = G.best_box_per_frame(v.boxes(spark, sf), "clip", "frame", "conf", TIES, CORNERS)
    return G.union_window(b, "clip", CORNERS, 640, 480, 1.4, 0.35)


@query(
    "a13_box_drift",
    f"""with {_BEST}, l as (select *, lag(x0) over w as px0, lag(y0) over w as py0, lag(x1) over w as px1, lag(y1) over w as py1, (x1 - x0) * (y1 - y0) as area from best window w as (partition by clip order by frame)),
        i as (select *, greatest(least(x1, px1) - greatest(x0, px0), 0) * greatest(least(y1, py1) - greatest(y0, py0), 0) as it from l), o as (select *, case when px0 is not null then it / (area + (px1 - px0) * (py1 - py0) - it) end as iou from i)
        select clip, round(coalesce(min(iou), 1), 6) as min_iou, round(coalesce(avg(iou), 1), 6) as mean_iou, round(avg((n_boxes > 1)::int), 6) as multi_share,
               round((max(x1) - min(x0)) * (max(y1) - min(y0)) / greatest(quantile_cont(area, 0.5), 1e-9), 6) as inflation from o group by 1""",
    "boxes",
)
def a13(spark, sf):
    b = G.best_box_per_frame(v.boxes(spark, sf), "clip", "frame", "conf", TIES, CORNERS)
    return rounded(G.box_drift(b, "clip", "frame", CORNERS))


@query(
    "a14_series_summary",
    """with o as (select clip, device, x / 50 as v, row_number() over w - 1 as i, lag(x / 50) over w as pv, count(*) over (partition by clip, device) as n from sensor window w as (partition by clip, device order by t, sample_id))
       select clip, device, round(avg(v), 6) as mean, round(least(greatest(stddev_pop(v) * 4, 0), 1), 6) as spread,
         case when sum(abs(2 * i - (n - 1))) > 0 then (2000000::hugeint * least(greatest(sum(abs(2 * i - (n - 1))) * 5000 + sum((2 * i - (n - 1)) * round(v * 5000)::bigint), 0), 2 * 5000 * sum(abs(2 * i - (n - 1)))) + 2 * 5000 * sum(abs(2 * i - (n - 1))))
           // (4 * 5000 * sum(abs(2 * i - (n - 1)))) else 500000 end::bigint as rank_pool_millionths,
         round(least(coalesce(avg(case when pv is not null then greatest(v - pv, 0) end), 0) * 4, 1), 6) as rise, round(least(coalesce(avg(case when pv is not null then greatest(pv - v, 0) end), 0) * 4, 1), 6) as fall from o group by 1, 2""",
    "sensor",
)
def a14(spark, sf):
    s = v.sensor(spark, sf).withColumns({"v": F.col("x") / 50, "seg": F.floor(F.col("t") / v.DAY)})
    d = ts.series_summary(s, ["clip", "device"], ["t", "sample_id"], "seg", "v", ticks=5000)
    # whole numbers decide the last digit: a quotient on the half is no matter of its binary form
    top = F.least(F.greatest(F.col("pool_base") + F.col("pool_top"), F.lit(0)), 2 * F.col("pool_base"))
    share = F.when(F.col("pool_base") > 0, whole_ratio(top, 2 * F.col("pool_base"))).otherwise(F.lit(500000))
    return rounded(d.withColumn("rank_pool_millionths", share.cast("long")).drop("pool_top", "pool_base", "rank_pool"))


@query(
    "a15_class_confidence",
    """select l_orderkey as clip, coalesce(max(case when l_returnflag = 'A' then l_tax end), 0) as "A", coalesce(max(case when l_returnflag = 'N' then l_tax end), 0) as "N", coalesce(max(case when l_returnflag = 'R' then l_tax end), 0) as "R" from lineitem group by 1""",
)
def a15(spark, sf):
    return G.class_confidence(v.table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_tax"), "l_orderkey", "l_returnflag", "l_tax", ["A", "N", "R"]).withColumnRenamed("l_orderkey", "clip")


@query(
    "a16_grouping_report",
    """with s as (select subject % 4 as fold, label, subject, t0 // 86400 // 365 as year, (pred = label)::int as ok from fpred)
       select case grouping(fold, label, subject, year) when 15 then 'all' when 7 then 'fold' when 11 then 'label' when 13 then 'subject' else 'fold+year' end as level,
              concat_ws('|', fold, label, subject, year) as key, count(*) as n, round(avg(ok), 6) as acc from s group by grouping sets ((), (fold), (label), (subject), (fold, year))""",
    "fpred",
)
def a16(spark, sf):
    d = scored(spark, sf).withColumns({"fold": F.col("subject") % 4, "year": F.floor(F.floor(F.col("t0") / 86400) / 365)})
    return rounded(G.grouping_report(d, [[], ["fold"], ["label"], ["subject"], ["fold", "year"]]))


@query(
    "a17_collisions",
    """with x as (select subject, 'pred' as which, pred from fpred union all select subject, 'pred0', pred from mpred where member = 0), g as (select subject, which, count(*) as n, count(distinct pred) as d from x group by 1, 2 having count(*) >= 2)
       select which, sum(n - d)::bigint as collisions from g group by 1""",
    "fpred mpred",
)
def a17(spark, sf):
    return G.collisions(scored(spark, sf), "subject", ["pred", "pred0"])


@query(
    "a18_content_digest",
    """with n as (select o_orderstatus as part, o_custkey as name, count(*) as n from orders group by 1, 2), l as (select part, sha256(name || ':' || n) as h from n),
            a as (select part, substr(h, 1, 6) as p, sha256(string_agg(h, chr(10) order by h)) as h from l group by 1, 2), b as (select part, substr(p, 1, 3) as p, sha256(string_agg(h, chr(10) order by h)) as h from a group by 1, 2)
       select part, sha256(string_agg(h, chr(10) order by h)) as digest from b group by 1""",
)
def a18(spark, sf):
    o = v.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("part"), F.col("o_custkey").alias("name"))
    return G.content_digest(o, ["part"], "name")


@query(
    "a18_clip_fingerprint",
    "select conv_id, sha1(coalesce(string_agg(role || '_' || turn, chr(10) order by role || '_' || turn) filter (where role <> 'system'), '')) as digest from conversations group by 1",
)
def a18b(spark, sf):
    c = v.table(spark, sf, "conversations")
    name = F.when(F.col("role") != "system", F.concat_ws("_", "role", F.col("turn").cast("string")))
    return G.list_digest(c.select("conv_id", name.alias("name")), ["conv_id"], "name")
