"""Posterior fusion and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideline.functions import posterior as P
from strideline.operators import assignment as AS
from strideline.operators import fusion as FU
from strideline.operators import transport as T
from strideline.plans import views as v
from strideline.plans.registry import query

C = v.N_CLASSES
R6 = lambda c: F.round(c, 6)
WEIGHTS = {0: 0.4, 1: 0.3, 2: 0.2, 3: 0.1}
PRIOR_WEIGHT = 0.25


def prior(spark, sf):
    return FU.class_prior(v.seq(spark, sf), "label", C)


def fused(spark, sf):
    """Fused posterior per sample with the standing weights; member 3 was trained under the prior."""
    return FU.fuse_log_linear(
        v.posteriors(spark, sf), ["sample_id"], WEIGHTS, C, prior(spark, sf), PRIOR_WEIGHT, [3], keep=["subject", "label", "t0"]
    )


def fused_wide(spark, sf):
    """The same for members that already sit side by side: no shuffle at all."""
    d = FU.attach_row(v.posteriors_wide(spark, sf), prior(spark, sf), "prior")
    q = P.items("prior", C)
    share = lambda m, i: F.col(f"p{m}")[i] / q[i] if m == 3 else F.col(f"p{m}")[i]
    log = lambda x: F.log(F.greatest(x, F.lit(P.LOG_FLOOR)))
    z = [P.sum_columns([F.lit(WEIGHTS[m]) * log(share(m, i)) for m in range(v.MEMBERS)]) + F.lit(PRIOR_WEIGHT) * log(q[i]) for i in range(C)]
    return d.withColumn("z", F.array(*z)).withColumn("probs", P.softmax("z", C))


def scored(spark, sf):
    """One row per sample: fused prediction and every member's prediction."""
    d = fused_wide(spark, sf)
    return d.select(
        "sample_id", "subject", "label", "t0", "day", P.argmax("z", 9, C).alias("pred"), P.confidence("probs", C).alias("conf"),
        *[P.argmax(f"p{m}", 9, C).alias(f"pred{m}") for m in range(v.MEMBERS)],
    )


@query("a1_class_prior", "select cls, round(q, 6) as share from prior union all select 5, 0e0", "prior")
def a1(spark, sf):
    d = FU.class_prior(v.seq(spark, sf), "label", C + 1)
    return d.select(F.posexplode("prior").alias("cls", "share")).select("cls", R6("share").alias("share"))


@query("f1_log_linear_fusion", "select sample_id, cls, round(p, 6) as p from fused", "fused")
def f1(spark, sf):
    return fused(spark, sf).select("sample_id", P.by_class("probs", C).alias("cls", "p")).select("sample_id", "cls", R6("p").alias("p"))


@query(
    "f2_geometric_mean",
    """select sample_id, cls, round(exp(z) / sum(exp(z)) over (partition by sample_id), 6) as p from
       (select sample_id, cls, sum(case member when 0 then 0.65 else 0.35 end * ln(greatest(p, 1e-12))) as z from post where member < 2 group by 1, 2)""",
    "post",
)
def f2(spark, sf):
    d = v.posteriors_wide(spark, sf).select("sample_id", F.posexplode(P.geometric_blend("p0", "p1", 0.35, C)).alias("cls", "p"))
    return d.select("sample_id", "cls", R6("p").alias("p"))


@query(
    "f3_power_mean",
    """with s as (select sample_id, cls, member, greatest(p / max(p) over (partition by sample_id, member), 1e-8) as r from post where member < 2),
            m as (select sample_id, cls, pw, pow(greatest(sum(case when member = 0 then 1 - w else w end * pow(r, pw)), 1e-12), 1 / pw) as v
                  from (select *, case when cls in (2, 3) then 0.6 else 0.35 end as w from s) cross join (values (1.0::double), (0.5::double)) t(pw) group by sample_id, cls, pw),
            g as (select sample_id, cls, 0e0 as pw, exp(sum(case when member = 0 then 1 - w else w end * ln(greatest(p, 1e-12)))) as v
                  from (select *, case when cls in (2, 3) then 0.6 else 0.35 end as w from post where member < 2) group by sample_id, cls),
            u as (select * from m union all select * from g)
       select sample_id, cls, pw as power, round(v / sum(v) over (partition by sample_id, pw), 6) as p from u""",
    "post",
)
def f3(spark, sf):
    w = [0.35, 0.35, 0.6, 0.6, 0.35]
    pools = F.array(*[F.struct(F.lit(float(p)).alias("power"), P.power_pool("p0", "p1", w, p).alias("v")) for p in (0.0, 0.5, 1.0)])
    d = v.posteriors_wide(spark, sf).select("sample_id", F.explode(pools).alias("s")).select("sample_id", "s.power", F.posexplode("s.v").alias("cls", "p"))
    return d.select("sample_id", "power", "cls", R6("p").alias("p"))


@query(
    "f4_nested_blend",
    """select sample_id, cls, round(sum(case when member < 2 then 0.7 / 2 else 0.3 / 2 end * p), 6) as p from post group by 1, 2""",
    "post",
)
def f4(spark, sf):
    d = FU.nested_blend(v.posteriors(spark, sf), ["sample_id"], {0: "a", 1: "a", 2: "b", 3: "b"}, {"a": 0.7, "b": 0.3}, C)
    return d.select("sample_id", P.by_class("probs", C).alias("cls", "p")).select("sample_id", "cls", R6("p").alias("p"))


@query(
    "f5_fold_bag",
    """select sample_id, cls, round(exp(z) / sum(exp(z)) over (partition by sample_id), 6) as p from
       (select sample_id, cls, avg(ln(greatest(p, 1e-12))) as z from post group by 1, 2)""",
    "post",
)
def f5(spark, sf):
    d = FU.bag(v.posteriors(spark, sf), ["sample_id"], C)
    return d.select("sample_id", P.by_class("probs", C).alias("cls", "p")).select("sample_id", "cls", R6("p").alias("p"))


@query(
    "f6_merge_weights",
    """with w as (select p_brand as tag, p_size % 4 as fold, sum(p_retailprice) / 1000 as weight from part group by 1, 2),
            mv as (select * from (values ('Brand#1', 'Brand#2'), ('Brand#3', 'Brand#4'), ('Brand#5', 'Brand#4')) t(tag, survivor)),
            ex as (select survivor as tag, fold, sum(weight) as extra from w join mv using (tag) group by 1, 2),
            k as (select w.tag, w.fold, weight + coalesce(extra, 0) as weight from w left join ex using (tag, fold) where w.tag not in (select tag from mv))
       select tag, fold, round(weight / sum(weight) over (), 6) as weight from k""",
)
def f6(spark, sf):
    w = v.table(spark, sf, "part").groupBy(F.col("p_brand").alias("tag"), (F.col("p_size") % 4).alias("fold")).agg((F.sum("p_retailprice") / 1000).alias("weight"))
    moves = spark.createDataFrame([("Brand#1", "Brand#2"), ("Brand#3", "Brand#4"), ("Brand#5", "Brand#4")], "tag string, survivor string")
    return FU.merge_weights(w, moves, moves.select("tag")).withColumn("weight", R6("weight"))


@query(
    "f7_sinkhorn",
    """with recursive base as (select sample_id, cls, ln(greatest(p, 1e-12)) as l from post where member = 0),
         tgt as (select count(*) / 5.0::double as t from seq),
         it(n, shift) as (
           select 0, [0e0, 0e0, 0e0, 0e0, 0e0]
           union all
           select n + 1, (select list(s order by cls) from (
                select cls, shift[cls + 1] + ln((select t from tgt)) - ln(sum(e / tot)) as s from (
                   select sample_id, cls, exp(l + shift[cls + 1]) as e, sum(exp(l + shift[cls + 1])) over (partition by sample_id) as tot from base) group by cls))
           from it where n < 4),
         f as (select shift from it where n = 4)
       select sample_id, cls, round(e / sum(e) over (partition by sample_id), 6) as p from (select sample_id, cls, exp(l + shift[cls + 1]) as e from base, f)""",
    "post",
)
def f7(spark, sf):
    d = v.posteriors_wide(spark, sf).select("sample_id", F.col("p0").alias("probs"))
    target = d.agg(F.array(*[F.count("*") / F.lit(float(C))] * C).alias("t"))
    out = FU.sinkhorn(d, "sample_id", target, C, iters=4)
    return out.select("sample_id", P.by_class("probs", C).alias("cls", "p")).select("sample_id", "cls", R6("p").alias("p"))


@query(
    "f8_largest_remainder",
    """with r as (select cls, q, q * 405 as raw from prior), k as (select *, row_number() over (order by round(raw - floor(raw), 9) desc, cls) as rk, 405 - sum(floor(raw)) over () as extra from r)
       select cls, cast(floor(raw) + case when rk <= extra then 1 else 0 end as bigint) as n_target from k""",
    "prior",
)
def f8(spark, sf):
    shares = prior(spark, sf).select(F.posexplode("prior").alias("cls", "q"))
    return FU.largest_remainder(shares, 405).select("cls", "n_target")


_TARGETS = """t as (select cls, q * (select count(*) from seq) as raw from prior),
    u as (select cls, floor(raw)::bigint as low, row_number() over (order by round(raw - floor(raw), 9) desc, cls) as o from t),
    caps as (select cls, low + (o <= (select count(*) from seq) - (select sum(low) from u))::int as n_target from u)"""


def _targets(spark, sf, n):
    shares = FU.class_prior(v.seq(spark, sf), "label", C).select(F.posexplode("prior").alias("cls", "q"))
    return FU.largest_remainder(shares, n).select("cls", "n_target")


@query(
    "f9_capacity_assignment",
    f"""with {_TARGETS}
    select cls, n_target as n_assigned, n_target from caps""",
    "prior seq",
)
def f9(spark, sf):
    d = v.posteriors_wide(spark, sf).select("sample_id", F.col("p0").alias("probs"))
    targets = _targets(spark, sf, d.count())
    got = T.capacity_assignment(d, "sample_id", "probs", targets, C).groupBy(F.col("assigned").alias("cls")).agg(F.count("*").alias("n_assigned"))
    return targets.join(got, "cls", "left").select("cls", F.coalesce("n_assigned", F.lit(0)).cast("long").alias("n_assigned"), F.col("n_target").cast("long").alias("n_target"))


@query("f9_transport_certificate", "select 'rows' as measure, count(*) as n from seq union all select unnest(['off_capacity', 'negative_cycles', 'cost_over_bound']), 0", "seq")
def f9_certificate(spark, sf):
    d = v.posteriors_wide(spark, sf).select("sample_id", F.col("p0").alias("probs"))
    targets = _targets(spark, sf, d.count())
    return T.transport_certificate(T.capacity_assignment(d, "sample_id", "probs", targets, C), targets, C)


# three classes: the best bound over all corners of the dual, at which two of the three price differences are differences of costs
@query(
    "f9_transport_cost",
    f"""with {_TARGETS},
    cap as (select case when cls = 0 then 0 when cls <= 2 then 1 else 2 end as k, sum(n_target) as n from caps group by 1),
    x as (select sample_id, sum(case when cls = 0 then p end) as a, sum(case when cls in (1, 2) then p end) as b, sum(case when cls > 2 then p end) as c from post where member = 0 group by sample_id),
    y as (select round(-ln(greatest(a, 1e-12)) * 1e9)::bigint as a, round(-ln(greatest(b, 1e-12)) * 1e9)::bigint as b, round(-ln(greatest(c, 1e-12)) * 1e9)::bigint as c from x),
    z as (select a, b, c, count(*) as w from y group by a, b, c),
    ab as (select distinct a - b as d from z), ac as (select distinct a - c as d from z), bc as (select distinct b - c as d from z),
    corners as (select ab.d as p, ac.d as q from ab, ac union select ab.d, ab.d + bc.d from ab, bc union select ac.d - bc.d, ac.d from ac, bc),
    g as (select p, q, sum(w * least(a, b + p, c + q)) - p * (select n from cap where k = 1) - q * (select n from cap where k = 2) as v from corners, z group by p, q)
    select (select count(*) from seq) as n_clips, round(max(v) / 1e9, 4) as total_cost from g""",
    "post prior seq",
)
def f9_cost(spark, sf):
    p = F.col("p0")
    d = v.posteriors_wide(spark, sf).select("sample_id", F.array(p[0], p[1] + p[2], p[3] + p[4]).alias("probs"))
    merged = F.when(F.col("cls") == 0, 0).when(F.col("cls") <= 2, 1).otherwise(2)
    targets = _targets(spark, sf, d.count()).groupBy(merged.alias("cls")).agg(F.sum("n_target").alias("n_target"))
    got = T.capacity_assignment(d, "sample_id", "probs", targets, 3)
    return got.agg(F.count("*").alias("n_clips"), F.round(F.sum(F.col("_cost")[F.col("assigned")]) / 1e9, 4).alias("total_cost"))


def _rec(spark, sf):
    w = v.posteriors_wide(spark, sf)
    return w.select((F.col("subject") * 100 + F.col("year")).alias("grp"), "sample_id", F.col("p0").alias("probs"))


@query(
    "f10_group_distinct_assignment",
    """select subject * 100 + day // 365 as grp, count(*) as n_clips, least(count(*), 5) as n_distinct, count(*) > 1 as solved from mpred where member = 0 group by 1""",
    "mpred",
)
def f10(spark, sf):
    a = AS.group_distinct_assignment(_rec(spark, sf), "grp", "sample_id", "probs", C, digits=9)
    return a.groupBy("grp").agg(F.count("*").alias("n_clips"), F.count_distinct("assigned").alias("n_distinct"), F.max("solved").alias("solved"))


@query(
    "f10_assignment_optimum",
    """with recursive k as (select subject * 100 + year as grp, sample_id, row_number() over (partition by subject, year order by sample_id) as i, count(*) over (partition by subject, year) as n from seq),
            e as (select k.grp, i, n, list(-ln(p + 1e-9) order by cls) as c from k join post using (sample_id) where member = 0 and n > 1 group by k.grp, i, n),
            a(grp, i, n, best) as (select grp, 0::bigint, n, list_transform(range(32), lambda m: case when m = 0 then 0::double else 'inf'::double end) from e where i = 1
              union all select a.grp, e.i, a.n, list_transform(range(32), lambda m: least(a.best[m + 1], list_min(list_transform(range(5), lambda c: case when (m >> c) & 1 = 1 then a.best[m - (1 << c) + 1] + e.c[c + 1] else 'inf'::double end))))
                from a join e on e.grp = a.grp and e.i = a.i + 1)
       select grp, round(list_min(list_transform(range(32), lambda m: case when bit_count(m::int) = least(n, 5) then best[m + 1] else 'inf'::double end)), 6) as cost from a where i = n""",
    "post",
)
def f10_optimum(spark, sf):
    a = AS.group_distinct_assignment(_rec(spark, sf), "grp", "sample_id", "probs", C, digits=9).filter("solved")
    cost = a.withColumn("c", -F.log(F.col("probs")[F.col("assigned")] + 1e-9)).groupBy("grp").agg(F.sum("c").alias("cost"))
    return cost.select("grp", R6("cost").alias("cost"))


@query(
    "f11_marginal_misallocation",
    """select sum(abs(coalesce(np, 0) - coalesce(nt, 0))) / 2.0::double as misallocated from (select pred as cls, count(*) as np from fpred group by 1) full join (select label as cls, count(*) as nt from seq group by 1) using (cls)""",
    "fpred",
)
def f11(spark, sf):
    s = scored(spark, sf)
    signed = s.select(F.explode(F.array(F.struct(F.col("pred").alias("cls"), F.lit(1).alias("d")), F.struct(F.col("label").alias("cls"), F.lit(-1).alias("d")))).alias("x"))
    return signed.groupBy("x.cls").agg(F.sum("x.d").alias("d")).agg((F.sum(F.abs("d")) / 2.0).alias("misallocated"))


@query(
    "f12_calibration_temperature",
    """with t as (select 0.05 * pow(500, i / 32e0) as temp from (select unnest(range(0, 33)) as i)),
            e as (select sample_id, temp, exp((l - mx) / temp) as e from (select sample_id, ln(greatest(p, 1e-12)) as l, max(ln(greatest(p, 1e-12))) over (partition by sample_id) as mx from post where member = 0), t),
            c as (select temp, sample_id, max(e) / sum(e) as conf from e group by 1, 2),
            a as (select avg((pred = label)::int) as acc from mpred where member = 0)
       select round(temp, 6) as temp, round(avg(conf), 6) as conf, round(any_value(acc), 6) as acc, round(abs(avg(conf) - any_value(acc)), 6) as gap from c, a group by temp""",
    "post mpred",
)
def f12(spark, sf):
    d = v.posteriors_wide(spark, sf).select("label", F.col("p0").alias("probs"))
    g = FU.temperature_grid(d, "label", [0.05 * 500 ** (i / 32) for i in range(33)], C)
    return g.select(*[R6(c).alias(c) for c in ("temp", "conf", "acc", "gap")])


_ROUNDS = ", ".join(
    f"""g{r} as (select lo, ratio, lo * pow(ratio, i) as temp from (select *, pow(hi / lo, 1 / 32e0) as ratio from b{r - 1}), (select unnest(range(0, 33)) as i)),
        c{r} as (select temp, lo, ratio, avg(conf) as conf from (select temp, lo, ratio, sample_id, 1 / sum(exp((l - mx) / temp)) as conf from base, g{r} where sample_id % 4 <> 0 group by 1, 2, 3, 4) group by 1, 2, 3),
        k{r} as (select arg_min(temp, (abs(conf - acc), temp)) as best, min(temp) as t0, max(temp) as t1, any_value(ratio) as ratio from c{r}, a),
        b{r} as (select greatest(t0, best / ratio) as lo, least(t1, best * ratio) as hi, best from k{r})"""
    for r in (1, 2, 3)
)


@query(
    "f12_expected_accuracy_by_day",
    f"""with base as (select sample_id, ln(greatest(p, 1e-12)) as l, max(ln(greatest(p, 1e-12))) over (partition by sample_id) as mx from post where member = 0),
        h as (select m.sample_id, (m.pred = m.label)::int as hit, s.day from mpred m join seq s using (sample_id) where member = 0), a as (select avg(hit) as acc from h where sample_id % 4 <> 0),
        b0 as (select 0.05::double as lo, 25::double as hi), {_ROUNDS},
        t as (select sample_id, 1 / sum(exp((l - mx) / best)) as conf from base, b3 where sample_id % 4 = 0 group by 1)
        select case when day in (select day from h where sample_id % 4 <> 0) then 'seen' else 'new' end as days, count(*) as n, round(avg(conf), 6) as expected, round(avg(hit), 6) as accuracy from t join h using (sample_id) group by 1""",
    "post mpred seq",
)
def f12b(spark, sf):
    d = v.posteriors_wide(spark, sf).select("sample_id", "label", "day", F.col("p0").alias("probs"))
    train, test = d.filter("sample_id % 4 <> 0"), d.filter("sample_id % 4 = 0")
    t = FU.calibration_temperature(train, "label", C)
    seen = train.select("day").distinct().withColumn("_seen", F.lit(True))
    e = FU.expected_accuracy(train, test, "label", t, seen, C)
    return e.select("days", "n", R6("expected").alias("expected"), R6("accuracy").alias("accuracy"))


@query(
    "f13_distillation_target",
    """with adj as (select post.*, ln(greatest(case when member = 3 then p / q else p end, 1e-12)) as l, q from post join prior using (cls)),
            ok as (select sample_id, member, pred = label as ok from mpred),
            z as (select sample_id, cls, coalesce(avg(case when ok then l end), sum(case member when 0 then 0.4e0 when 1 then 0.3e0 when 2 then 0.2e0 else 0.1e0 end * l)) + 0.25 * ln(greatest(any_value(q), 1e-12)) as z,
                  max(ok::int) as any_right from adj join ok using (sample_id, member) group by 1, 2)
       select sample_id, cls, any_right, round(exp(z / 2) / sum(exp(z / 2)) over (partition by sample_id), 6) as target from z""",
    "post prior mpred",
)
def f13(spark, sf):
    d = FU.distillation_target(v.posteriors(spark, sf), ["sample_id"], "label", WEIGHTS, C, prior(spark, sf), PRIOR_WEIGHT, 2.0, [3])
    return d.select("sample_id", "any_right", P.by_class("target", C).alias("cls", "target")).withColumn("target", R6("target"))


@query(
    "f14_missing_member",
    """with m as (select cls, avg(p) as mp from post where member = 1 group by cls),
            z as (select sample_id, post.cls, any_value(label) as label,
                   sum(case member when 0 then 0.4e0 when 1 then 0.3e0 when 2 then 0.2e0 else 0.1e0 end * ln(greatest(case when member = 1 then mp else p end, 1e-12))) as zc,
                   sum(case member when 0 then 0.4e0 when 1 then 0e0 when 2 then 0.2e0 else 0.1e0 end * ln(greatest(p, 1e-12))) as zr
                   from post join m on m.cls = post.cls group by 1, 2),
            r as (select *, row_number() over (partition by sample_id order by round(zc, 9) desc, cls) as rc, row_number() over (partition by sample_id order by round(zr, 9) desc, cls) as rr from z)
       select count(*) filter (where rc = 1 and cls = label) as hits_constant, count(*) filter (where rr = 1 and cls = label) as hits_removed from r""",
    "post",
)
def f14(spark, sf):
    p = v.posteriors(spark, sf)
    both = FU.substitute_member(p, 1, C)
    hits = lambda d, w, name: FU.fuse_log_linear(d, ["sample_id"], w, C, keep=["label"]).agg(F.sum((P.argmax("z", 9, C) == F.col("label")).cast("long")).alias(name))
    a = hits(both, WEIGHTS, "hits_constant")
    return a.withColumn("hits_removed", hits(p, {**WEIGHTS, 1: 0.0}, "h").scalar())


@query(
    "f15_recipe_recovery",
    """with w as (select unnest([0.2, 0.3, 0.4, 0.5, 0.6])::double as w), combos as (select * from (values ('p1', 1e0, 0e0), ('p2', 0e0, 1e0), ('p1+p2', 0.5, 0.5)) t(combo, u1, u2)),
            l as (select sample_id, cls, max(case when member = 0 then ln(greatest(p, 1e-12)) end) as b, max(case when member = 1 then ln(greatest(p, 1e-12)) end) as m1, max(case when member = 2 then ln(greatest(p, 1e-12)) end) as m2 from post group by 1, 2),
            t as (select sample_id, cls, exp(0.6 * b + 0.4 * (0.5 * m1 + 0.5 * m2)) / sum(exp(0.6 * b + 0.4 * (0.5 * m1 + 0.5 * m2))) over (partition by sample_id) as tp from l),
            z as (select sample_id, cls, combo, w, exp((1 - w) * b + w * (u1 * m1 + u2 * m2)) as e from l, combos, w),
            d as (select combo, w, abs(e / sum(e) over (partition by sample_id, combo, w) - tp) as d from z join t using (sample_id, cls))
       select combo, round(w, 3) as w, round(max(d), 6) as max_delta from d group by 1, 2""",
    "post",
)
def f15(spark, sf):
    d = v.posteriors_wide(spark, sf)
    z = F.zip_with(P.safe_log("p0"), F.zip_with(P.safe_log("p1"), P.safe_log("p2"), lambda a, b: 0.5 * a + 0.5 * b), lambda b, m: 0.6 * b + 0.4 * m)
    d = d.select("sample_id", "p0", "p1", "p2", P.softmax(z).alias("target"))
    out = FU.recipe_search(d, "p0", ["p1", "p2"], "target", [0.2, 0.3, 0.4, 0.5, 0.6], C, 2)
    return out.select("combo", F.round("w", 3).alias("w"), R6("max_delta").alias("max_delta"))


@query(
    "f16_group_centring",
    """with g as (select grp, d, avg(v) as m, count(*) as n from vecdim group by 1, 2), a as (select d, avg(v) as am from vecdim where fold <> 0 group by 1),
            c as (select label, d, avg(v) as cm from vecdim group by 1, 2)
       select sample_id, round(max(case when d = 1 then case when n >= 5 then v - m + am else v end end), 6) as c1, round(sum(case when n >= 5 then v - m + am else v end), 6) as c_sum,
              round(sum(abs(v - cm)), 6) as residual_l1 from vecdim join g using (grp, d) join a using (d) join c using (label, d) group by 1""",
    "vecdim",
)
def f16(spark, sf):
    d = v.vectors(spark, sf)
    mean = d.filter("fold <> 0").agg(P.vector_agg(F.avg, "vec", v.EMB_DIM).alias("m"))
    c = FU.centre_groups(d, "grp", "vec", v.EMB_DIM, mean)
    c = FU.class_residual(c, "label", "vec", v.EMB_DIM, v.EMB_CLASSES)
    l1 = P.total(F.transform("residual", F.abs))
    return c.select("sample_id", R6(F.col("centred")[0]).alias("c1"), R6(P.total("centred")).alias("c_sum"), R6(l1).alias("residual_l1"))


@query(
    "f17_conditioned_blend",
    """with w as (select a.sample_id, a.pred in (0, 1, 4) or b.pred in (0, 1, 4) as in_set from mpred a join mpred b using (sample_id) where a.member = 0 and b.member = 1)
       select sample_id, in_set, cls, round(sum(case when member = 0 then 1 - (case when in_set then 0.6 else 0.2 end) else (case when in_set then 0.6 else 0.2 end) end * p), 6) as p
       from post join w using (sample_id) where member < 2 group by 1, 2, 3""",
    "post mpred",
)
def f17(spark, sf):
    d = FU.conditioned_blend(v.posteriors_wide(spark, sf), "p0", "p1", [0, 1, 4], 0.6, 0.2, C)
    return d.select("sample_id", "in_set", P.by_class("blended", C).alias("cls", "p")).select("sample_id", "in_set", "cls", R6("p").alias("p"))


@query(
    "f18_masked_pooling",
    """with b as (select *, conf >= 0.03 as present from boxes), r as (select clip, conf * 10 as x, row_number() over (partition by clip order by conf desc, tie1, tie2, frame, tie3) as rk from b where present),
            p as (select clip, avg(x) as mean, max(x) as mx, avg(case when rk <= 2 then x end) as tk, sum(exp(x) * x) / sum(exp(x)) as sm from r group by clip)
       select k.clip, round(coalesce(mean, 0), 6) as mean, round(coalesce(mx, 0), 6) as max, round(coalesce(tk, 0), 6) as top_k_mean, round(coalesce(sm, 0), 6) as softmax_mean
       from (select distinct clip from boxes) k left join p using (clip)""",
    "boxes",
)
def f18(spark, sf):
    d = v.boxes(spark, sf).withColumn("x", F.col("conf") * 10)
    out = FU.masked_pool(d, ["clip"], F.col("conf") >= 0.03, "x", ["tie1", "tie2", "frame", "tie3"], 2)
    return out.select("clip", *[R6(c).alias(c) for c in ("mean", "max", "top_k_mean", "softmax_mean")])
