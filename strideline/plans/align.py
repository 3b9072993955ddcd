"""Joins, alignment and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideline.functions import posterior as P
from strideline.functions import vectors as V
from strideline.operators import align as A
from strideline.operators import scan
from strideline.operators import timeseries as ts
from strideline.plans import views as v
from strideline.plans.registry import query

C = v.N_CLASSES
R6 = lambda c: F.round(c, 6)


@query(
    "j1_strict_align",
    """select a.sample_id, round(max(a.p), 6) as conf_a, round(max(b.p), 6) as conf_b from post a join post b
       on a.sample_id = b.sample_id and a.cls = b.cls and a.member = 0 and b.member = 1 group by a.sample_id""",
    "post",
)
def j1(spark, sf):
    p = v.posteriors(spark, sf)
    side = lambda m, name: p.filter(F.col("member") == m).select("sample_id", F.col("probs").alias(name))
    d = A.align_strict(side(0, "a"), side(1, "b"), "sample_id")
    return d.select("sample_id", R6(P.confidence("a")).alias("conf_a"), R6(P.confidence("b")).alias("conf_b"))


@query(
    "j2_zero_fill_align",
    """with m as (select sample_id, sum(p) as s, max(p) as mx from post where member = 2 and sample_id % 7 <> 3 group by sample_id)
       select seq.sample_id, round(coalesce(s, 0), 6) as mass, round(coalesce(mx, 0), 6) as conf from seq left join m using (sample_id)""",
    "post",
)
def j2(spark, sf):
    m = v.posteriors(spark, sf).filter((F.col("member") == 2) & (F.col("sample_id") % 7 != 3))
    d = A.align_zero_fill(v.seq(spark, sf).select("sample_id"), m, "sample_id", "probs", C)
    return d.select("sample_id", R6(P.total("probs")).alias("mass"), R6(P.confidence("probs")).alias("conf"))


_HOLES = "(member * 3 + sample_id) % 11 <> 0"


@query(
    "j3_intersection_align",
    f"""with h as (select * from mpred where {_HOLES}), c as (select sample_id from h group by sample_id having count(distinct member) = 4)
        select member, count(*) as n, round(avg(conf), 6) as mean_conf from h join c using (sample_id) group by member""",
    "mpred",
)
def j3(spark, sf):
    d = A.align_intersection(v.posteriors(spark, sf).filter(_HOLES), "sample_id", v.MEMBERS)
    return d.groupBy("member").agg(F.count("*").alias("n"), R6(F.avg(P.confidence("probs"))).alias("mean_conf"))


@query(
    "j4_concat_first_wins",
    """with t as (select sample_id, member, conf, row_number() over (partition by sample_id order by member) as first_rn,
                  row_number() over (partition by sample_id order by member desc) as last_rn
                  from mpred where sample_id % 4 = member or sample_id % 5 = member or member = 3)
       select sample_id, max(case when first_rn = 1 then member end) as first_member, max(case when last_rn = 1 then member end) as last_member,
              round(max(case when first_rn = 1 then conf end), 6) as first_conf from t group by sample_id""",
    "mpred",
)
def j4(spark, sf):
    w = v.posteriors_wide(spark, sf)
    k = F.col("sample_id")
    parts = [w.filter((k % 4 == m) | (k % 5 == m) | F.lit(m == 3)).select("sample_id", F.lit(m).alias("member"), P.confidence(f"p{m}").alias("conf")) for m in range(v.MEMBERS)]
    first, last = A.concat_first(parts, "sample_id"), A.concat_first(parts, "sample_id", last=True)
    return first.select("sample_id", F.col("member").alias("first_member"), R6("conf").alias("first_conf")).join(
        last.select("sample_id", F.col("member").alias("last_member")), "sample_id"
    )


def _streams(spark, sf):
    c = v.clips(spark, sf)
    a = c.filter(F.col("label") == "click").select((F.col("user") % 20).alias("k"), "us", F.col("sample_id").alias("anchor_id"))
    s = c.filter(F.col("label") == "view").select((F.col("user") % 20).alias("k"), "us", F.col("sample_id").alias("sid"), "value")
    return a, s


_STREAMS_SQL = """a as (select "user" % 20 as k, us, sample_id as anchor_id from clips where label = 'click'),
  s as (select "user" % 20 as k, us as sus, sample_id as sid, value from clips where label = 'view')"""
HALF_HOUR = 1800 * 1000000


@query(
    "j5_asof_nearest",
    f"""with {_STREAMS_SQL}, c as (select anchor_id, sid, value, abs(sus - us) as gap, row_number() over (partition by anchor_id order by abs(sus - us), sus, sid) as rn
          from a join s using (k))
        select a.anchor_id, case when gap <= 1800000000 then sid end as matched_sid, round(case when gap <= 1800000000 then value end, 6) as matched_value
        from a left join c on a.anchor_id = c.anchor_id and rn = 1""",
    "clips",
)
def j5(spark, sf):
    a, s = _streams(spark, sf)
    d = ts.asof_nearest(a, s, ["k"], "us", "sid", ["value"], HALF_HOUR, v.DAY * 1000000)
    return d.select("anchor_id", "matched_sid", R6("matched_value").alias("matched_value"))


@query(
    "j6_asof_forward",
    f"""with {_STREAMS_SQL}, c as (select anchor_id, sid, value, sus - us as gap, row_number() over (partition by anchor_id order by sus, sid) as rn
          from a join s using (k) where sus >= us)
        select a.anchor_id, case when gap < 1800000000 then sid end as matched_sid, round(case when gap < 1800000000 then value end, 6) as matched_value
        from a left join c on a.anchor_id = c.anchor_id and rn = 1""",
    "clips",
)
def j6(spark, sf):
    a, s = _streams(spark, sf)
    d = ts.asof_nearest(a, s, ["k"], "us", "sid", ["value"], HALF_HOUR, v.DAY * 1000000, forward=True)
    return d.select("anchor_id", "matched_sid", R6("matched_value").alias("matched_value"))


@query(
    "j7_label_check",
    """select label = (sample_id % 5) as same, count(*) as n from seq join (select distinct sample_id as sid from post where member = 0) p on p.sid = sample_id group by 1""",
    "post",
)
def j7(spark, sf):
    post = v.posteriors_wide(spark, sf).select("sample_id", (F.col("sample_id") % 5).cast("int").alias("label"))
    meta = v.seq(spark, sf).select("sample_id", F.col("label").alias("meta_label"))
    d = A.attach_checked(post, meta, "sample_id", "label", "meta_label")
    return d.groupBy((~F.col("label_differs")).alias("same")).agg(F.count("*").alias("n"))


@query(
    "j8_fingerprint_join",
    """with now as (select page_id, sha1(url) as fp from pages where page_id % 9 <> 4),
          cached as (select page_id, case when page_id % 6 = 1 then sha1(url || 'x') else sha1(url) end as fp from pages where page_id % 5 <> 2)
       select status, count(*) as n from (select case when c.fp is null then 'live' when c.fp = now.fp then 'accepted' else 'rejected' end as status
              from cached c full join now using (page_id)) group by status""",
)
def j8(spark, sf):
    k = F.col("page_id")
    p = v.table(spark, sf, "pages").select("page_id", "url")
    now = p.filter(k % 9 != 4).select("page_id", F.sha1("url").alias("fp"))
    cached = p.filter(k % 5 != 2).select("page_id", F.when(k % 6 == 1, F.sha1(F.concat("url", F.lit("x")))).otherwise(F.sha1("url")).alias("fp"))
    return A.fingerprint_status(cached, now, "page_id", "fp").groupBy("status").agg(F.count("*").alias("n"))


@query(
    "j9_cohort_attach",
    """select c_mktsegment as cohort, count(c_custkey) as n_meta, count(s.subject) as n_with_rows from customer
       full join (select distinct subject from seq) s on s.subject = c_custkey group by 1""",
    "seq",
)
def j9(spark, sf):
    cohorts = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("cohort"), F.lit(1).alias("_c"))
    subjects = v.seq(spark, sf).select("subject").distinct().withColumn("_s", F.lit(1))
    d = cohorts.join(subjects, "subject", "full_outer")
    return d.groupBy("cohort").agg(F.count("_c").alias("n_meta"), F.count("_s").alias("n_with_rows"))


@query(
    "j10_semi_anti_subject",
    """select case when subject in (select c_custkey from customer where c_acctbal < 0) then 'excluded' else 'kept' end as side, label, count(*) as n
       from seq group by 1, 2""",
    "seq",
)
def j10(spark, sf):
    poor = v.table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("subject"))
    s = v.seq(spark, sf).select("subject", "label")
    side = lambda ex, name: A.semi_by_subject(s, poor, "subject", ex).groupBy("label").agg(F.count("*").alias("n")).withColumn("side", F.lit(name))
    return side(True, "kept").unionByName(side(False, "excluded"))


@query(
    "j11_prototype_scores",
    """with c as (select label as proto_cls, d, avg(v) as m from vecdim group by label, d),
            s as (select sample_id, label, proto_cls, sum(v * m) / (sqrt(sum(v * v)) * sqrt(sum(m * m))) as score from vecdim join c using (d) group by sample_id, label, proto_cls)
       select sample_id, proto_cls, round(score, 6) as score from s""",
    "vecdim",
)
def j11(spark, sf):
    d = v.vectors(spark, sf)
    protos = d.groupBy("label").agg(P.vector_agg(F.avg, "vec", v.EMB_DIM).alias("proto"))
    s = A.score_prototypes(d, protos, "label", v.EMB_CLASSES, v.EMB_DIM, V.cosine)
    return s.select("sample_id", "proto_cls", R6("score").alias("score"))


@query(
    "j12_neighbour_self_join",
    """select subject, count(*) as n_pairs, sum(case when label = pl then 1 else 0 end)::bigint as same_label, sum(t0 - pt)::bigint as gap_sum from
       (select subject, label, t0, lag(label) over w as pl, lag(t0) over w as pt from seq window w as (partition by subject order by t0, sample_id)) where pt is not null group by subject""",
    "seq",
)
def j12(spark, sf):
    d = scan.ordered_scan(v.seq(spark, sf), ["subject"], ["t0", "sample_id"], "year", prev=["label", "t0"]).filter("prev_t0 is not null")
    return d.groupBy("subject").agg(
        F.count("*").alias("n_pairs"), F.sum((F.col("label") == F.col("prev_label")).cast("long")).alias("same_label"), F.sum(F.col("t0") - F.col("prev_t0")).alias("gap_sum")
    )


@query(
    "j13_interval_join",
    """with r as (select "user" % 20 as k, us as s, us + 600000000 as e, sample_id as rid from clips where label = 'purchase'),
            l as (select k, s, e, rid, lead(s) over (partition by k order by s, rid) as nx from r),
            p as (select "user" % 20 as k, us, sample_id from clips where label = 'view'),
            m as (select p.sample_id, p.us, arg_max(l.rid, l.s) as rid, max(l.s) as s from p join l on p.k = l.k and l.s <= p.us and (l.nx is null or p.us < l.nx) group by 1, 2)
       select p.sample_id, coalesce(p.us <= m.s + 600000000, false) as covered, case when p.us <= m.s + 600000000 then rid end as rid from p left join m using (sample_id)""",
    "clips",
)
def j13(spark, sf):
    c = v.clips(spark, sf).withColumn("k", F.col("user") % 20)
    r = c.filter("label = 'purchase'").select("k", F.col("us").alias("s"), (F.col("us") + 600 * 1000000).alias("e"), F.col("sample_id").alias("rid"))
    p = c.filter("label = 'view'").select("k", "us", "sample_id")
    return ts.covering_interval(p, r, ["k"], "us", "s", "e", v.DAY * 1000000).select("sample_id", "covered", "rid")


@query(
    "u1_id_intersection",
    "select sample_id from seq where sample_id % 3 <> 0 intersect select sample_id from seq where sample_id % 5 <> 1 intersect select o_orderkey from orders where o_orderstatus <> 'P'",
    "seq",
)
def u1(spark, sf):
    s = v.seq(spark, sf).select("sample_id")
    o = v.table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("sample_id"))
    return s.filter("sample_id % 3 <> 0").intersect(s.filter("sample_id % 5 <> 1")).intersect(o)


@query(
    "u2_missing_extra_duplicate",
    """with a as (select o_orderkey as id from orders where o_orderkey % 10 <> 3), b as (select l_orderkey as id from lineitem where l_linenumber <= 2),
            na as (select id, count(*) as l from a group by id), nb as (select id, count(*) as r from b group by id),
            j as (select id, coalesce(l, 0) as l, coalesce(r, 0) as r from na full join nb using (id))
       select issue, count(*) as n from (select 'missing' as issue from j where r = 0 union all select 'extra' from j where l = 0
              union all select 'duplicate' from j where l > 1 or r > 1) group by issue""",
)
def u2(spark, sf):
    a = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")).filter("id % 10 <> 3")
    b = v.table(spark, sf, "lineitem").filter("l_linenumber <= 2").select(F.col("l_orderkey").alias("id"))
    return A.id_issues(a, b, "id").groupBy("issue").agg(F.count("*").alias("n"))


@query(
    "u3_partition_check",
    """with f as (select sample_id, subject, case when subject % 41 = 7 then sample_id % 4 else subject % 4 end as fold, label from seq),
            g as (select fold, c as label from (select distinct fold from f) cross join (values (0), (1), (2), (3), (4)) t(c)),
            n as (select fold, label, count(*) as c from f group by 1, 2), al as (select label, sum(c) as a from n group by 1)
       select 'sample_in_several_folds' as rule, count(*) as n from (select sample_id from f group by 1 having count(distinct fold) > 1)
       union all select 'subject_in_several_folds', count(*) from (select subject from f group by 1 having count(distinct fold) > 1)
       union all select 'class_missing_in_training', count(*) from g left join n using (fold, label) left join al using (label) where coalesce(a, 0) - coalesce(c, 0) <= 0""",
    "seq",
)
def u3(spark, sf):
    f = v.seq(spark, sf).withColumn("fold", F.when(F.col("subject") % 41 == 7, F.col("sample_id") % 4).otherwise(F.col("subject") % 4))
    return A.partition_violations(f, "sample_id", "subject", "fold", "label", C)


@query(
    "u4_pooled_folds",
    "select subject % 4 as fold, count(*) as n, sum((pred = label)::int)::bigint as hits from mpred where member = subject % 4 group by 1",
    "mpred",
)
def u4(spark, sf):
    w = v.posteriors_wide(spark, sf)
    parts = [w.filter(F.col("subject") % 4 == f).select(F.lit(f).cast("long").alias("fold"), "label", P.argmax(f"p{f}", 9).alias("pred")) for f in range(4)]
    pooled = parts[0]
    for p in parts[1:]:
        pooled = pooled.unionByName(p)
    return pooled.groupBy("fold").agg(F.count("*").alias("n"), F.sum((F.col("pred") == F.col("label")).cast("long")).alias("hits"))


@query(
    "u5_subset_enumeration",
    """with s as (select subject % 16 as g, sum((pred = label)::int) as h, count(*) as n from mpred where member = 0 group by 1),
            q as (select (a.h + b.h + c.h + d.h) / (a.n + b.n + c.n + d.n)::double as acc, (a.g < 8)::int + (b.g < 8)::int + (c.g < 8)::int + (d.g < 8)::int as early
                  from s a join s b on a.g < b.g join s c on b.g < c.g join s d on c.g < d.g),
            k as (select 'all' as kind, acc from q union all select 'matched', acc from q where early = 2)
       select kind, count(*) as n_subsets, round(avg(acc), 6) as mean, round(min(acc), 6) as min, round(quantile_cont(acc, 0.05), 6) as p5,
              round(quantile_cont(acc, 0.1), 6) as p10, round(quantile_cont(acc, 0.25), 6) as p25 from k group by kind""",
    "mpred",
)
def u5(spark, sf):
    d = v.posteriors_wide(spark, sf).select((F.col("subject") % 16).alias("g"), (P.argmax("p0", 9) == F.col("label")).cast("long").alias("ok"))
    per = d.groupBy("g").agg(F.sum("ok").alias("h"), F.count("*").alias("n"))
    out = A.subset_quantiles(per, "g", "h", "n", 4, {"p5": 0.05, "p10": 0.1, "p25": 0.25}, (F.col("g") < 8).cast("int"), {"matched": 2})
    return out.select("kind", "n_subsets", *[R6(c).alias(c) for c in ("mean", "min", "p5", "p10", "p25")])
