"""Sorts, limits, top-k and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideline.functions import posterior as P
from strideline.operators import learn as L
from strideline.operators import sampling as T
from strideline.plans import views as v
from strideline.plans.evaluate import rounded
from strideline.plans.registry import query

C = v.N_CLASSES
R6 = lambda c: F.round(c, 6)


@query(
    "t1_top_k_accuracy",
    """with h as (select sample_id, member, rk from mranked where cls = label), b as (select sample_id, min(rk) as rk from h group by 1)
       select member::varchar as member, round(avg((rk <= 1)::int), 6) as top_1, round(avg((rk <= 2)::int), 6) as top_2, round(avg((rk <= 3)::int), 6) as top_3 from h group by 1
       union all select 'any', round(avg((rk <= 1)::int), 6), round(avg((rk <= 2)::int), 6), round(avg((rk <= 3)::int), 6) from b""",
    "mranked",
)
def t1(spark, sf):
    return rounded(T.top_k_accuracy(v.posteriors(spark, sf), "sample_id", "label", [1, 2, 3], v.N_CLASSES))


@query(
    "t2_top_fraction",
    """with p as (select sample_id, round(conf, 9) as conf, pred from mpred where member = 0 and subject % 4 <> 2 and sample_id % 6 <> 1)
       select sample_id, round(conf, 6) as conf, pred as pseudo_label from p qualify row_number() over (order by conf desc, sample_id) <= greatest(1, floor(0.3 * count(*) over ()))""",
    "mpred",
)
def t2(spark, sf):
    w = v.posteriors_wide(spark, sf).select("sample_id", "subject", F.col("p0").alias("probs"))
    out = T.top_fraction(w, "sample_id", "probs", 0.3, w.filter("subject % 4 = 2"), w.filter("sample_id % 6 = 1"), v.N_CLASSES)
    return rounded(out)


@query(
    "t3_confident_by_subject",
    "select subject, count(*) as n, round(avg((pred = label)::int), 6) as acc from mpred where member = 1 and round(conf, 9) >= 0.7 group by 1 having count(*) >= 3",
    "mpred",
)
def t3(spark, sf):
    w = v.posteriors_wide(spark, sf)
    return rounded(T.confident_by_subject(w, "subject", "p1", "label", 0.7, 3))


@query(
    "t4_inverse_frequency_weight",
    """with n as (select label, count(*) as n from seq group by 1) select label, count(*) as n_rows, round(sum(1.0::double / (n * (select count(*) from n))), 6) as class_share, round(any_value(1e6 / (n * (select count(*) from n))), 4) as weight_ppm
       from seq join n using (label) group by 1""",
    "seq",
)
def t4(spark, sf):
    w = T.inverse_frequency_weights(v.seq(spark, sf), "label")
    return w.groupBy("label").agg(F.count("*").alias("n_rows"), R6(F.sum("weight")).alias("class_share"), F.round(F.first("weight") * 1e6, 4).alias("weight_ppm"))


@query(
    "t4_weighted_replicates",
    """with w as (select label, count(*) as n from seq group by 1), m as (select label, 1.0::double / (n * (select count(*) from w)) * (select sum(n) from w) as m from w),
            c as (select label, sum(exp(-m + i * ln(m) - lgamma(i + 1))) over (partition by label order by i) as c from m, (select unnest(range(0, 80)) as i)),
            u as (select sample_id, label, ('0x' || substr(md5('3:' || sample_id), 1, 13))::bigint / 4503599627370496.0::double as u from seq)
       select u.label, count(distinct sample_id) as n_rows, count(c.c) as n_copies from u left join c on c.label = u.label and c.c < u.u group by 1""",
    "seq",
)
def t4b(spark, sf):
    w = T.weighted_replicates(T.inverse_frequency_weights(v.seq(spark, sf), "label"), "sample_id", None, 3)
    return w.groupBy("label").agg(F.count("*").alias("n_rows"), F.sum("copies").alias("n_copies"))


@query(
    "t5_cap_per_class",
    "select sample_id, label from seq qualify row_number() over (partition by label order by sha256('11:' || sample_id), sample_id) <= 60",
    "seq",
)
def t5(spark, sf):
    return T.cap_per_class(v.seq(spark, sf).select("sample_id", "label"), "label", "sample_id", 60, 11)


_BATCHES = """with r as (select sample_id, label, subject, row_number() over (partition by label, subject order by sha256('5:' || sample_id), sample_id) as rnd from seq where label in (select label from seq group by 1 having count(distinct subject) >= 2)),
            p as (select *, (row_number() over (partition by label order by rnd, sha256('5:' || subject), subject, sample_id) - 1) // 4 as unit from r),
            u as (select label, unit, row_number() over (partition by label order by unit) as turn from p group by 1, 2 having count(*) = 4 and count(distinct subject) >= 2),
            b as (select label, unit, (row_number() over (order by turn, sha256('5:' || turn || ':' || label), label) - 1) // 3 as batch from u),
            f as (select batch from b group by 1 having count(distinct label) = 3)
       select sample_id, label, subject, batch::bigint as batch from p join b using (label, unit) where batch in (select batch from f)"""


@query("t6_balanced_batches", _BATCHES, "seq")
def t6(spark, sf):
    return T.balanced_batches(v.seq(spark, sf), "label", "subject", "sample_id", 3, 4, 5)


@query(
    "t6_batch_rules",
    "select 'class_with_other_than_4_rows' as rule, 0::bigint as n union all select 'unit_of_one_subject', 0 union all select 'batch_with_other_than_3_classes', 0 union all select 'row_used_twice', 0",
)
def t6b(spark, sf):
    b = T.balanced_batches(v.seq(spark, sf), "label", "subject", "sample_id", 3, 4, 5)
    cell = b.groupBy("batch", "label").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("u"))
    n = lambda d, cond, rule: d.agg(F.sum(cond.cast("long")).alias("n")).select(F.lit(rule).alias("rule"), "n")
    classes = cell.groupBy("batch").agg(F.count("*").alias("c"))
    twice = b.groupBy("sample_id").agg(F.count("*").alias("c"))
    return (
        n(cell, F.col("n") != 4, "class_with_other_than_4_rows").unionByName(n(cell, F.col("u") < 2, "unit_of_one_subject"))
        .unionByName(n(classes, F.col("c") != 3, "batch_with_other_than_3_classes")).unionByName(n(twice, F.col("c") > 1, "row_used_twice"))
    )


@query(
    "t7_cross_subject_pairs",
    """with c as (select label, subject, count(*) as c from seq group by 1, 2)
       select label, ((pow(sum(c), 2) - sum(c * c)) / 2)::bigint as n_pairs, case when count(*) > 1 then sum(c) else 0 end::bigint as rows_with_partner from c group by 1""",
    "seq",
)
def t7(spark, sf):
    return T.cross_subject_pair_counts(v.seq(spark, sf), "label", "subject")


@query(
    "t7_batch_positive_pairs",
    f"""with bb as ({_BATCHES}) select a.label, count(*) as n_pairs from bb a join bb b on a.batch = b.batch and a.label = b.label and a.sample_id < b.sample_id and a.subject <> b.subject group by 1""",
    "seq",
)
def t7b(spark, sf):
    b = T.balanced_batches(v.seq(spark, sf), "label", "subject", "sample_id", 3, 4, 5)
    return T.batch_positive_pairs(b, "sample_id", "label", "subject").groupBy("label").agg(F.count("*").alias("n_pairs"))


_COVERING = """with us as (select label, subject, count(*) as c from seq where label is not null group by 1, 2),
            k0 as (select label, sum(c)::bigint as n, max(c) as m from us group by 1 having count(*) >= 2),
            k as (select *, greatest((n + 3) // 4, (m + 2) // 3) as least, 4 * m > 3 * n as hot from k0),
            nb as (select greatest(max(least), (sum(least)::bigint + 2) // 3)::bigint as b, sum(least)::bigint as needed from k),
            ex as (select label, row_number() over (order by t, label) as rk from (select label, unnest(range(least, (select b from nb))) as t from k)),
            v as (select k.*, least + (select count(*) from ex, nb where ex.label = k.label and rk <= 3 * b - needed) as v from k),
            f as (select *, (sum(v) over (order by label) - v)::bigint as f from v),
            r as (select seq.sample_id, seq.label, seq.subject, f.*  exclude (label), hot and us.c = m as most from seq join us using (label, subject) join f using (label)),
            p as (select *, row_number() over (partition by label, most order by sha256('5:' || subject), subject, sha256('5:' || sample_id), sample_id) - 1 as i,
                         case when not hot then n when most then m else n - m end as ofs, v * case when not hot then 4 when most then 3 else 1 end as slots, case when hot and not most then 3 * v else 0 end as start from r),
            s as (select *, unnest(range((start + i * slots // ofs)::bigint, (start + (i + 1) * slots // ofs)::bigint)) as slot from p),
            o as (select bb, row_number() over (order by sha256('5:' || bb), bb) - 1 as batch from (select unnest(range(b)) as bb from nb))
       select sample_id, label, subject, batch::bigint as batch from s join o on bb = (f + slot % v) % (select b from nb)"""


def _covering(spark, sf):
    return T.covering_batches(v.seq(spark, sf), "label", "subject", "sample_id", 3, 4, 5)


@query("t6_covering_batches", _COVERING, "seq")
def t6c(spark, sf):
    return _covering(spark, sf)


@query(
    "t6_covering_rules",
    """select 'rows_in_a_batch' as rule, count(*) as n from seq where label in (select label from seq group by 1 having count(distinct subject) >= 2)
       union all select 'class_with_other_than_4_rows', 0 union all select 'row_twice_in_a_class', 0 union all select 'unit_of_one_subject', 0 union all select 'batch_with_other_than_3_classes', 0""",
    "seq",
)
def t6d(spark, sf):
    b = _covering(spark, sf)
    cell = b.groupBy("batch", "label").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("u"), F.count_distinct("sample_id").alias("d"))
    classes = cell.groupBy("batch").agg(F.count("*").alias("c"))
    n = lambda d, cond, rule: d.agg(F.sum(cond.cast("long")).alias("n")).select(F.lit(rule).alias("rule"), "n")
    return (
        b.agg(F.count_distinct("sample_id").alias("n")).select(F.lit("rows_in_a_batch").alias("rule"), "n")
        .unionByName(n(cell, F.col("n") != 4, "class_with_other_than_4_rows")).unionByName(n(cell, F.col("d") != F.col("n"), "row_twice_in_a_class"))
        .unionByName(n(cell, F.col("u") < 2, "unit_of_one_subject")).unionByName(n(classes, F.col("c") != 3, "batch_with_other_than_3_classes"))
    )


@query(
    "t7_covering_positive_pairs",
    f"""with bb as ({_COVERING}) select a.label, count(*) as n_pairs from bb a join bb b on a.batch = b.batch and a.label = b.label and a.sample_id < b.sample_id and a.subject <> b.subject group by 1""",
    "seq",
)
def t7c(spark, sf):
    return T.batch_positive_pairs(_covering(spark, sf), "sample_id", "label", "subject").groupBy("label").agg(F.count("*").alias("n_pairs"))


@query("t8_seeded_shuffle", "select subject, sample_id, row_number() over (partition by subject order by sha256('42:' || subject || ':' || sample_id), subject, sample_id) as place from seq", "seq")
def t8(spark, sf):
    d = T.seeded_rank(v.seq(spark, sf).select("subject", "sample_id"), ["subject"], 42, ["subject", "sample_id"], "place")
    return d.select("subject", "sample_id", F.col("place").cast("long").alias("place"))


@query(
    "t9_hash_split",
    "select sample_id, right(md5(sample_id::varchar), 1) in ('0', '4', '8', 'c') as held_out from seq",
    "seq",
)
def t9(spark, sf):
    return T.md5_split(v.seq(spark, sf).select("sample_id"), "sample_id")


@query("t10_subject_curve")
def t10(spark, sf):
    d = v.vectors(spark, sf)
    subjects = d.select("subject").distinct()
    return rounded(L.subject_curve(d, "vec", "label", "subject", subjects.filter("subject >= 4"), subjects.filter("subject < 4"), [2, 8], 2))
