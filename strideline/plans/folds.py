"""Fold design and learners (M1-M7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideline.functions import posterior as P
from strideline.functions import vectors as V
from strideline.operators import folds as FO
from strideline.operators import learn as L
from strideline.operators import trees as TR
from strideline.operators import timeseries as ts
from strideline.plans import views as v
from strideline.plans.evaluate import rounded
from strideline.plans.registry import query

C = v.N_CLASSES
R6 = lambda c: F.round(c, 6)


def _study(spark, sf):
    """Rows of a study with two blocks of eight subjects, ids with a gap between them."""
    s = F.col("subject") % 16
    return v.seq(spark, sf).select("sample_id", F.when(s < 8, s + 1).otherwise(s + 8).alias("user"), "label")


@query(
    "m1_balanced_folds",
    """select fold, 4::bigint as n_subjects, 5::bigint as n_classes from (select unnest([0, 1, 2, 3]) as fold)""",
)
def m1(spark, sf):
    d = _study(spark, sf)
    q = FO.fold_quality(d, FO.balanced_folds(d, "user", "label", C, 4), "user", "label")
    return q.select("fold", "n_subjects", "n_classes")


@query(
    "m2_round_robin_folds",
    "select subject, ((dense_rank() over (order by subject) - 1) % 4)::int as fold, count(*) as n from seq group by 1",
    "seq",
)
def m2(spark, sf):
    s = v.seq(spark, sf)
    f = FO.round_robin_folds(s, "subject", 4, F.floor(F.col("subject") / 1024))
    return s.join(f, "subject").groupBy("subject", "fold").agg(F.count("*").alias("n"))


@query("m2_leave_one_subject_out", "select subject, dense_rank() over (order by subject) - 1 as fold from (select distinct subject from seq)", "seq")
def m2b(spark, sf):
    return FO.leave_one_out_folds(v.seq(spark, sf), "subject", F.floor(F.col("subject") / 1024)).select("subject", F.col("fold").cast("long").alias("fold"))


@query(
    "m3_extra_trees",
    "select subject % 4 as fold, count(*) as n, count(*) as summing_to_one, count(distinct label) as n_labels from vectors group by 1",
    "vectors",
)
def m3_trees(spark, sf):
    """Extremely randomised trees per fold, each row scored once by trees that never saw its subject."""
    d = v.vectors(spark, sf).select("sample_id", "vec", "label", (F.col("subject") % 4).cast("long").alias("fold"))
    forest = TR.grow_forest(d, "vec", "label", "fold", 4, v.EMB_CLASSES, v.EMB_DIM, trees=10, depth=5)
    out = TR.forest_posteriors(d, "sample_id", "vec", "fold", forest, v.EMB_CLASSES, v.EMB_DIM).join(d.select("sample_id", "label"), "sample_id")
    whole = F.round(P.total("probs"), 9) == 1
    return out.groupBy("fold").agg(F.count("*").alias("n"), F.sum(whole.cast("long")).alias("summing_to_one"), F.count_distinct("label").alias("n_labels"))


@query("m3_forest_posteriors")
def m3(spark, sf):
    d = v.vectors(spark, sf).select("sample_id", "vec", "label", (F.col("subject") % 4).cast("int").alias("fold"))
    out = L.forest_oof(d, "vec", "label", "fold", 4, v.EMB_CLASSES, trees=20, depth=5)
    ok = (P.argmax("probs") == F.col("label")).cast("double")
    return out.groupBy("fold").agg(F.count("*").alias("n"), F.avg(ok).alias("acc"), F.min(F.array_min("probs")).alias("least_prob"), F.max(F.abs(P.total("probs") - 1)).alias("sum_error"))


@query(
    "m4_pair_features",
    """with f as (select sample_id, cls, member, p, ln(p + 1e-12) as lg, rk - 1 as rk, p - max(p) over w as mg, -sum(p * ln(greatest(p, 1e-12))) over w as en, max(p) over w as tp from mranked window w as (partition by sample_id, member))
       select sample_id, cls, round(max(case when member = 1 then p end), 6) as p_1, max(case when member = 2 then rk end)::int as rank_2, round(max(case when member = 0 then mg end), 6) as margin_0, round(max(case when member = 3 then en end), 6) as entropy_3,
              round(max(case when member = 1 then tp end), 6) as top_1, round(avg(lg), 6) as geo, round(avg(p), 6) as arith, sum((rk = 0)::int)::int as votes from f group by 1, 2""",
    "mranked",
)
def m4(spark, sf):
    d = L.pair_features(v.posteriors(spark, sf), ["sample_id"], list(range(v.MEMBERS)), C)
    return rounded(d.select("sample_id", "cls", "p_1", "rank_2", "margin_0", "entropy_3", "top_1", "geo", "arith", "votes"))


@query("m5_boosted_stacker")
def m5(spark, sf):
    d = v.posteriors_wide(spark, sf).withColumn("fold", (F.col("subject") % 2).cast("int"))
    out = L.boosted_stacker(d, ["sample_id"], "label", "fold", 2, [f"p{m}" for m in range(v.MEMBERS)], C, rounds=5)
    return out.groupBy("fold").agg(F.count("*").alias("n"), F.avg((F.col("pred") == F.col("label")).cast("double")).alias("acc"))


@query("m6_logistic_probe")
def m6(spark, sf):
    d = v.vectors(spark, sf).select("sample_id", "vec", "label", (F.col("subject") % 4).cast("int").alias("fold"))
    out = L.logistic_oof(d, "vec", "label", "fold", 4)
    return out.groupBy("fold").agg(F.count("*").alias("n"), F.avg((F.col("pred") == F.col("label")).cast("double")).alias("acc"))


@query("m7_pair_verifier")
def m7(spark, sf):
    d = v.vectors(spark, sf)
    table = d.groupBy("label").agg(P.vector_agg(F.avg, "vec", v.EMB_DIM).alias("c")).agg(F.sort_array(F.collect_list(F.struct("label", "c"))).alias("t"))
    z = F.transform("_t", lambda s: F.round(V.cosine("vec", s["c"]), 9))
    d = d.withColumn("_t", table.scalar()).withColumn("_r", P.ranked_classes(z))
    d = d.select("sample_id", "vec", "label", (F.col("subject") % 4).cast("int").alias("fold"), F.col("_r")[0].alias("a"), F.col("_r")[1].alias("b"))
    out = L.pair_verifier(d, "vec", "label", "a", "b", "fold", 4, v.EMB_CLASSES, v.EMB_DIM)
    dec = out.filter("label = a or label = b")
    return dec.groupBy("fold").agg(F.count("*").alias("n"), F.avg((F.col("pick") == F.col("label")).cast("double")).alias("acc"), F.avg((F.col("a") == F.col("label")).cast("double")).alias("base"))
