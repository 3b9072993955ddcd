"""Evaluation, statistics and model selection."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from strideline.functions import posterior as P
from strideline.functions import vectors as V
from strideline.operators import evaluate as E
from strideline.operators import fusion as FU
from strideline.operators import learn as L
from strideline.operators import ward as WD
from strideline.operators.scan import settings
from strideline.plans import views as v
from strideline.plans.fusion import WEIGHTS, fused, fused_wide, prior, scored
from strideline.plans.registry import query

C = v.N_CLASSES
R6 = lambda c: F.round(c, 6)


def rounded(df, *keep):
    """Round every double column but those to keep."""
    return df.select(*[R6(c).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def whole_ratio(top, base):
    """Millionths of a ratio of whole numbers, rounded half up by whole-number division."""
    wide = lambda c: c.cast("decimal(38,0)")
    return F.call_function("div", wide(2000000 * wide(top)) + wide(base), wide(2 * wide(base)))


@query(
    "e1_accuracy",
    """with k as (select label, count(*) as n, sum((pred = label)::int) as h from fpred group by 1)
       select sum(n)::bigint as n, round(sum(h) / sum(n)::double, 6) as micro, round(sum(h) filter (where label in (0, 1, 4)) / sum(n) filter (where label in (0, 1, 4))::double, 6) as inside,
              round(sum(h) filter (where label not in (0, 1, 4)) / sum(n) filter (where label not in (0, 1, 4))::double, 6) as outside, round(avg(h / n::double), 6) as balanced from k""",
    "fpred",
)
def e1(spark, sf):
    return rounded(E.accuracy_summary(scored(spark, sf), [0, 1, 4]))


@query(
    "e2_subject_table",
    "select subject, count(*) as n, sum((pred = label)::int)::bigint as hits, round(avg((pred = label)::int), 6) as acc from fpred group by 1",
    "fpred",
)
def e2(spark, sf):
    f = fused(spark, sf).withColumn("pred", P.argmax("z", 9, C))
    return rounded(E.per_key_accuracy(f, ["subject"])).orderBy("acc", "subject")


_SUBJ = 'with s as (select subject, avg((pred = label)::int) as acc from fpred group by 1), r as (select *, row_number() over (order by acc, subject) as rk, count(*) over () as n from s)'


@query(
    "e2_subject_spread",
    f"""{_SUBJ} select count(*) as n_subjects, round(avg(acc), 6) as macro, round(stddev_pop(acc), 6) as sd, round(min(acc), 6) as worst, round(avg(acc) filter (where rk <= 3), 6) as worst_k,
        round(avg(acc) filter (where rk <= greatest(1, n // 4)), 6) as cvar25, round(quantile_cont(acc, 0.1), 6) as p10, round(avg(acc) - stddev_pop(acc), 6) as macro_minus_sd from r""",
    "fpred",
)
def e2b(spark, sf):
    return rounded(E.subject_spread(E.per_key_accuracy(scored(spark, sf), ["subject"]), "subject"))


@query(
    "e3_leave_one_subject_out",
    f"""{_SUBJ} select round(avg(acc), 6) as mean, round(stddev_samp(acc), 6) as sd, round(stddev_samp(acc) / sqrt(8), 6) as se_draw, round(avg(acc) filter (where rk <= ceil(n / 4.0)), 6) as lower_quartile,
        round(avg(acc) filter (where rk > n - ceil(n / 4.0)), 6) as upper_quartile, round(max(acc) - min(acc), 6) as spread from r""",
    "fpred",
)
def e3(spark, sf):
    return rounded(E.loso_summary(E.per_key_accuracy(scored(spark, sf), ["subject"]), "subject"))


_BOTH = "b as (select f.sample_id, f.subject, f.subject % 4 as fold, f.label, f.pred, m.pred as base, m.t0 from fpred f join mpred m using (sample_id) where m.member = 0)"


@query(
    "e4_paired_comparison",
    f"""with {_BOTH} select count(*) as n, count(*) filter (where base <> label and pred = label) as rescues, count(*) filter (where base = label and pred <> label) as harms,
        round(avg((pred = label)::int - (base = label)::int), 6) as delta, round(stddev_samp((pred = label)::int - (base = label)::int) / sqrt(count(*)), 6) as se from b""",
    "fpred mpred",
)
def e4(spark, sf):
    return rounded(E.paired_comparison(scored(spark, sf), "pred0", "pred"))


@query(
    "e5_fold_gate",
    f"""with {_BOTH}, d as (select fold, avg((pred = label)::int) - avg((base = label)::int) as d from b group by 1), g as (select count(*) as n_folds, avg(d) as mean, stddev_samp(d) / sqrt(count(*)) as se from d)
        select n_folds, round(mean, 6) as mean, round(se, 6) as se, round(mean / se, 4) as t, mean > 2 * se and mean > 0 as passed from g""",
    "fpred mpred",
)
def e5(spark, sf):
    d = E.fold_gate(scored(spark, sf).withColumn("fold", F.col("subject") % 4), "fold", "pred0", "pred")
    return rounded(d).withColumn("t", F.round("t", 4))


_PAT = """pt as (select string_agg(case when m.pred = m.label then '1' else '0' end, '' order by member) as pattern, any_value(f.pred = f.label)::int as ok
   from mpred m join fpred f using (sample_id) group by sample_id), pc as (select pattern, count(*) as n, sum(ok)::bigint as fused_hits from pt group by 1)"""


@query("e6_correctness_patterns", f"with {_PAT} select * from pc", "mpred fpred")
def e6(spark, sf):
    return E.correctness_patterns(scored(spark, sf), [f"pred{m}" for m in range(v.MEMBERS)], "pred")


@query(
    "e6_complementarity",
    f"""with {_PAT} select sum(case when pattern <> '0000' then n else 0 end)::bigint as any_right, sum(case when pattern = '0000' then n else 0 end)::bigint as all_wrong,
        sum(case when pattern = '1000' then n else 0 end)::bigint as only_0, sum(case when pattern = '0100' then n else 0 end)::bigint as only_1,
        sum(case when pattern = '0010' then n else 0 end)::bigint as only_2, sum(case when pattern = '0001' then n else 0 end)::bigint as only_3 from pc""",
    "mpred fpred",
)
def e6b(spark, sf):
    return E.complementarity(E.correctness_patterns(scored(spark, sf), [f"pred{m}" for m in range(v.MEMBERS)], "pred"), v.MEMBERS)


def _logits(spark, sf):
    return v.posteriors_wide(spark, sf).select("sample_id", "subject", "label", *[P.safe_log(f"p{m}", n=C).alias(f"l{m}") for m in range(v.MEMBERS)])


_SWEEP_TAIL = """lw as (select sample_id, cls, any_value(label) as label, any_value(subject) as subject, max(case when member = 0 then ln(greatest(p, 1e-12)) end) as l0, max(case when member = 1 then ln(greatest(p, 1e-12)) end) as l1,
     max(case when member = 2 then ln(greatest(p, 1e-12)) end) as l2, max(case when member = 3 then ln(greatest(p, 1e-12)) end) as l3 from post group by 1, 2),
  zz as (select sample_id, setting, cls, label, subject, w0 * l0 + w1 * l1 + w2 * l2 + w3 * l3 as z from lw, g),
  rr as (select *, row_number() over (partition by sample_id, setting order by round(z, 9) desc, cls) as rk from zz)"""

_SCALES = [0.5, 0.75, 1.0, 1.25, 1.5]


@query(
    "e7_member_ablation",
    f"""with g as (select * from (values (0, 0.4e0, 0.3e0, 0.2e0, 0.1e0), (1, 0e0, 0.3e0, 0.2e0, 0.1e0), (2, 0.4e0, 0e0, 0.2e0, 0.1e0), (3, 0.4e0, 0.3e0, 0e0, 0.1e0), (4, 0.4e0, 0.3e0, 0.2e0, 0e0)) t(setting, w0, w1, w2, w3)),
        {_SWEEP_TAIL}, h as (select setting, count(*) filter (where cls = label) as hits from rr where rk = 1 group by 1)
        select setting, hits, hits - (select hits from h where setting = 0) as delta from h""",
    "post",
)
def e7(spark, sf):
    base = [WEIGHTS[m] for m in range(v.MEMBERS)]
    grid = [base] + [[0.0 if i == m else w for i, w in enumerate(base)] for m in range(v.MEMBERS)]
    h = E.weight_sweep(_logits(spark, sf), [f"l{m}" for m in range(v.MEMBERS)], grid, "label", C)
    ref = h.filter("setting = 0").select("hits").scalar()
    return h.select("setting", "hits", (F.col("hits") - ref).alias("delta"))


@query(
    "e7_coefficient_sensitivity",
    f"""with sc as (select unnest([0.5, 0.75, 1.0, 1.25, 1.5])::double as s), g as (select (m * 5 + (s - 0.5) * 4)::int as setting, 0.4e0 * (case when m = 0 then s else 1 end) as w0, 0.3e0 * (case when m = 1 then s else 1 end) as w1,
          0.2e0 * (case when m = 2 then s else 1 end) as w2, 0.1e0 * (case when m = 3 then s else 1 end) as w3 from sc, (select unnest([0, 1, 2, 3]) as m)), {_SWEEP_TAIL}
        select setting, count(*) filter (where cls = label) as hits from rr where rk = 1 group by 1""",
    "post",
)
def e7b(spark, sf):
    base = [WEIGHTS[m] for m in range(v.MEMBERS)]
    grid = [[w * (s if i == m else 1.0) for i, w in enumerate(base)] for m in range(v.MEMBERS) for s in _SCALES]
    return E.weight_sweep(_logits(spark, sf), [f"l{m}" for m in range(v.MEMBERS)], grid, "label", C).select("setting", "hits")


_GRID = [list(w) for w in product((0.0, 0.25, 0.5, 0.75, 1.0), repeat=4) if abs(sum(w) - 1) < 1e-9 and w[0] > 0]


@query(
    "e8_weight_grid",
    f"""with x as (select unnest([0.0, 0.25, 0.5, 0.75, 1.0])::double as w), g0 as (select a.w as w0, b.w as w1, c.w as w2, d.w as w3 from x a, x b, x c, x d where a.w + b.w + c.w + d.w = 1 and a.w > 0),
        g as (select (row_number() over (order by w0, w1, w2, w3) - 1)::int as setting, * from g0), {_SWEEP_TAIL}
        select setting, count(*) as n, count(*) filter (where cls = label) as hits from rr where rk = 1 group by 1""",
    "post",
)
def e8(spark, sf):
    return E.weight_sweep(_logits(spark, sf), [f"l{m}" for m in range(v.MEMBERS)], _GRID, "label", C)


@query(
    "e9_nested_selection",
    f"""with x as (select unnest([0.0, 0.25, 0.5, 0.75, 1.0])::double as w), g0 as (select a.w as w0, b.w as w1, c.w as w2, d.w as w3 from x a, x b, x c, x d where a.w + b.w + c.w + d.w = 1 and a.w > 0),
        g as (select (row_number() over (order by w0, w1, w2, w3) - 1)::int as setting, * from g0), {_SWEEP_TAIL},
        h as (select subject % 4 as fold, setting, count(*) filter (where cls = label) as hits from rr where rk = 1 group by 1, 2),
        o as (select a.fold, b.setting, sum(b.hits)::bigint as score from (select distinct fold from h) a join h b on a.fold <> b.fold group by 1, 2)
        select fold, setting, score from (select *, row_number() over (partition by fold order by score desc, setting) as rk from o) where rk = 1""",
    "post",
)
def e9(spark, sf):
    d = _logits(spark, sf).withColumn("fold", F.col("subject") % 4)
    h = E.weight_sweep(d, [f"l{m}" for m in range(v.MEMBERS)], _GRID, "label", C, "fold")
    return E.nested_selection(h, "fold", ["setting"], "hits", {"setting": True})


@query(
    "e10_error_cells",
    """with c as (select subject, label, pred, count(*) as n from mpred where member = 2 and pred <> label group by 1, 2, 3),
            p as (select subject, least(label, pred) as a, greatest(label, pred) as b, sum(case when label < pred then n else 0 end) as ab, sum(case when label < pred then 0 else n end) as ba from c group by 1, 2, 3 having sum(n) >= 3)
       select count(*) as cells, count(*) filter (where n >= 3) as repeated, coalesce(sum(n) filter (where n >= 3), 0)::bigint as inside, sum(n)::bigint as errors,
              (select count(*) from p) as pairs, (select count(*) from p where least(ab, ba) = 0) as one_way from c""",
    "mpred",
)
def e10(spark, sf):
    d = scored(spark, sf).withColumn("pred", F.col("pred2"))
    out = E.error_cells(d)
    return out.select(*[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in out.columns])


@query(
    "e11_reference_availability",
    """with t as (select sample_id, subject, label, max(case when rk = 1 then cls end) as top1, max(case when rk = 2 then cls end) as top2 from fused group by 1, 2, 3),
            r as (select distinct subject, label as c from t where top1 = label), e as (select * from t where top1 <> label and top2 = label)
       select count(*) as rank2_errors, count(*) filter (where exists (select 1 from r where r.subject = e.subject and r.c = e.label)) as have_true,
              count(*) filter (where exists (select 1 from r where r.subject = e.subject and r.c = e.top1)) as have_wrong from e""",
    "fused",
)
def e11(spark, sf):
    r = P.ranked_classes(F.transform("z", lambda x: F.round(x, 9)))
    return E.reference_available(fused_wide(spark, sf).select("sample_id", "subject", "label", r[0].alias("top1"), r[1].alias("top2")))


@query("e12_confusion_matrix", "select label as truth, pred as guess, count(*) as n from fpred group by 1, 2", "fpred")
def e12(spark, sf):
    return E.confusion(scored(spark, sf))


@query(
    "e12_top_confused_pairs",
    "select least(label, pred) as a, greatest(label, pred) as b, count(*) as n from fpred where label <> pred group by 1, 2 order by n desc, a, b limit 6",
    "fpred",
)
def e12b(spark, sf):
    return E.symmetric_pairs(E.confusion(scored(spark, sf))).orderBy(F.desc("n"), "a", "b").limit(6)


@query(
    "e13_confusion_clusters",
    """with recursive pr as (select least(label, pred) as a, greatest(label, pred) as b, count(*) as n from mpred where member = 3 and label <> pred group by 1, 2 having count(*) >= 3),
         ed as (select *, row_number() over (order by n desc, a, b) as i from pr),
         step(i, home) as (select 0::bigint, [0, 1, 2, 3, 4]
           union all select step.i + 1, case when home[a + 1] = home[b + 1] or len(list_filter(home, lambda x: x = home[a + 1] or x = home[b + 1])) > 3 then home
              else list_transform(home, lambda x: case when x = home[b + 1] then home[a + 1] else x end) end from step join ed on ed.i = step.i + 1),
         fin as (select home from step order by i desc limit 1), h as (select c as cls, home[c + 1] as hm from fin, (select unnest([0, 1, 2, 3, 4]) as c))
       select cls, min(cls) over (partition by hm) as cluster from h qualify count(*) over (partition by hm) >= 2""",
    "mpred",
)
def e13(spark, sf):
    d = scored(spark, sf).withColumn("pred", F.col("pred3"))
    return E.confusion_clusters(E.confusion(d), 3, 1, 3)


@query(
    "e14_day_cohorts",
    """with recursive u as (select subject as g, day // 100 as d, count(*) as c from seq group by 1, 2), t as (select g, sum(c) as t from u group by 1),
            s as (select g, d from u join t using (g) where c >= 0.34 * t), e as (select distinct a.g as x, b.g as y from s a join s b using (d)),
            cc(x, y) as (select x, y from e union select cc.x, e.y from cc join e on cc.y = e.x)
       select x as node, min(y) as component from cc group by 1""",
    "seq",
)
def e14(spark, sf):
    rows = v.seq(spark, sf).select(F.col("subject").alias("g"), F.floor(F.col("day") / 100).alias("d"))
    return E.connected_components(E.cohort_edges(rows, "g", "d", 0.34), "a", "b")


@query(
    "e15_group_purity",
    """with c as (select day, label, count(*) as c from clips group by 1, 2), m as (select day, max(c) as m, sum(c) as n from c group by 1)
       select count(*) as n_groups, round(sum(m) / sum(n)::double, 6) as purity from m""",
    "clips",
)
def e15(spark, sf):
    return rounded(E.group_purity(v.clips(spark, sf), ["day"], "label"))


@query(
    "e16_nearest_centroid",
    """with c as (select label as k, d, avg(v) as m from vecdim group by 1, 2), dd as (select sample_id, any_value(label) as label, k, sqrt(sum((v - m) * (v - m))) as dist from vecdim join c using (d) group by sample_id, k),
            r as (select *, row_number() over (partition by sample_id order by round(dist, 9), k) as rk from dd)
       select label, count(*) as n, count(*) filter (where k = label) as hits, round(avg(dist), 6) as mean_dist from r where rk = 1 group by 1""",
    "vecdim",
)
def e16(spark, sf):
    d = v.vectors(spark, sf)
    return rounded(L.nearest_centroid(d, "label", "vec", v.EMB_DIM, v.EMB_CLASSES).groupBy("label").agg(
        F.count("*").alias("n"), F.sum((F.col("nearest") == F.col("label")).cast("long")).alias("hits"), F.avg("dist").alias("mean_dist")
    ))


@query(
    "e16_separability",
    """with c as (select label as k, d, avg(v) as m, stddev_pop(v) as s from vecdim group by 1, 2), w as (select avg(s) as within_sd from c),
            o as (select a.k, min(dist) as dist from (select a.k, b.k as k2, sqrt(sum((a.m - b.m) * (a.m - b.m))) as dist from c a join c b on a.d = b.d and a.k <> b.k group by 1, 2) a group by 1)
       select round((select within_sd from w), 6) as within_sd, round(quantile_cont(dist, 0.5), 6) as between_distance from o""",
    "vecdim",
)
def e16b(spark, sf):
    return rounded(L.separability(v.vectors(spark, sf), "label", "vec", v.EMB_DIM, v.EMB_CLASSES))


@query("e17_subject_clusters")
def e17(spark, sf):
    c = L.cluster_groups(v.vectors(spark, sf), "grp", "vec", v.EMB_DIM, 18)
    return rounded(E.group_purity(c.join(v.vectors(spark, sf).select("grp", "subject"), "grp"), ["cluster"], "subject"))


_WARD = """c as (select subject as k, d, avg(v) as m from vecdim group by 1, 2), p as (select a.k as a, b.k as b, sum(pow(a.m - b.m, 2)) as d from c a join c b on a.d = b.d and a.k <> b.k group by 1, 2),
  nn as (select a, arg_min(b, (d, b)) as b, min(d) as d from p group by 1)"""


@query("e17_ward_first_merges", f"with {_WARD} select x.a, x.b, round(x.d, 6) as height from nn x join nn y on x.b = y.a and y.b = x.a where x.a < x.b", "vecdim")
def e17_first(spark, sf):
    """Merges of single subjects: the reciprocal nearest neighbours of Ward's first round."""
    means = L.centroids(v.vectors(spark, sf), "subject", "vec", v.EMB_DIM)
    return rounded(WD.ward_merges(means, "subject", "centroid").filter("round = 1").select("a", "b", "height"))


@query("e17_ward_purity")
def e17_ward(spark, sf):
    """Purity of Ward's clusters of recordings by subject (no SQL: the tree is held against a brute-force version in tests)."""
    c = WD.ward_group_clusters(v.vectors(spark, sf), "subject", "vec", v.EMB_DIM, 6)
    return rounded(E.group_purity(c.join(v.vectors(spark, sf).select("subject", "label"), "subject"), ["cluster"], "label"))


@query(
    "e18_rank_auc",
    """with r as (select lang, quality, rank() over (partition by lang order by n_chars) + (count(*) over (partition by lang, n_chars) - 1) / 2.0 as rk from stexts)
       select lang, sum(quality)::bigint as n_pos, sum(1 - quality)::bigint as n_neg,
              round((sum(case when quality = 1 then rk end) - sum(quality) * (sum(quality) + 1) / 2.0) / nullif(sum(quality) * sum(1 - quality), 0)::double, 6) as auc from r group by 1""",
    "stexts",
)
def e18(spark, sf):
    return rounded(E.rank_auc(v.scored_texts(spark, sf), ["lang"], "n_chars", F.col("quality") == 1))


@query("e18_grouped_auc_controls")
def e18b(spark, sf):
    return L.grouped_auc(v.scored_texts(spark, sf))


@query(
    "e19_correlation",
    """with s as (select subject, avg(conf) as est, avg((pred = label)::int) as acc from mpred where member = 1 group by 1), e as (select round(est, 9) as est, round(acc, 9) as acc from s),
            r as (select est, acc, rank() over (order by est) + (count(*) over (partition by est) - 1) / 2.0 as re, rank() over (order by acc) + (count(*) over (partition by acc) - 1) / 2.0 as ra from e)
       select round(corr(est, acc), 5) as pearson, round(corr(re, ra), 5) as spearman, round(avg(abs(est - acc)), 5) as mae from r""",
    "mpred",
)
def e19(spark, sf):
    d = v.posteriors_wide(spark, sf).groupBy("subject").agg(
        F.round(F.avg(P.confidence("p1", C)), 9).alias("est"), F.round(F.avg((P.argmax("p1", 9, C) == F.col("label")).cast("double")), 9).alias("acc")
    )
    out = E.correlation_report(d, "est", "acc", "subject")
    return out.select(*[F.round(c, 5).alias(c) for c in out.columns])


@query(
    "e20_row_diff",
    f"""with {_BOTH} select count(*) filter (where base <> pred) as changed, count(*) filter (where base <> pred and pred in (0, 1, 4) and base not in (0, 1, 4)) as into,
        count(*) filter (where base <> pred and base in (0, 1, 4) and pred not in (0, 1, 4)) as out_of, count(*) filter (where pred in (0, 1, 4)) as in_set from b""".replace("as into", 'as "into"'),
    "fpred mpred",
)
def e20(spark, sf):
    s = scored(spark, sf)
    return E.row_diff(s.select("sample_id", F.col("pred0").alias("pred")), s.select("sample_id", "pred"), "sample_id", "pred", [0, 1, 4])


@query(
    "e21_run_comparison",
    """with d as (select a.sample_id, a.cls, abs(a.p - b.p) as d, a.p * b.p as ab, a.p * a.p as aa, b.p * b.p as bb from post a join post b using (sample_id, cls) where a.member = 0 and b.member = 1),
            r as (select sample_id, max(d) as mx, sum(d) as s, sum(ab) / (sqrt(sum(aa)) * sqrt(sum(bb))) as cs from d group by 1),
            f as (select count(*) as flips from mpred a join mpred b using (sample_id) where a.member = 0 and b.member = 1 and a.pred <> b.pred)
       select count(*) as n, round(max(mx), 6) as max_abs, round(sum(s) / (count(*) * 5), 6) as mean_abs, (select flips from f) as flips, round(avg(cs), 6) as mean_cosine from r""",
    "post mpred",
)
def e21(spark, sf):
    w = v.posteriors_wide(spark, sf)
    return rounded(E.compare_scores(w.select("sample_id", F.col("p0").alias("p")), w.select("sample_id", F.col("p1").alias("p")), "sample_id", "p", C))


@query(
    "e22_agreement",
    """select round(avg((a.pred = b.pred)::int), 6) as agree, round(avg(case when a.pred in (0, 1, 4) then (a.pred = b.pred)::int end), 6) as agree_in_set
       from mpred a join mpred b using (sample_id) where a.member = 0 and b.member = 2""",
    "mpred",
)
def e22(spark, sf):
    same = (F.col("pred0") == F.col("pred2")).cast("double")
    return rounded(scored(spark, sf).agg(F.avg(same).alias("agree"), F.avg(F.when(F.col("pred0").isin([0, 1, 4]), same)).alias("agree_in_set")))


@query(
    "e23_temperature_weight_equivalence",
    """with s as (select p_partkey, p_size / 100.0::double as w, 1 + p_partkey % 3 as tb, 1 + p_partkey % 4 as tv, p_partkey % 5 / 10.0::double as lam from part)
       select p_partkey, round((w / tv) / ((1 - w) / tb + w / tv), 6) as w_equiv, round(lam / ((1 - w) / tb + w / tv), 6) as lam_equiv from s""",
)
def e23(spark, sf):
    k = F.col("p_partkey")
    s = v.table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 100.0).alias("w"), (1 + k % 3).alias("tb"), (1 + k % 4).alias("tv"), (k % 5 / 10.0).alias("lam"))
    a, b = (1 - F.col("w")) / F.col("tb"), F.col("w") / F.col("tv")
    return s.select("p_partkey", R6(b / (a + b)).alias("w_equiv"), R6(F.col("lam") / (a + b)).alias("lam_equiv"))


@query(
    "e24_top2_decidable",
    """with t as (select sample_id, label, max(case when rk = 1 then cls end) as a, max(case when rk = 2 then cls end) as b from fused group by 1, 2),
            d as (select t.*, case when m.pred in (a, b) then m.pred else a end as pick from t join mpred m using (sample_id) where m.member = 0 and t.label in (a, b))
       select count(*) as decidable, round(avg((a = label)::int), 6) as base_rate, count(*) filter (where pick <> a) as flips, count(*) filter (where pick <> a and pick = label) as flips_right,
              count(*) filter (where pick <> a and a = label) as flips_wrong from d""",
    "fused mpred",
)
def e24(spark, sf):
    r = P.ranked_classes(F.transform("z", lambda x: F.round(x, 9)))
    t = fused_wide(spark, sf).select("label", r[0].alias("a"), r[1].alias("b"), P.argmax("p0", 9, C).alias("m"))
    lab, a, b = F.col("label"), F.col("a"), F.col("b")
    d = t.filter((lab == a) | (lab == b)).withColumn("pick", F.when((F.col("m") == a) | (F.col("m") == b), F.col("m")).otherwise(a))
    flip = F.col("pick") != a
    n = lambda c: F.sum(c.cast("long"))
    return rounded(d.agg(F.count("*").alias("decidable"), F.avg((a == lab).cast("double")).alias("base_rate"), n(flip).alias("flips"),
                         n(flip & (F.col("pick") == lab)).alias("flips_right"), n(flip & (a == lab)).alias("flips_wrong")))


@query(
    "e25_lineage_gate",
    f"""with {_BOTH} select 'full' as scenario, true as available, null::varchar as reason, 1.0::double as coverage, round(avg((pred = label)::int) - avg((base = label)::int), 6) as delta, avg((pred = label)::int) - avg((base = label)::int) >= 0.005 as passed from b
        union all select 'partial', false, 'ids differ', 1 - (count(*) filter (where sample_id % 10 = 0)) / count(*)::double, round(avg((pred = label)::int) filter (where sample_id % 10 <> 0) - avg((base = label)::int) filter (where sample_id % 10 <> 0), 6), false from b
        union all select 'other_partition', false, 'lineage differs', 1.0, round(avg((pred = label)::int) - avg((base = label)::int), 6), false from b""",
    "fpred mpred",
)
def e25(spark, sf):
    s = scored(spark, sf)
    base = s.select("sample_id", "label", F.col("pred0").alias("pred"))
    cand = s.select("sample_id", "label", "pred")
    cases = {"full": (base, "p1"), "partial": (base.filter("sample_id % 10 <> 0"), "p1"), "other_partition": (base, "p2")}
    out = None
    for name, (b, tag) in cases.items():
        g = E.lineage_gate(b, cand, "sample_id", 1.0, 0.005, tag, "p1").select(F.lit(name).alias("scenario"), "available", "reason", "coverage", R6("delta").alias("delta"), "passed")
        out = g if out is None else out.unionByName(g)
    return out


@query(
    "e26_vector_fidelity",
    """with s as (select sample_id, vec, greatest(list_max([abs(x) for x in vec]), 1e-12) / 7e0 as sc from vectors),
            q as (select sample_id, vec, [greatest(least(round_even(x / sc, 0), 7), -8) * sc for x in vec] as r from s)
       select count(*) as n, round(max(list_max([abs(vec[i] - r[i]) for i in range(1, 65)])), 6) as max_abs, round(sum(list_sum([abs(vec[i] - r[i]) for i in range(1, 65)])) / (count(*) * 64), 6) as mean_abs,
              count(*) filter (where list_position([round(x, 9) for x in vec], list_max([round(x, 9) for x in vec])) <> list_position([round(x, 9) for x in r], list_max([round(x, 9) for x in r]))) as flips,
              round(avg(list_sum([vec[i] * r[i] for i in range(1, 65)]) / (sqrt(list_sum([x * x for x in vec])) * sqrt(list_sum([x * x for x in r])))), 6) as mean_cosine from q""",
    "vectors",
)
def e26(spark, sf):
    d = v.vectors(spark, sf)
    a = d.select("sample_id", F.col("vec").alias("p"))
    b = d.withColumns(V.quantise("vec", 4)).select("sample_id", F.col("restored").alias("p"))
    return rounded(E.compare_scores(a, b, "sample_id", "p", v.EMB_DIM))
