"""Sequence operators (Q1-Q15)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strideline.functions import posterior as P
from strideline.functions import vectors as V
from strideline.functions.tables import register
from strideline.operators import nested as N
from strideline.operators import sequence as S
from strideline.operators import structure as ST
from strideline.operators.scan import ordered_scan, segment_unless_small
from strideline.plans import views as v
from strideline.plans.evaluate import rounded
from strideline.plans.registry import REGISTRY, query
from strideline.plans.timeseries import recordings
from strideline.session import cut_lineage

C = v.N_CLASSES
R6 = lambda c: F.round(c, 6)
AMB = "amb as (select subject from seq group by 1 having count(*) > count(distinct t0))"
_SRC = f"{AMB}, src as (select * from seq where subject not in (select subject from amb))"
_EDGES = f"""{_SRC}, e as (select *, lead(label) over w as nx, row_number() over w as rn from src window w as (partition by subject order by t0, sample_id)),
  tc as (select 'unit' as kind, label as prev, null::int as next, count(*) as n from e group by 2 union all select 'edge', label, nx, count(*) from e where nx is not null group by 2, 3
         union all select 'start', label, null, count(*) from e where rn = 1 group by 2)"""


def source(spark, sf, seg="year"):
    return S.ordered_rows(v.seq(spark, sf), "subject", "t0", "sample_id", seg)


def _segment(spark, sf):
    return segment_unless_small(v.seq(spark, sf), ["subject"], "year")


def counts(spark, sf, by=()):
    seg = _segment(spark, sf)
    rows = source(spark, sf, seg)
    if "fold" in by:
        rows = rows.withColumn("fold", (F.col("subject") % 4).cast("int"))
    return S.transition_counts(rows, "subject", ["t0", "sample_id"], "label", seg, by)


@query("q1_transition_counts", f"with {_EDGES} select * from tc", "seq")
def q1(spark, sf):
    return counts(spark, sf)


@query(
    "q1_dialog_transitions",
    """with e as (select *, lead(label) over w as nx, row_number() over w as rn from dialogs window w as (partition by grp order by turn))
       select 'unit' as kind, label as prev, null::int as next, count(*) as n from e group by 2 union all select 'edge', label, nx, count(*) from e where nx is not null group by 2, 3 union all select 'start', label, null, count(*) from e where rn = 1 group by 2""",
    "dialogs",
)
def q1b(spark, sf):
    d = v.dialogs(spark, sf).withColumn("seg", F.floor(F.col("turn") / 4096))
    return S.transition_counts(d, "grp", ["turn"], "label", "seg")


def _scores_sql(prior: str, score: str) -> str:
    return f"""with {_EDGES}, cl as (select unnest([0, 1, 2, 3, 4]) as c), un as (select c, coalesce(sum(n), 0) as u from cl left join tc on kind = 'unit' and prev = c group by 1),
      pr as (select c, {prior} as q from un), g as (select a.c as prev, b.c as next from cl a, cl b union all select -1, c from cl),
      j as (select g.prev, g.next, coalesce(tc.n, 0) as n, q from g join pr on pr.c = g.next left join tc on (g.prev >= 0 and kind = 'edge' and tc.prev = g.prev and tc.next = g.next) or (g.prev < 0 and kind = 'start' and tc.prev = g.next)),
      p as (select prev, next, n, q, (n + 5 * q) / (sum(n) over (partition by prev) + 5) as p from j)
      select prev, next, n, round(p, 6) as p, round({score}, 6) as score from p"""


@query("q2_conditional_scores", _scores_sql("(u + 1) / (sum(u) over () + 5)::double", "ln(p)"), "seq")
def q2(spark, sf):
    return rounded(S.transition_scores(counts(spark, sf), C, backoff="unigram")).withColumn("n", F.col("n").cast("long"))


@query("q2_pmi_scores_clipped", _scores_sql("0.2e0", "greatest(least(ln(p) - ln(q), 0.1), -0.1)"), "seq")
def q2b(spark, sf):
    return rounded(S.transition_scores(counts(spark, sf), C, backoff="uniform", mode="pmi", clip=0.1)).withColumn("n", F.col("n").cast("long"))


@query(
    "q3_control_reverse_source",
    f"with {_SRC}, e as (select label, lead(label) over (partition by subject order by t0 desc, sample_id desc) as nx from src) select label as prev, nx as next, count(*) as n from e where nx is not null group by 1, 2",
    "seq",
)
def q3(spark, sf):
    d, order, seg = S.controlled_order(source(spark, sf), "reverse", "t0", "sample_id", "year")
    return S.transition_counts(d, "subject", order, "label", seg).filter("kind = 'edge'").select("prev", "next", "n")


@query(
    "q3_control_shuffle_source",
    f"with {_SRC}, e as (select label, lead(label) over (partition by subject order by sha256('7:' || sample_id), sample_id) as nx from src) select label as prev, nx as next, count(*) as n from e where nx is not null group by 1, 2",
    "seq",
)
def q3b(spark, sf):
    d, order, seg = S.controlled_order(source(spark, sf), "shuffle", "t0", "sample_id", "year", 7)
    return S.transition_counts(d, "subject", order, "label", seg).filter("kind = 'edge'").select("prev", "next", "n")


@query(
    "q3_control_label_permute",
    f"""with {_EDGES}, pm as (select c, row_number() over (order by sha256('7:' || c)) - 1 as i from (select unnest([0, 1, 2, 3, 4]) as c)),
        iv as (select c as old, i as new from pm) select a.new::int as prev, b.new::int as next, n from tc join iv a on a.old = tc.prev join iv b on b.old = tc.next where kind = 'edge'""",
    "seq",
)
def q3c(spark, sf):
    perm = S.permuted_labels(C, 7)
    place = F.array(*[F.lit(perm.index(c)) for c in range(C)])
    return counts(spark, sf).filter("kind = 'edge'").select(place[F.col("prev")].alias("prev"), place[F.col("next")].alias("next"), "n")


_CONTROLS = ["none", "uniform", "reverse-source", "shuffle-source", "label-permute", "reverse-target", "shuffle-target"]


@query(
    "q3_control_accuracy",
    f"""with recursive {_SRC}, so as (select 'none' as ctl union all select unnest(['reverse-source', 'shuffle-source'])),
      sr as (select ctl, subject, label, case ctl when 'none' then row_number() over (partition by ctl, subject order by t0, sample_id) when 'reverse-source' then row_number() over (partition by ctl, subject order by t0 desc, sample_id desc)
         else row_number() over (partition by ctl, subject order by sha256('7:' || sample_id), sample_id) end as ord from src cross join so),
      e as (select ctl, label, lead(label) over (partition by ctl, subject order by ord) as nx from sr),
      cl as (select unnest([0, 1, 2, 3, 4]) as c), un as (select c, (select count(*) from src where label = c) as u from cl), pr as (select c, (u + 1) / (sum(u) over () + 5)::double as q from un),
      tc as (select ctl, label as prev, nx as next, count(*) as n from e where nx is not null group by all),
      ts as (select so.ctl, a.c as prev, b.c as next, ln((coalesce(n, 0) + 5 * q) / (sum(coalesce(n, 0)) over (partition by so.ctl, a.c) + 5)) as s from so cross join cl a cross join cl b join pr on pr.c = b.c left join tc on tc.ctl = so.ctl and tc.prev = a.c and tc.next = b.c),
      pm as (select c, row_number() over (order by sha256('7:' || c)) - 1 as i from cl),
      tr as (select * from ts union all select 'uniform', prev, next, 0 from ts where ctl = 'none' union all select 'label-permute', a.i, b.i, s from ts join pm a on a.c = prev join pm b on b.c = next where ctl = 'none'
             union all select unnest(['reverse-target', 'shuffle-target']), prev, next, s from ts where ctl = 'none'),
      ct as (select distinct ctl from tr),
      ro as (select ctl, sample_id, subject, label, count(*) over (partition by ctl, subject) as n, case ctl when 'reverse-target' then row_number() over (partition by ctl, subject order by t0 desc, sample_id desc)
         when 'shuffle-target' then row_number() over (partition by ctl, subject order by sha256('7:' || sample_id), sample_id) else row_number() over (partition by ctl, subject order by t0, sample_id) end as pos from seq cross join ct),
      em as (select ro.*, cls, ln(greatest(p, 1e-12)) as e from ro join post using (sample_id) where member = 0),
      vt(ctl, subject, pos, n, cls, score, path) as (
        select ctl, em.subject, pos, n, cls, e, [cls] from em where pos = 1
        union all
        select em.ctl, em.subject, em.pos, em.n, em.cls, max_by(vt.score + 0.5 * tr.s, (round(vt.score + 0.5 * tr.s, 9), -tr.prev)) + any_value(e), list_append(max_by(vt.path, (round(vt.score + 0.5 * tr.s, 9), -tr.prev)), em.cls)
        from vt join em on em.ctl = vt.ctl and em.subject = vt.subject and em.pos = vt.pos + 1 join tr on tr.ctl = em.ctl and tr.prev = vt.cls and tr.next = em.cls group by em.ctl, em.subject, em.pos, em.n, em.cls),
      fin as (select ctl, subject, max_by(path, (round(score, 9), -cls)) as path from vt where pos = n group by 1, 2)
      select ctl as control, count(*) filter (where path[pos] = label) as hits, count(*) as n from ro join fin using (ctl, subject) group by 1""",
    "seq post",
)
def q3_accuracy(spark, sf):
    """Right labels under every negative control: of the model, of its source order, or of the decoded order."""
    whole = _segment(spark, sf)
    rows = source(spark, sf, whole)

    def model(control):
        d, order, seg = S.controlled_order(rows, control, "t0", "sample_id", whole, 7)
        return S.model_arrays(S.transition_scores(S.transition_counts(d, "subject", order, "label", seg), C, backoff="unigram"), C)

    start, trans = model("none")
    perm = S.permuted_labels(C, 7)
    models = [(start, trans), (start * 0, trans * 0), model("reverse"), model("shuffle"), (start[perm], trans[perm][:, perm])]
    targets, found = _targets(spark, sf), []
    for order_of, names, some in (("none", _CONTROLS[:5], models), ("reverse", _CONTROLS[5:6], models[:1]), ("shuffle", _CONTROLS[6:], models[:1])):
        d, order, seg = S.controlled_order(targets, order_of, "t0", "sample_id", "year", 7)
        hits = N.decode_hits(d, "subject", order, "sample_id", "probs", "label", seg, [N.Setting(None, *m, 0.5) for m in some])
        found.append(hits.select(F.array(*map(F.lit, names))[F.col("setting")].alias("control"), "hits", "n"))
    return found[0].unionByName(found[1]).unionByName(found[2])


def _targets(spark, sf):
    w = v.posteriors_wide(spark, sf).select("subject", "sample_id", "label", "t0", "year", F.col("p0").alias("probs"))
    return w


def _packed(rows, chunk=S.CHUNK, order=("t0", "sample_id"), group="subject", seg="year"):
    """Packed recordings, written once: decoding reads them several times."""
    return cut_lineage(S.pack_sequences(rows, group, list(order), "sample_id", "probs", seg, chunk))


def _model(spark, sf, **kw):
    return S.model_arrays(S.transition_scores(counts(spark, sf), C, **kw), C)


_MODEL_SQL = f"""{_EDGES}, cl as (select unnest([0, 1, 2, 3, 4]) as c), un as (select c, coalesce(sum(n), 0) as u from cl left join tc on kind = 'unit' and prev = c group by 1),
  pr as (select c, (u + 1) / (sum(u) over () + 5)::double as q from un), tr as (select a.c as prev, b.c as next, ln((coalesce(n, 0) + 5 * q) / (sum(coalesce(n, 0)) over (partition by a.c) + 5)) as s
     from cl a cross join cl b join pr on pr.c = b.c left join tc on kind = 'edge' and tc.prev = a.c and tc.next = b.c),
  ro as (select sample_id, subject, row_number() over (partition by subject order by t0, sample_id) as pos, count(*) over (partition by subject) as n from seq),
  em as (select ro.*, cls, ln(greatest(p, 1e-12)) as e from ro join post using (sample_id) where member = 0)"""

# the same model, targets grouped by (subject, year)
_MODEL_BY_YEAR = _MODEL_SQL[: _MODEL_SQL.index("ro as (")] + """ro as (select sample_id, subject * 100 + year as grp, row_number() over (partition by subject, year order by t0, sample_id) as pos,
     count(*) over (partition by subject, year) as n from seq),
  em as (select ro.*, cls, ln(greatest(p, 1e-12)) as e from ro join post using (sample_id) where member = 0)"""


@query(
    "q4_viterbi",
    f"""with recursive {_MODEL_SQL}, vt(subject, pos, n, cls, score, path) as (
          select em.subject, pos, n, cls, e, [cls] from em where pos = 1
          union all
          select em.subject, em.pos, em.n, em.cls, max_by(vt.score + tr.s, (round(vt.score + tr.s, 9), -tr.prev)) + any_value(e), list_append(max_by(vt.path, (round(vt.score + tr.s, 9), -tr.prev)), em.cls)
          from vt join em on em.subject = vt.subject and em.pos = vt.pos + 1 join tr on tr.prev = vt.cls and tr.next = em.cls group by em.subject, em.pos, em.n, em.cls),
        fin as (select subject, max_by(path, (round(score, 9), -cls)) as path from vt where pos = n group by 1)
        select sample_id, path[pos] as decoded from ro join fin using (subject)""",
    "seq post",
)
def q4(spark, sf):
    start, trans = _model(spark, sf, backoff="unigram")
    return S.viterbi_decode(_packed(_targets(spark, sf)), "subject", "sample_id", start, trans, 1.0).select("sample_id", "decoded")


@query("x5_viterbi_udtf", REGISTRY["q4_viterbi"].sql)
def x5(spark, sf):
    """The same decode by SQL: a table function over a partitioned, ordered table."""
    register(spark)
    _, trans = _model(spark, sf, backoff="unigram")
    # many recordings share a partition and are decoded together
    spread = F.lit(4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    targets = _targets(spark, sf).select(F.pmod(F.xxhash64("subject"), spread).alias("bucket"), "subject", "t0", "sample_id", "probs")
    scores = ", ".join(f"{x!r}D" for x in trans.ravel().tolist())
    text = f"select * from viterbi_decode(table(select * from {{targets}}) partition by bucket order by (subject, t0, sample_id), 'sample_id', 'probs', array({scores}), 1.0D, 'subject')"
    return spark.sql(text, targets=targets)


@query("q4_viterbi_invariants", "select 'zero_weight_is_argmax' as rule, 0::bigint as n union all select 'uniform_is_argmax', 0 union all select 'split_equals_whole', 0")
def q4b(spark, sf):
    start, trans = _model(spark, sf, backoff="unigram")
    t = _targets(spark, sf)
    base = t.select("sample_id", P.argmax("probs", 9).alias("base"))

    def differs(decoded, other, col, rule):
        j = decoded.join(other, "sample_id")
        return j.agg(F.sum((F.col("decoded") != F.col(col)).cast("long")).alias("n")).select(F.lit(rule).alias("rule"), "n")

    packed = _packed(t)
    zero = S.viterbi_decode(packed, "subject", "sample_id", start, trans, 0.0)
    flat = S.viterbi_decode(packed, "subject", "sample_id", start * 0, trans * 0 + np.log(0.2), 1.0)
    whole = S.viterbi_decode(packed, "subject", "sample_id", start, trans, 1.0).select("sample_id", F.col("decoded").alias("other"))
    parts = S.viterbi_decode(_packed(t, 4), "subject", "sample_id", start, trans, 1.0, chunk=4)
    return differs(zero, base, "base", "zero_weight_is_argmax").unionByName(differs(flat, base, "base", "uniform_is_argmax")).unionByName(differs(parts, whole, "other", "split_equals_whole"))


@query(
    "q5_beam_soft_distinct",
    f"""with recursive {_MODEL_BY_YEAR},
        bm(grp, pos, n, last, used, score, path) as (
          select grp, pos, n, cls, 1 << cls, e, chr(97 + cls) from em where pos = 1
          union all
          select em.grp, em.pos, em.n, em.cls, used | (1 << em.cls), bm.score + e + 0.5 * tr.s - case when (used & (1 << em.cls)) <> 0 then 2.0 else 0 end, path || chr(97 + em.cls)
          from bm join em on em.grp = bm.grp and em.pos = bm.pos + 1 join tr on tr.prev = bm.last and tr.next = em.cls
          qualify row_number() over (partition by em.grp order by round(bm.score + e + 0.5 * tr.s - case when (used & (1 << em.cls)) <> 0 then 2.0 else 0 end, 9) desc, path || chr(97 + em.cls)) <= 256),
        fin as (select grp, path from bm where pos = n qualify row_number() over (partition by grp order by round(score, 9) desc, path) = 1)
        select sample_id, (ascii(substr(path, pos::int, 1)) - 97)::int as decoded from ro join fin using (grp)""",
    "seq post",
)
def q5(spark, sf):
    start, trans = _model(spark, sf, backoff="unigram")
    t = _targets(spark, sf).withColumn("grp", F.col("subject") * 100 + F.col("year"))
    return S.beam_decode(_packed(t, group="grp"), "grp", "sample_id", start, trans, 0.5, beam=256, penalty=2.0).select("sample_id", "decoded")


@query("q5_beam_invariants", "select 'no_penalty_is_viterbi' as rule, 0::bigint as n union all select 'hard_repeats', 0 union all select 'split_equals_whole', 0")
def q5b(spark, sf):
    start, trans = _model(spark, sf, backoff="unigram")
    t = _targets(spark, sf).withColumn("grp", F.col("subject") * 100 + F.col("year"))
    packed = _packed(t, group="grp")
    vit = S.viterbi_decode(packed, "grp", "sample_id", start, trans, 0.5).select("sample_id", F.col("decoded").alias("other"))

    def differs(a, b, rule):
        return a.join(b, "sample_id").agg(F.sum((F.col("decoded") != F.col("other")).cast("long")).alias("n")).select(F.lit(rule).alias("rule"), "n")

    free = S.beam_decode(packed, "grp", "sample_id", start, trans, 0.5, penalty=0.0)
    hard = S.beam_decode(packed.filter(F.col("n") <= C), "grp", "sample_id", start, trans, 0.5, distinctness="hard")
    again = hard.groupBy("grp").agg((F.count("*") - F.count_distinct("decoded")).alias("r")).agg(F.sum("r").alias("n")).select(F.lit("hard_repeats").alias("rule"), "n")
    whole = S.beam_decode(packed, "grp", "sample_id", start, trans, 0.5).select("sample_id", F.col("decoded").alias("other"))
    parts = S.beam_decode(_packed(t, 2, group="grp"), "grp", "sample_id", start, trans, 0.5, chunk=2)
    return differs(free, vit, "no_penalty_is_viterbi").unionByName(again).unionByName(differs(parts, whole, "split_equals_whole"))


@query(
    "q6_decode_all_groups",
    f"""with {AMB}, g as (select subject, count(*) as n, subject in (select subject from amb) as skip from seq group by 1)
        select skip as skipped, count(*) as n_groups, count(*) filter (where n > 1) as multi_groups, sum(n)::bigint as n_clips from g group by 1""",
    "seq",
)
def q6(spark, sf):
    start, trans = _model(spark, sf, backoff="unigram")
    t = _targets(spark, sf)
    known = S.ordered_rows(t, "subject", "t0", "sample_id", "year")
    out = S.decode_with_fallback(t, S.viterbi_decode(_packed(known), "subject", "sample_id", start, trans, 0.5), "subject", "sample_id", "probs")
    g = out.groupBy("subject").agg(F.count("*").alias("n"), F.max("skipped").alias("skipped"))
    return g.groupBy("skipped").agg(F.count("*").alias("n_groups"), F.sum((F.col("n") > 1).cast("long")).alias("multi_groups"), F.sum("n").alias("n_clips"))


_OOF_MODEL = f"""{_SRC}, hf as (select unnest([0, 1, 2, 3]) as held), e as (select *, lead(label) over w as nx from src window w as (partition by subject order by t0, sample_id)),
  tc as (select held, 'unit' as kind, label as prev, null::int as next, count(*) as n from e join hf on subject % 4 <> held group by 1, 3 union all select held, 'edge', label, nx, count(*) from e join hf on subject % 4 <> held where nx is not null group by 1, 3, 4),
  cl as (select unnest([0, 1, 2, 3, 4]) as c), un as (select hf.held, c, coalesce(sum(n), 0) as u from hf cross join cl left join tc on tc.held = hf.held and kind = 'unit' and prev = c group by 1, 2),
  pr as (select held, c, (u + 1) / (sum(u) over (partition by held) + 5)::double as q from un),
  tr as (select pr.held, a.c as prev, b.c as next, ln((coalesce(n, 0) + 5 * q) / (sum(coalesce(n, 0)) over (partition by pr.held, a.c) + 5)) as s
     from cl a cross join cl b join pr on pr.c = b.c left join tc on tc.held = pr.held and kind = 'edge' and tc.prev = a.c and tc.next = b.c),
  ro as (select sample_id, subject, label, subject % 4 as held, row_number() over (partition by subject order by t0, sample_id) as pos, count(*) over (partition by subject) as n from seq),
  em as (select ro.*, cls, ln(greatest(p, 1e-12)) as e from ro join post using (sample_id) where member = 0),
  vt(held, subject, pos, n, cls, score, path) as (
          select em.held, em.subject, pos, n, cls, e, [cls] from em where pos = 1
          union all
          select em.held, em.subject, em.pos, em.n, em.cls, max_by(vt.score + 0.5 * tr.s, (round(vt.score + 0.5 * tr.s, 9), -tr.prev)) + any_value(e), list_append(max_by(vt.path, (round(vt.score + 0.5 * tr.s, 9), -tr.prev)), em.cls)
          from vt join em on em.subject = vt.subject and em.pos = vt.pos + 1 join tr on tr.held = em.held and tr.prev = vt.cls and tr.next = em.cls group by em.held, em.subject, em.pos, em.n, em.cls),
  fin as (select subject, max_by(path, (round(score, 9), -cls)) as path from vt where pos = n group by 1),
  dec as (select ro.sample_id, ro.held, ro.label, path[pos] as decoded, m.pred as base from ro join fin using (subject) join mpred m on m.sample_id = ro.sample_id and m.member = 0)"""


def _oof_decoded(spark, sf):
    """Every recording decoded with the transitions of the other folds' subjects: counted once per fold, the model of a
    fold is the total without it."""
    per = counts(spark, sf, ["fold"])
    targets, decoded = _targets(spark, sf), None
    for k in range(4):
        rest = per.filter(F.col("fold") != k).groupBy("kind", "prev", "next").agg(F.sum("n").alias("n"))
        start, trans = S.model_arrays(S.transition_scores(rest, C, backoff="unigram"), C)
        part = S.viterbi_decode(_packed(targets.filter(F.col("subject") % 4 == k)), "subject", "sample_id", start, trans, 0.5)
        decoded = part if decoded is None else decoded.unionByName(part)
    return targets.select("sample_id", (F.col("subject") % 4).cast("int").alias("fold"), "label", P.argmax("probs", 9).alias("base")).join(decoded, "sample_id")


@query(
    "q6_oof_decode",
    f"""with recursive {_OOF_MODEL} select held as fold, count(*) as n, count(*) filter (where base <> label and decoded = label) as rescues,
        count(*) filter (where base = label and decoded <> label) as harms, count(*) filter (where base <> decoded) as changed from dec group by 1""",
    "seq post mpred",
)
def q6_oof(spark, sf):
    d = _oof_decoded(spark, sf)
    was, now = F.col("base") == F.col("label"), F.col("decoded") == F.col("label")
    count = lambda c: F.sum(c.cast("long"))
    return d.groupBy("fold").agg(F.count("*").alias("n"), count(~was & now).alias("rescues"), count(was & ~now).alias("harms"), count(F.col("base") != F.col("decoded")).alias("changed"))


_SEQS = """sq as (select subject % 4 as fold, subject * 100 + year as grp, count(*) as n, string_agg(label, ',' order by t0, sample_id) as labels from seq group by subject, year)"""


def _sequences(spark, sf):
    return S.label_sequences(recordings(spark, sf).withColumn("fold", F.col("subject") % 4), "grp", ["t0", "sample_id"], "label", ["fold"])


@query("q7_template_catalog", f"with {_SEQS} select n, labels, count(*) as freq from sq where fold <> 0 group by 1, 2", "seq")
def q7(spark, sf):
    c = S.template_catalog(_sequences(spark, sf).filter("fold <> 0"))
    return c.select("n", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"), "freq")


_PROPOSE = f"""{_SEQS}, ct as (select held, n, labels, count(*) as freq from sq join (values (0), (1), (2), (3)) h(held) on fold <> held group by 1, 2, 3), tp as (select *, row_number() over (order by held, n, labels) as tid from ct),
  te as (select held, tid, n, freq, labels, unnest(range(1, n + 1)) as pos, unnest(string_split(labels, ','))::int as cls from tp),
  rp as (select sample_id, subject * 100 + year as grp, row_number() over (partition by subject, year order by t0, sample_id) as pos, count(*) over (partition by subject, year) as n, subject % 4 as held from seq),
  lp as (select rp.*, cls, ln(greatest(p, 1e-12)) as l, max(ln(greatest(p, 1e-12))) over (partition by sample_id) as lm from rp join post using (sample_id) where member = 0),
  sc as (select grp, lp.n, tid, any_value(te.freq) as freq, any_value(labels) as labels, sum(l) as em, sum(lm) as alone from lp join te on te.held = lp.held and te.n = lp.n and te.pos = lp.pos and te.cls = lp.cls group by grp, lp.n, tid),
  rk as (select *, row_number() over w as r, round(em + 0.5 * ln(freq), 9) as s, lead(round(em + 0.5 * ln(freq), 9)) over w as s2 from sc window w as (partition by grp order by round(em + 0.5 * ln(freq), 9) desc, labels)),
  pp as (select grp, n, labels, freq, greatest((alone - em) / n, 0) as loss, coalesce((s - s2) / n, 'inf'::double) as margin from rk where r = 1)"""


def _proposals(spark, sf):
    """Proposals for all recordings, each from the recordings of the subjects of other folds."""
    t = _targets(spark, sf).withColumn("grp", F.col("subject") * 100 + F.col("year"))
    packed = _packed(t, 1 << 40, group="grp")
    logp = F.transform(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: P.safe_log(F.slice("flat", i * C + 1, F.lit(C))))
    targets = packed.select("grp", (F.floor(F.col("grp") / 100) % 4).cast("int").alias("held"), "n", "ids", logp.alias("logp"))
    sequences = _sequences(spark, sf).withColumn("fold", F.col("fold").cast("int"))
    return S.template_proposals(targets, S.held_out_catalogs(sequences, "fold", 4, "held"), "grp", 0.5, by=["held"])


@query("q8_template_proposals", f"with {_PROPOSE} select grp, n, labels, freq, round(loss, 6) as loss, round(case when margin < 1e300 then margin end, 6) as margin from pp", "seq post")
def q8(spark, sf):
    p = _proposals(spark, sf)
    return p.select("grp", "n", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"), "freq", R6("loss").alias("loss"), R6(F.when(F.col("margin") < 1e300, F.col("margin"))).alias("margin"))


@query(
    "q9_confidence_gate",
    f"""with {_PROPOSE} select n, round(loss, 9) <= 0.3 and round(margin, 9) >= 0.1 as accepted, count(*) as n_groups from pp group by 1, 2""",
    "seq post",
)
def q9(spark, sf):
    return S.gate_proposals(_proposals(spark, sf), 0.3, 0.1).groupBy("n", "accepted").agg(F.count("*").alias("n_groups"))


@query(
    "q9_gated_labels",
    f"""with {_PROPOSE}, ac as (select grp, string_split(labels, ',') as ls from pp where round(loss, 9) <= 0.3 and round(margin, 9) >= 0.1)
        select rp.sample_id, ac.grp is not null as from_template, coalesce(ac.ls[rp.pos]::int, m.pred::int) as pred from rp join mpred m on m.sample_id = rp.sample_id and m.member = 0 left join ac on ac.grp = rp.grp""",
    "seq post mpred",
)
def q9_labels(spark, sf):
    t = _targets(spark, sf).withColumn("grp", F.col("subject") * 100 + F.col("year")).withColumn("base", P.argmax("probs", 9))
    rows = ordered_scan(t.select("grp", "sample_id", "t0", "year", "base"), ["grp"], ["t0", "sample_id"], "year", row="pos")
    out = S.apply_gate(rows, S.gate_proposals(_proposals(spark, sf), 0.3, 0.1), "grp", "pos", "base")
    return out.select("sample_id", "from_template", F.col("pred").cast("int").alias("pred"))


_MARKOV = f"""{_PROPOSE}, {_SRC}, e as (select *, lead(label) over w as nx from src window w as (partition by subject order by t0, sample_id)), hf as (select unnest([0, 1, 2, 3]) as held), cl as (select unnest([0, 1, 2, 3, 4]) as c),
  tc as (select held, label as prev, nx as next, count(*) as n from e join hf on subject % 4 <> held where nx is not null group by all),
  tr as (select hf.held, a.c as prev, b.c as next, ln((coalesce(n, 0) + 1) / (sum(coalesce(n, 0)) over (partition by hf.held, a.c) + 5)::double) as s from hf cross join cl a cross join cl b left join tc on tc.held = hf.held and tc.prev = a.c and tc.next = b.c),
  tie as (select subject * 100 + year as grp from seq group by subject, year having count(*) > count(distinct t0)),
  em as (select rp.*, cls, ln(greatest(p, 1e-12)) as e from rp join post using (sample_id) where member = 0 and rp.grp not in (select grp from tie)),
  vt(held, grp, pos, n, cls, score, path) as (
    select held, em.grp, pos, n, cls, e, [cls] from em where pos = 1
    union all
    select em.held, em.grp, em.pos, em.n, em.cls, max_by(vt.score + 0.5 * tr.s, (round(vt.score + 0.5 * tr.s, 9), -tr.prev)) + any_value(e), list_append(max_by(vt.path, (round(vt.score + 0.5 * tr.s, 9), -tr.prev)), em.cls)
    from vt join em on em.grp = vt.grp and em.pos = vt.pos + 1 join tr on tr.held = em.held and tr.prev = vt.cls and tr.next = em.cls group by em.held, em.grp, em.pos, em.n, em.cls),
  fin as (select grp, max_by(path, (round(score, 9), -cls)) as path from vt where pos = n group by 1)"""


@query(
    "q9_markov_fallback",
    f"""with recursive {_MARKOV}, ac as (select grp, string_split(labels, ',') as ls from pp where round(loss, 9) <= 0.3 and round(margin, 9) >= 0.1)
        select rp.sample_id, ac.grp is not null as from_template, fin.grp is not null as decoded, coalesce(ac.ls[rp.pos]::int, fin.path[rp.pos]::int, m.pred::int) as pred
        from rp join mpred m on m.sample_id = rp.sample_id and m.member = 0 left join ac on ac.grp = rp.grp left join fin on fin.grp = rp.grp""",
    "seq post mpred",
)
def q9_markov(spark, sf):
    """Rows of recordings whose template was turned down take the best path under the other folds' transitions; recordings
    without a known order keep their arg-max."""
    per = counts(spark, sf, ["fold"])
    models = N.paired_models(per, "fold", 4, C)
    t = _targets(spark, sf).withColumn("grp", F.col("subject") * 100 + F.col("year"))
    known, decoded = S.ordered_rows(t, "grp", "t0", "sample_id", "year"), None
    for k in range(4):
        part = S.viterbi_decode(_packed(known.filter(F.col("subject") % 4 == k), group="grp"), "grp", "sample_id", *models[k, k], 0.5)
        decoded = part if decoded is None else decoded.unionByName(part)
    rows = ordered_scan(t.select("grp", "sample_id", "t0", "year", "probs"), ["grp"], ["t0", "sample_id"], "year", row="pos")
    rows = S.decode_with_fallback(rows, decoded, "grp", "sample_id", "probs").withColumnRenamed("pred", "fallback")
    out = S.apply_gate(rows, S.gate_proposals(_proposals(spark, sf), 0.3, 0.1), "grp", "pos", "fallback")
    return out.select("sample_id", "from_template", (~F.col("skipped")).alias("decoded"), F.col("pred").cast("int").alias("pred"))


_GRID = (0.25, 0.5, 1.0)


@query(
    "e9_nested_decoder",
    f"""with recursive {_SRC}, fo as (select unnest([0, 1, 2, 3]) as f), pa as (select a.f, b.f as g from fo a, fo b), e as (select *, lead(label) over w as nx from src window w as (partition by subject order by t0, sample_id)),
      un as (select f, g, c, (select count(*) from src where label = c and subject % 4 <> f and subject % 4 <> g) as u from pa, (select unnest([0, 1, 2, 3, 4]) as c)),
      pr as (select f, g, c, (u + 1) / (sum(u) over (partition by f, g) + 5)::double as q from un),
      tc as (select f, g, label as prev, nx as next, count(*) as n from e join pa on subject % 4 <> f and subject % 4 <> g where nx is not null group by all),
      tr as (select b.f, b.g, a.c as prev, b.c as next, ln((coalesce(n, 0) + 5 * q) / (sum(coalesce(n, 0)) over (partition by b.f, b.g, a.c) + 5)) as s from pr b cross join (select unnest([0, 1, 2, 3, 4]) as c) a left join tc on tc.f = b.f and tc.g = b.g and tc.prev = a.c and tc.next = b.c),
      st as (select f, g, w from pa, (select unnest([0.25e0, 0.5e0, 1e0]) as w)),
      ro as (select sample_id, subject, label, subject % 4 as g, row_number() over (partition by subject order by t0, sample_id) as pos, count(*) over (partition by subject) as n from seq),
      em as (select ro.*, cls, ln(greatest(p, 1e-12)) as e from ro join post using (sample_id) where member = 0),
      vt(f, g, w, subject, pos, n, cls, score, path) as (
        select st.f, st.g, st.w, em.subject, pos, n, cls, e, [cls] from em join st on st.g = em.g where pos = 1
        union all
        select vt.f, vt.g, vt.w, em.subject, em.pos, em.n, em.cls, max_by(vt.score + vt.w * tr.s, (round(vt.score + vt.w * tr.s, 9), -tr.prev)) + any_value(e), list_append(max_by(vt.path, (round(vt.score + vt.w * tr.s, 9), -tr.prev)), em.cls)
        from vt join em on em.subject = vt.subject and em.pos = vt.pos + 1 join tr on tr.f = vt.f and tr.g = vt.g and tr.prev = vt.cls and tr.next = em.cls group by vt.f, vt.g, vt.w, em.subject, em.pos, em.n, em.cls),
      fin as (select f, g, w, subject, max_by(path, (round(score, 9), -cls)) as path from vt where pos = n group by 1, 2, 3, 4),
      hi as (select f, fin.g, w, count(*) filter (where path[pos] = label) as hits, count(*) as n from fin join ro using (subject) group by 1, 2, 3),
      ag as (select f, w, sum(case when f <> g then hits else 0 end) as sel, sum(case when f = g then hits else 0 end) as hits, sum(case when f = g then n else 0 end) as n from hi group by 1, 2)
      select f as outer, w as weight, sel::bigint as selection_hits, hits::bigint as hits, n::bigint as n from ag qualify row_number() over (partition by f order by sel desc, w) = 1""".replace("f as outer", 'f as "outer"'),
    "seq post",
)
def e9_nested_decoder(spark, sf):
    per = counts(spark, sf, ["fold"])
    models = N.paired_models(per, "fold", 4, C, backoff="unigram")
    rows = _targets(spark, sf).withColumn("fold", (F.col("subject") % 4).cast("int"))
    return N.nested_decoder(rows, models, "subject", ["t0", "sample_id"], "sample_id", "probs", "label", "year", "fold", 4, _GRID)


YEAR = 365 * 86400
_CLUST = """rc as (select subject % 50 as owner, subject * 100 + year as grp, count(*) as n, min(t0) as s, max(t0) as e, count(*) > count(distinct t0) as amb, bool_and(sample_id % 29 <> 3) as complete from seq group by subject, year),
  pv as (select *, lag(grp) over w as pg, lag(n) over w as pn, lag(e) over w as pe, lag(amb) over w as pamb, lag(complete) over w as pc from rc window w as (partition by owner order by s, grp)),
  ro as (select sample_id, subject * 100 + year as grp, row_number() over (partition by subject, year order by t0, sample_id) as pos from seq),
  pr as (select * from pv where complete and pc and not amb and not pamb and n = pn and s - pe <= 864000),
  al as (select pr.grp, a.pos, sum(x.p * y.p) / (sqrt(sum(x.p * x.p)) * sqrt(sum(y.p * y.p))) as cs from pr join ro a on a.grp = pr.grp join ro b on b.grp = pr.pg and b.pos = a.pos
         join post x on x.sample_id = a.sample_id and x.member = 0 join post y on y.sample_id = b.sample_id and y.member = 0 and y.cls = x.cls group by 1, 2),
  lk as (select grp, round(avg(cs), 9) >= 0.5 as linked from al group by 1),
  cu as (select owner, rc.grp, n, coalesce(linked, false) as linked, sum(case when coalesce(linked, false) then 0 else 1 end) over (partition by owner order by s, rc.grp) - 1 as cluster from rc left join lk on lk.grp = rc.grp)"""


def _clusters(spark, sf):
    d = recordings(spark, sf).withColumn("chosen", F.col("sample_id") % 29 != 3)
    d = d.withColumn("_every", F.lit(True))
    whole = ST.build_recordings(d, "grp", "owner", "t0", "t0", "sample_id", "_every", "day").drop("complete")
    complete = d.groupBy("grp").agg(F.min(F.col("chosen").cast("int")).alias("_c")).select("grp", (F.col("_c") == 1).alias("complete"))
    recs = whole.join(complete, "grp").withColumn("seg", F.floor(F.col("rec_start") / YEAR))
    rows = v.posteriors_wide(spark, sf).select((F.col("subject") * 100 + F.col("year")).alias("grp"), "sample_id", "t0", "year", F.col("p0").alias("probs"))
    rows = ordered_scan(rows, ["grp"], ["t0", "sample_id"], "year", row="pos")
    return rows, S.repetition_clusters(rows, recs, "owner", "grp", "pos", "probs", 864000, 0.5, "seg")


@query("q10_repetition_clusters", f"with {_CLUST} select owner, grp, cluster::bigint as cluster, linked from cu", "seq post")
def q10(spark, sf):
    _, c = _clusters(spark, sf)
    return c.select("owner", "grp", F.col("cluster").cast("long").alias("cluster"), "linked")


@query(
    "q11_consensus_blend",
    f"""with {_CLUST}, x as (select post.sample_id, post.cls, p, cu.owner, cluster, pos from post join ro using (sample_id) join cu on cu.grp = ro.grp where member = 0),
        m as (select owner, cluster, pos, cls, avg(p) as mp, count(*) as k from x group by 1, 2, 3, 4)
        select sample_id, cls, round(case when k > 1 then 0.4 * p + 0.6 * mp else p end, 6) as p from x join m using (owner, cluster, pos, cls)""",
    "seq post",
)
def q11(spark, sf):
    rows, c = _clusters(spark, sf)
    d = rows.join(c.select("grp", "owner", "cluster"), "grp")
    b = S.position_blend(d, ["owner", "cluster", "pos"], "probs", C, 0.6)
    return b.select("sample_id", P.by_class("blended", C).alias("cls", "p")).select("sample_id", "cls", R6("p").alias("p"))


_POS3 = """r as (select sample_id, subject % 200 as blk, year % 3 as rep, row_number() over (partition by subject % 200, year % 3 order by t0, sample_id) as pos from seq)"""


def _triples(spark, sf):
    w = v.posteriors_wide(spark, sf).withColumns({"blk": F.col("subject") % 200, "rep": F.col("year") % 3})
    return ordered_scan(w.select("sample_id", "blk", "rep", "t0", "year", F.col("p0").alias("probs")), ["blk", "rep"], ["t0", "sample_id"], "year", row="pos")


@query(
    "q12_structure_consensus",
    f"""with {_POS3}, x as (select post.sample_id, cls, ln(greatest(p, 1e-12)) as l, blk, pos from post join r using (sample_id) where member = 0), z as (select *, case when count(*) over w > 1 then sum(l) over w else l end as z from x window w as (partition by blk, pos, cls))
        select sample_id, cls, round(exp(z - m) / sum(exp(z - m)) over (partition by sample_id), 6) as p from (select *, max(z) over (partition by sample_id) as m from z)""",
    "seq post",
)
def q12(spark, sf):
    b = S.position_blend(_triples(spark, sf), ["blk", "pos"], "probs", C, 1.0, log_space=True, total=True)
    return b.select("sample_id", P.by_class("blended", C).alias("cls", "p")).select("sample_id", "cls", R6("p").alias("p"))


@query(
    "q13_twin_pooling",
    f"""with {_POS3}, x as (select post.sample_id, cls, ln(greatest(p, 1e-12)) as l, blk, pos from post join r using (sample_id) where member = 0), z as (select *, 0.3 * l + 0.7 * avg(l) over (partition by blk, pos, cls) as z from x)
        select sample_id, cls, round(exp(z) / sum(exp(z)) over (partition by sample_id), 6) as p from z""",
    "seq post",
)
def q13(spark, sf):
    b = S.position_blend(_triples(spark, sf), ["blk", "pos"], "probs", C, 0.7, log_space=True)
    return b.select("sample_id", P.by_class("blended", C).alias("cls", "p")).select("sample_id", "cls", R6("p").alias("p"))


@query(
    "q14_specialist_routing",
    """with b as (select sample_id, pred in (1, 3, 4) as routed, pred from mpred where member = 0), r as (select sample_id, member, cls, p / sum(p) over (partition by sample_id, member) as p from post where cls in (1, 3, 4) and member in (0, 2)),
            m as (select sample_id, cls, sqrt(exp(sum(ln(p)))) as s from r group by 1, 2), w as (select sample_id, cls from m qualify row_number() over (partition by sample_id order by round(s, 9) desc, cls) = 1)
       select sample_id, routed, case when routed then w.cls else b.pred end as pred from b join w using (sample_id)""",
    "post mpred",
)
def q14(spark, sf):
    return S.route_to_specialist(v.posteriors_wide(spark, sf), "p0", "p2", [1, 3, 4]).select("sample_id", "routed", "pred")


@query(
    "q15_prototype_swap",
    """with c as (select label as k, d, avg(v) as m from vecdim group by 1, 2), s as (select sample_id, any_value(subject) as subject, any_value(label) as label, k, sum(v * m) / (sqrt(sum(v * v)) * sqrt(sum(m * m))) as z from vecdim join c using (d) group by sample_id, k),
            r as (select *, row_number() over (partition by sample_id order by round(z, 9) desc, k) as rk from s),
            t as (select sample_id, subject, label, max(case when rk = 1 then k end) as a, max(case when rk = 2 then k end) as b, max(case when rk = 1 then z end) - max(case when rk = 2 then z end) as mg from r group by 1, 2, 3),
            u as (select sample_id, d, v / sqrt(sum(v * v) over (partition by sample_id)) as v from vecdim),
            ps as (select t.subject, a as k, d, sum(v) as s, count(*) as n from t join u using (sample_id) where mg > 0.02 group by 1, 2, 3),
            g as (select t.sample_id, t.a, t.b, any_value(t.mg) as mg, sum(u.v * (pa.s - case when mg > 0.02 then u.v else 0 end)) / greatest(sqrt(sum(pow(pa.s - case when mg > 0.02 then u.v else 0 end, 2))), 1e-9) as ca,
                    sum(u.v * pb.s) / greatest(sqrt(sum(pb.s * pb.s)), 1e-9) as cb, any_value(pa.n) - any_value(case when mg > 0.02 then 1 else 0 end) as na, any_value(pb.n) as nb
                  from t join u using (sample_id) left join ps pa on pa.subject = t.subject and pa.k = t.a and pa.d = u.d left join ps pb on pb.subject = t.subject and pb.k = t.b and pb.d = u.d group by t.sample_id, t.a, t.b)
       select sample_id, coalesce(na > 0 and nb > 0 and round(cb - ca, 9) > 0.05, false) as swapped, case when coalesce(na > 0 and nb > 0 and round(cb - ca, 9) > 0.05, false) then b else a end as pred from g""",
    "vecdim",
)
def q15(spark, sf):
    d = v.vectors(spark, sf)
    table = d.groupBy("label").agg(P.vector_agg(F.avg, "vec", v.EMB_DIM).alias("c")).agg(F.sort_array(F.collect_list(F.struct("label", "c"))).alias("t"))
    d = d.withColumn("_t", table.scalar()).withColumn("z", F.transform("_t", lambda s: V.cosine("vec", s["c"])))
    d = d.withColumn("_z", F.transform("z", lambda x: F.round(x, 9))).withColumn("_r", P.ranked_classes("_z"))
    d = d.withColumns({"top1": F.col("_r")[0], "top2": F.col("_r")[1]}).withColumn("mg", F.col("z")[F.col("top1")] - F.col("z")[F.col("top2")])
    out = S.prototype_swap(d.select("sample_id", "subject", "vec", "top1", "top2", "mg"), "subject", "vec", v.EMB_DIM, "top1", "top2", "mg", 0.02, 0.05)
    return out.select("sample_id", "swapped", "pred")
