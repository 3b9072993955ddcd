"""Streaming twins (X1-X5), each checked against its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideline.operators import sequence as S
from strideline.operators import timeseries as ts
from strideline.plans import views as v
from strideline.plans.registry import query
from strideline.plans.sequences import _MODEL_BY_YEAR, _model
from strideline.streaming import jobs as J

MINUTE = 60000000


def _events(spark, sf):
    return J.stream_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _us(c):
    return v.micros(F.col(c).cast("timestamp_ntz"))


@query(
    "x1_stream_gap_sessions",
    """with g as (select *, case when us - lag(us) over w > 1800000000 then 1 else 0 end as b from clips window w as (partition by label order by us)), s as (select *, sum(b) over (partition by label order by us) as sid from g),
            a as (select label, count(*) as n, min(us) as first_us, max(us) as last_us from s group by label, sid)
       select * from a where last_us + 1800000000 <= (select max(us) from clips) // 1000 * 1000 - 600000000""",
    "clips",
)
def x1(spark, sf):
    e = _events(spark, sf).select(F.col("event_type").alias("label"), "ts")
    out = J.run_to_table(J.gap_sessions(e, ["label"], "ts", "30 minutes", "10 minutes"), "sessions")
    return out.select("label", "n", _us("first_ts").alias("first_us"), _us("last_ts").alias("last_us"))


@query(
    "x2_stream_clip_metadata",
    """select "user", min(us) as t0, max(us) as t1, count(*) filter (where label = 'click') as n_click, count(*) filter (where label = 'view') as n_view from clips group by 1""",
    "clips",
)
def x2(spark, sf):
    e = _events(spark, sf).select(F.col("user_id").alias("user"), "event_id", "ts", "event_type")
    out = J.clip_metadata(e, "user", "event_id", "ts", "event_type", ["click", "view"], "1 hour", "metadata")
    return out.select("user", _us("t0").alias("t0"), _us("t1").alias("t1"), "n_click", "n_view")


@query(
    "x3_stream_tumbling_counts",
    """with w as (select us // 3600000000 * 3600000000 as start, label, count(*) as n from clips group by 1, 2) select * from w where start + 3600000000 <= (select max(us) from clips) // 1000 * 1000 - 600000000""",
    "clips",
)
def x3(spark, sf):
    e = _events(spark, sf).select(F.col("event_type").alias("label"), "ts")
    out = J.run_to_table(J.window_counts(e, "ts", "label", "1 hour", None, "10 minutes"), "tumbling")
    return out.select(_us("start").alias("start"), "label", "n")


@query(
    "x3_stream_sliding_counts",
    """with o as (select us // 1800000000 * 1800000000 - k * 1800000000 as start, label from clips, (select unnest([0, 1]) as k)), w as (select start, label, count(*) as n from o group by 1, 2)
       select * from w where start + 3600000000 <= (select max(us) from clips) // 1000 * 1000 - 600000000""",
    "clips",
)
def x3b(spark, sf):
    e = _events(spark, sf).select(F.col("event_type").alias("label"), "ts")
    out = J.run_to_table(J.window_counts(e, "ts", "label", "1 hour", "30 minutes", "10 minutes"), "sliding")
    return out.select(_us("start").alias("start"), "label", "n")


def _order_stream(spark, sf):
    o = J.stream_table(spark, sf, "orders")
    s = o.select(
        F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("subject"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("label"),
        F.col("o_orderdate").cast("timestamp").alias("ts"), F.floor(v.micros(F.col("o_orderdate")) / (v.DAY * MINUTE // 60)).alias("day"),
    )
    year = F.floor(F.col("day") / 365)
    s = s.withColumns({"grp": F.col("subject") * 100 + year, "close_ms": (year + 1) * 365 * v.DAY * 1000})
    return s.withColumn("probs", v.member_probs(0)).select("grp", "sample_id", "ts", "close_ms", "probs")


@query(
    "x4_stream_decode",
    f"""with recursive {_MODEL_BY_YEAR}, vt(grp, pos, n, cls, score, path) as (
          select em.grp, pos, n, cls, e, [cls] from em where pos = 1
          union all
          select em.grp, em.pos, em.n, em.cls, max_by(vt.score + 0.5 * tr.s, (round(vt.score + 0.5 * tr.s, 9), -tr.prev)) + any_value(e), list_append(max_by(vt.path, (round(vt.score + 0.5 * tr.s, 9), -tr.prev)), em.cls)
          from vt join em on em.grp = vt.grp and em.pos = vt.pos + 1 join tr on tr.prev = vt.cls and tr.next = em.cls group by em.grp, em.pos, em.n, em.cls),
        fin as (select grp, max_by(path, (round(score, 9), -cls)) as path from vt where pos = n group by 1)
        select grp, pos::int as pos, sample_id, path[pos] as decoded from ro join fin using (grp) where (grp % 100 + 1) * 31536000 <= (select max(t0) from seq)""",
    "seq post",
)
def x4(spark, sf):
    start, trans = _model(spark, sf, backoff="unigram")
    out = J.decode_closed_recordings(_order_stream(spark, sf), "grp", "ts", "close_ms", "sample_id", "probs", start, trans, 0.5, "0 seconds")
    return J.run_to_table(out, "decode")
