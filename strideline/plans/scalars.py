"""Projections, filters and array functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideline.functions import posterior as P
from strideline.functions import text as X
from strideline.functions import vectors as V
from strideline.operators import scan
from strideline.operators import spectrum as S
from strideline.operators import timeseries as ts
from strideline.plans import views as v
from strideline.plans.registry import query

C = v.N_CLASSES
R6 = lambda c: F.round(c, 6)
OBJECT_SET = [0, 1, 4]  # fixed values: the classes treated as the object group


def _cells(df, arr, *keep):
    return df.select(*keep, F.posexplode(arr).alias("cls", "x")).select(*keep, "cls", R6("x").alias("x"))


@query(
    "p1_validate_posterior",
    """with raw as (select sample_id, case when sample_id % 13 = 0 then a[1:4] when sample_id % 17 = 0 then list_append(a[1:4], 'nan'::double)
            when sample_id % 19 = 0 then [0e0, 0e0, 0e0, 0e0, 0e0] else a end as a
        from (select sample_id, [((sample_id * (3 + 2 * c)) % 11 - case when sample_id % 23 = 0 then 4 else 0 end)::double
              for c in [0, 1, 2, 3, 4]] as a from seq)),
      r as (select *, case when len(a) <> 5 then 'length' when len(list_filter(a, lambda x: isnan(x))) > 0 then 'not_finite'
            when len(list_filter(a, lambda x: x < 0)) > 0 then 'negative' when list_sum(a) <= 0 then 'zero_sum' end as reason from raw)
      select sample_id, reason, round(case when reason is null then a[1] / list_sum(a) end, 6) as q0,
             round(case when reason is null then a[5] / list_sum(a) end, 6) as q4 from r""",
    "seq",
)
def p1(spark, sf):
    k = F.col("sample_id")
    shift = F.when(k % 23 == 0, 4).otherwise(0)
    full = F.array(*[((k * (3 + 2 * c)) % 11 - shift).cast("double") for c in range(C)])
    zero = F.array(*[F.lit(0.0)] * C)
    raw = (
        F.when(k % 13 == 0, F.slice(full, 1, 4))
        .when(k % 17 == 0, F.concat(F.slice(full, 1, 4), F.array(F.lit(float("nan")))))
        .when(k % 19 == 0, zero)
        .otherwise(full)
    )
    d = v.seq(spark, sf).select("sample_id", raw.alias("a"))
    q = P.validated("a", C)
    return d.select("sample_id", P.violation("a", C).alias("reason"), R6(q[0]).alias("q0"), R6(q[4]).alias("q4"))


@query("p2_laplace", "select sample_id, cls, round((p + 1e-3) / (1 + 5 * 1e-3), 6) as x from post where member = 0", "post")
def p2(spark, sf):
    return _cells(v.posteriors_wide(spark, sf), P.laplace("p0", 1e-3, C), "sample_id")


@query(
    "p3_softmax_log",
    """select sample_id, cls, round(exp(2 * l) / sum(exp(2 * l)) over (partition by sample_id), 6) as x
       from (select sample_id, cls, ln(greatest(p, 1e-12)) as l from post where member = 1)""",
    "post",
)
def p3(spark, sf):
    z = [x * 2.0 for x in P.log_items("p1", C)]
    return _cells(v.posteriors_wide(spark, sf), P.softmax(z, C), "sample_id")


@query("p4_argmax", "select sample_id, member, pred from mpred", "mpred")
def p4(spark, sf):
    return v.posteriors(spark, sf).select("sample_id", "member", P.argmax("probs", 9, C).alias("pred"))


@query(
    "p5_rank_topk_margin",
    """select sample_id, member, max(case when rk = 1 then cls end) as first_cls, max(case when rk = 2 then cls end) as second_cls,
              max(case when rk = 5 then cls end) as last_cls,
              round(max(case when rk = 1 then p end) - max(case when rk = 2 then p end), 6) as margin
       from mranked group by sample_id, member""",
    "mranked",
)
def p5(spark, sf):
    rounded = F.transform("probs", lambda x: F.round(x, 9))
    r = P.ranked_classes(rounded)
    top = P.top_k(rounded, 2)
    return v.posteriors(spark, sf).select(
        "sample_id", "member", top[0].alias("first_cls"), top[1].alias("second_cls"), r[C - 1].alias("last_cls"),
        R6(P.top2_margin("probs")).alias("margin"),
    )


@query(
    "p6_entropy_confidence",
    """select sample_id, member, round(max(p), 6) as conf, round(-sum(p * ln(greatest(p, 1e-12))), 6) as entropy
       from post group by sample_id, member""",
    "post",
)
def p6(spark, sf):
    return v.posteriors(spark, sf).select(
        "sample_id", "member", R6(P.confidence("probs", C)).alias("conf"), R6(P.entropy("probs", n=C)).alias("entropy")
    )


@query(
    "p7_temperature",
    """select sample_id, cls, temp, round(exp(l / temp) / sum(exp(l / temp)) over (partition by sample_id, temp), 6) as x
       from (select sample_id, cls, ln(greatest(p, 1e-12)) as l, temp::double as temp from post
             cross join (values (0.5), (2.0), (5.0)) t(temp) where member = 2)""",
    "post",
)
def p7(spark, sf):
    d = scan.settings(v.posteriors_wide(spark, sf), [{"temp": t} for t in (0.5, 2.0, 5.0)])
    return _cells(d, P.temper("p2", "temp", C), "sample_id", "temp")


@query(
    "p8_prior_correction",
    """select sample_id, cls, round((p / q) / sum(p / q) over (partition by sample_id), 6) as x
       from post join prior using (cls) where member = 3""",
    "post prior",
)
def p8(spark, sf):
    from strideline.operators.fusion import class_prior

    d = v.posteriors_wide(spark, sf).withColumn("prior", class_prior(v.seq(spark, sf), "label", C).scalar())
    return _cells(d, P.divide_prior("p3", "prior", C), "sample_id")


@query(
    "p9_norm_cosine",
    """select sample_id, round(sqrt(list_sum([x * x for x in vec])), 6) as norm,
              round(list_sum([x for x in vec]) / (sqrt(list_sum([x * x for x in vec])) * 8e0), 6) as cos_to_ones,
              round(vec[1] / sqrt(list_sum([x * x for x in vec])), 6) as first_unit from vectors""",
    "vectors",
)
def p9(spark, sf):
    ones = F.array_repeat(F.lit(1.0), v.EMB_DIM)
    return v.vectors(spark, sf).select(
        "sample_id", R6(V.norm("vec")).alias("norm"), R6(V.cosine("vec", ones)).alias("cos_to_ones"),
        R6(V.l2_normalise("vec")[0]).alias("first_unit"),
    )


@query("p10_magnitude", "select sample_id, round(sqrt(x * x + y * y + z * z), 6) as mag from sensor", "sensor")
def p10(spark, sf):
    return v.sensor(spark, sf).select("sample_id", R6(V.magnitude("x", "y", "z")).alias("mag"))


def _imu(spark, sf):
    """Sixteen-channel rows cut from the embeddings: acc, gyr, ang, mag, quaternion."""
    e = v.vectors(spark, sf)
    scaled = {"acc": (1, 2.0), "gyr": (4, 900.0), "ang": (7, 400.0), "mag": (10, 300.0)}
    cols = [(F.col("vec")[at - 1 + i] * k).alias(f"{g}{i}") for g, (at, k) in scaled.items() for i in range(3)]
    q = [F.when(F.col("sample_id") % 29 == 0, 0.0).otherwise(F.col("vec")[12 + i]).alias(f"q{i}") for i in range(4)]
    return e.select("sample_id", "subject", *cols, *q)


_IMU_SQL = """imu as (select sample_id, vec[1] * 2e0 as a0, vec[2] * 2e0 as a1, vec[3] * 2e0 as a2, vec[4] * 900e0 as g0, vec[5] * 900e0 as g1,
    vec[6] * 900e0 as g2, vec[7] * 400e0 as ang0, vec[10] * 300e0 as mag0,
    case when sample_id % 29 = 0 then 0e0 else vec[13] end as q0, case when sample_id % 29 = 0 then 0e0 else vec[14] end as q1,
    case when sample_id % 29 = 0 then 0e0 else vec[15] end as q2, case when sample_id % 29 = 0 then 0e0 else vec[16] end as q3 from vectors),
  un as (select *, sqrt(q0*q0+q1*q1+q2*q2+q3*q3) as n from imu),
  rot as (select *, q0/n as w, q1/n as u0, q2/n as u1, q3/n as u2 from un),
  mat as (select *, 1-2*(u1*u1+u2*u2) as r00, 2*(u0*u1-w*u2) as r01, 2*(u0*u2+w*u1) as r02,
     2*(u0*u1+w*u2) as r10, 1-2*(u0*u0+u2*u2) as r11, 2*(u1*u2-w*u0) as r12,
     2*(u0*u2-w*u1) as r20, 2*(u1*u2+w*u0) as r21, 1-2*(u0*u0+u1*u1) as r22 from rot),
  wrl as (select *, case when n > 1e-8 then r00*a0+r01*a1+r02*a2 else 0 end as wx, case when n > 1e-8 then r10*a0+r11*a1+r12*a2 else 0 end as wy,
     case when n > 1e-8 then r20*a0+r21*a1+r22*a2 else 0 end as wz, case when n > 1e-8 then r00*g0+r01*g1+r02*g2 else 0 end as vx,
     case when n > 1e-8 then r10*g0+r11*g1+r12*g2 else 0 end as vy, case when n > 1e-8 then r20*g0+r21*g1+r22*g2 else 0 end as vz from mat)"""


@query("p11_rotate_to_world", f"with {_IMU_SQL} select sample_id, round(wx, 6) as wx, round(wy, 6) as wy, round(wz, 6) as wz from wrl", "vectors")
def p11(spark, sf):
    w = V.rotate_to_world(["q0", "q1", "q2", "q3"], ["acc0", "acc1", "acc2"])
    return _imu(spark, sf).select("sample_id", *[R6(c).alias(n) for n, c in zip(("wx", "wy", "wz"), w)])


@query(
    "p12_world_channels",
    f"""with {_IMU_SQL} select sample_id, round(wx, 6) as ax, round(wy, 6) as ay, round(wz - 1, 6) as az, round(vx / 500, 6) as gx,
        round(vy / 500, 6) as gy, round(vz / 500, 6) as gz, round(sqrt(wx*wx + wy*wy + (wz-1)*(wz-1)), 6) as a_mag,
        round(sqrt(vx*vx + vy*vy + vz*vz) / 500, 6) as g_mag from wrl""",
    "vectors",
)
def p12(spark, sf):
    ch = V.world_channels([f"acc{i}" for i in range(3)], [f"gyr{i}" for i in range(3)], [f"q{i}" for i in range(4)])
    return _imu(spark, sf).select("sample_id", *[R6(c).alias(n) for n, c in ch.items()])


@query(
    "p13_invariant_channels",
    f"""with {_IMU_SQL} select sample_id, round(a0, 6) as a0, round(a1, 6) as a1, round(a2, 6) as a2, round(sqrt(a0*a0+a1*a1+a2*a2), 6) as a_mag,
        round(g0, 6) as g0, round(g1, 6) as g1, round(g2, 6) as g2, round(sqrt(g0*g0+g1*g1+g2*g2), 6) as g_mag,
        round(q0 * s, 6) as q0, round(q1 * s, 6) as q1, round(q2 * s, 6) as q2, round(q3 * s, 6) as q3, case when n > 1e-8 then 1e0 else 0e0 end as present
        from (select *, case when q0 < 0 then -1e0 else 1e0 end as s from un)""",
    "vectors",
)
def p13(spark, sf):
    d = _imu(spark, sf).withColumn("present", V.norm(F.array("q0", "q1", "q2", "q3")) > 1e-8)
    ch = V.invariant_channels([f"acc{i}" for i in range(3)], [f"gyr{i}" for i in range(3)], [f"q{i}" for i in range(4)], "present")
    return d.select("sample_id", *[R6(c).alias(n) for n, c in ch.items()])


@query(
    "p14_unit_scale",
    f"""with {_IMU_SQL} select sample_id, round(a0, 6) as acc, round(g0 / 500, 6) as gyr, round(ang0 / 180, 6) as ang,
        round(mag0 / 100, 6) as mag, round(q0, 6) as quat from un""",
    "vectors",
)
def p14(spark, sf):
    src = {"acc": "acc0", "gyr": "gyr0", "ang": "ang0", "mag": "mag0", "quat": "q0"}
    return _imu(spark, sf).select("sample_id", *[R6(V.unit_scaled(c, F.lit(g))).alias(g) for g, c in src.items()])


@query(
    "p15_quantise",
    """with s as (select sample_id, vec, greatest(list_max([abs(x) for x in vec]), 1e-12) / 127e0 as sc from vectors),
       q as (select sample_id, sc, d, vec[d] as x, greatest(least(round_even(vec[d] / sc, 0), 127), -128) as code
             from s, (select unnest(range(1, 65)) as d))
       select sample_id, round(any_value(sc), 6) as scale, cast(sum(code) as bigint) as code_sum,
              cast(sum(code * code) as bigint) as code_sq, round(max(abs(code * sc - x)), 6) as max_err from q group by sample_id""",
    "vectors",
)
def p15(spark, sf):
    q = V.quantise("vec", 8)
    d = v.vectors(spark, sf).withColumns(q)
    add = lambda f: F.aggregate("codes", F.lit(0).cast("long"), lambda acc, c: acc + f(c.cast("long")))
    err = F.array_max(F.zip_with("restored", "vec", lambda a, b: F.abs(a - b)))
    return d.select("sample_id", R6("scale").alias("scale"), add(lambda c: c).alias("code_sum"), add(lambda c: c * c).alias("code_sq"), R6(err).alias("max_err"))


@query(
    "p16_class_set",
    """select sample_id, label in (0, 1, 4) as is_object, label between 1 and 3 as mid_range, subject % 4 = 2 as in_fold
       from seq where label in (0, 1, 4) or subject % 4 = 2""",
    "seq",
)
def p16(spark, sf):
    obj, fold = F.col("label").isin(OBJECT_SET), F.col("subject") % 4 == 2
    return v.seq(spark, sf).filter(obj | fold).select(
        "sample_id", obj.alias("is_object"), F.col("label").between(1, 3).alias("mid_range"), fold.alias("in_fold")
    )


@query(
    "p17_isotropic_normalise",
    """with b as (select clip, count(*) as n, min(x0) as xl, max(x0) as xh, min(y0) as yl, max(y0) as yh from boxes group by clip),
       s as (select *, greatest(xh - xl, yh - yl) as sc from b)
       select boxes.clip, frame, tie1, tie2, round(x0, 6) as px, round(y0, 6) as py,
         round(case when n < 4 or sc = 0 then 0e0 else greatest(least(((x0 - (xl + xh - sc) / 2) / sc - 0.5) * 2, 1), -1) end, 6) as nx,
         round(case when n < 4 or sc = 0 then 0e0 else greatest(least(((y0 - (yl + yh - sc) / 2) / sc - 0.5) * 2, 1), -1) end, 6) as ny
       from boxes join s using (clip)""",
    "boxes",
)
def p17(spark, sf):
    d = ts.isotropic_normalise(v.boxes(spark, sf), ["clip"], "x0", "y0")
    return d.select("clip", "frame", "tie1", "tie2", R6("x0").alias("px"), R6("y0").alias("py"), R6("nx").alias("nx"), R6("ny").alias("ny"))


@query("p18_axis_remap", "select sample_id, round(vec[1], 6) as ix, round(-vec[3], 6) as iy, round(vec[2], 6) as depth from vectors", "vectors")
def p18(spark, sf):
    return v.vectors(spark, sf).select("sample_id", *[R6(c).alias(n) for n, c in ts.image_axes(F.col("vec")[0], F.col("vec")[1], F.col("vec")[2]).items()])


@query(
    "p19_duration_phase",
    """select sample_id, round(ln(1 + greatest(least(value, 10), 0)) / ln(11), 6) as duration,
              round(sin(2 * pi() * (sample_id % 32) / 31e0), 6) as phase_sin, round(cos(2 * pi() * (sample_id % 32) / 31e0), 6) as phase_cos from clips""",
    "clips",
)
def p19(spark, sf):
    ph = V.phase_features(F.col("sample_id") % 32, 32)
    return v.clips(spark, sf).select("sample_id", R6(V.duration_feature("value")).alias("duration"), *[R6(c).alias(n) for n, c in ph.items()])


@query(
    "p20_ratio_gate",
    """with c as (select "user", sum(case when label = 'view' then 1 else 0 end) as n_ref, sum(case when label = 'click' then 1 else 0 end) as n_mod,
                 sum(case when label = 'click' then value end) as payload from clips group by "user"),
       g as (select *, case when n_ref > 0 and n_mod > 0 then n_mod / n_ref::double between 0.5 and 2.0 else n_mod > 0 end as kept from c)
       select "user", cast(n_ref as bigint) as n_ref, cast(n_mod as bigint) as n_mod, kept, round(case when kept then payload else 0e0 end, 6) as payload from g""",
    "clips",
)
def p20(spark, sf):
    n = lambda lab: F.count(F.when(F.col("label") == lab, 1))
    d = v.clips(spark, sf).groupBy("user").agg(
        n("view").alias("n_ref"), n("click").alias("n_mod"), F.sum(F.when(F.col("label") == "click", F.col("value"))).alias("payload")
    )
    d = d.withColumn("kept", V.ratio_gate("n_mod", "n_ref", 0.5, 2.0))
    return d.withColumn("payload", R6(F.when(F.col("kept"), F.col("payload")).otherwise(0.0)))


@query(
    "p21_role_overrides",
    """select p_partkey, split_part(p_name, ' ', 1) as role, len(list_filter(string_split(p_brand || '+' || p_type, '+'), lambda t: t <> '')) as n_tags,
              p_brand as first_tag from part""",
)
def p21(spark, sf):
    d = v.table(spark, sf, "part")
    first = F.split("p_name", " ")[0]
    spec = F.concat(first, F.lit("="), F.col("p_brand"), F.lit("+"), F.col("p_type"))
    m = X.role_overrides(spec)
    return d.select("p_partkey", F.map_keys(m)[0].alias("role"), F.size(m[first]).cast("long").alias("n_tags"), m[first][0].alias("first_tag"))


@query(
    "s6_spectrum",
    """with s as (select clip, device, x, row_number() over (partition by clip, device order by t, sample_id) - 1 as i,
                  count(*) over (partition by clip, device) as n, avg(x) over (partition by clip, device) as mu from sensor),
       f as (select clip, device, n, unnest(range(0, n // 2 + 1)) as k from (select distinct clip, device, n from s)),
       a as (select clip, device, f.n, k, sqrt(pow(sum((x - mu) * cos(2 * pi() * ((k * i) % f.n) / f.n)), 2) + pow(sum((x - mu) * sin(2 * pi() * ((k * i) % f.n) / f.n)), 2)) as amp
             from f join s using (clip, device) group by clip, device, f.n, k),
       g as (select *, row_number() over (partition by clip, device order by (k = 0), round(amp, 6) desc, k) as rk from a)
       select clip, device, n as n_samples, round(case when n > 3 then sum(case when k < greatest(1, (n // 2 + 1) // 4) then amp else 0 end) / (sum(amp) + 1e-9) else 0e0 end, 4) as low_share,
              case when n > 3 then max(case when rk = 1 then k end) else 0 end as peak_bin
       from g group by clip, device, n""",
    "sensor",
)
def s6(spark, sf):
    d = S.spectrum_features(v.sensor(spark, sf), ["clip", "device"], ["t", "sample_id"], "x")
    return d.select("clip", "device", "n_samples", F.round("low_share", 4).alias("low_share"), "peak_bin")
