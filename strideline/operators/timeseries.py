"""Cleaning, sessions, as-of matching, resampling and per-clip features of sensor series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strideline.operators.scan import array_quantile, count_breaks, neighbours, ordered_scan, quantiles, ranked
from strideline.operators.spectrum import DIRECT_LENGTH, array_features, spectrum_features


def clean_rows(df: DataFrame, keys: Sequence[str], t: str, tie: str, values: Sequence[str]) -> DataFrame:
    """Drop rows with a non-finite time or value; one row per timestamp, the first by `tie`.

    A grouped minimum instead of a sort: duplicates shrink map-side.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < F.lit(float("inf")))
    good = df.filter(reduce(lambda a, b: a & b, [finite(c) for c in (t, *values)]))
    first = F.min(F.struct(tie, *values)).alias("_f")
    return good.groupBy(*keys, t).agg(first).select(*keys, t, "_f.*")


def gap_sessions(df: DataFrame, keys, start: str, end: str, tie: str, gap: float, out: str, seg: str) -> DataFrame:
    """Number blocks per key: a new one where start - the previous row's end > gap.

    Rows without a start each get a block of their own, numbered downwards from -1.
    """
    timed = df.filter(F.col(start).isNotNull())
    opens = lambda cur, prev: cur[start] - prev[end] > gap
    numbered = count_breaks(timed, keys, [start, tie], seg, [start, end], opens, out)
    loose = df.filter(F.col(start).isNull())
    # segments of the tie value: rows without a start may be many
    loose = loose.withColumn("_tie_seg", F.floor(F.col(tie) / 4096))
    single = ordered_scan(loose, keys, [tie], "_tie_seg", row=out).withColumn(out, -F.col(out)).drop("_tie_seg")
    return numbered.unionByName(single)


def asof_nearest(anchors: DataFrame, stream: DataFrame, keys, t: str, tie: str, cols, tolerance, seg_width, forward: bool = False) -> DataFrame:
    """Nearest stream row in time per anchor (the earlier one on ties), NULL beyond the tolerance.

    `forward` looks only at or after the anchor, and then wants a gap strictly below the tolerance.
    Both sides are sorted together once per (key, time slice); neither is broadcast.
    """
    keys = list(keys)
    extra = [c for c in anchors.columns if c not in {*keys, t}]
    a = anchors.select(*keys, t, F.struct(*extra).alias("_anchor"), F.lit(None).cast(stream.schema[tie].dataType).alias(tie),
                       *[F.lit(None).cast(stream.schema[c].dataType).alias(c) for c in cols], F.lit(False).alias("_mark"))
    s = stream.select(*keys, t, F.lit(None).cast(a.schema["_anchor"].dataType).alias("_anchor"), tie, *cols, F.lit(True).alias("_mark"))
    both = a.unionByName(s).withColumn("_seg", F.floor(F.col(t) / seg_width))
    # at equal times: an anchor sorts between nothing and the stream for `after`, so exact hits are found ahead
    near = neighbours(both, keys, [t, tie], "_seg", "_mark", cols).filter(~F.col("_mark"))
    back, ahead = F.col(t) - F.col("before")[t], F.col("after")[t] - F.col(t)
    if forward:
        pick = F.when(ahead < tolerance, F.col("after"))
    else:
        choose_back = back.isNotNull() & (ahead.isNull() | (back <= ahead))
        best = F.when(choose_back, F.col("before")).otherwise(F.col("after"))
        pick = F.when(F.least(back, ahead) <= tolerance, best)
    out = near.withColumn("_pick", pick)
    return out.select(*keys, t, "_anchor.*", F.col("_pick")[t].alias(f"matched_{t}"), F.col("_pick")[tie].alias(f"matched_{tie}"), *[F.col("_pick")[c].alias(f"matched_{c}") for c in cols])


def covering_interval(points: DataFrame, ranges: DataFrame, keys, t: str, start: str, end: str, seg_width) -> DataFrame:
    """The latest-starting range of the key that holds each point, for ranges that do not overlap."""
    keys = list(keys)
    extra = [c for c in points.columns if c not in {*keys, t}]
    carried = [c for c in ranges.columns if c not in {*keys, start}]
    p = points.select(*keys, t, F.lit(1).alias("_kind"), F.struct(*extra).alias("_pt"),
                      *[F.lit(None).cast(ranges.schema[c].dataType).alias(c) for c in carried], F.lit(False).alias("_mark"))
    r = ranges.select(*keys, F.col(start).alias(t), F.lit(0).alias("_kind"), F.lit(None).cast(p.schema["_pt"].dataType).alias("_pt"),
                      *carried, F.lit(True).alias("_mark"))
    both = p.unionByName(r).withColumn("_seg", F.floor(F.col(t) / seg_width))
    near = neighbours(both, keys, [t, "_kind"], "_seg", "_mark", carried).filter(~F.col("_mark"))
    inside = F.col("before").isNotNull() & (F.col(t) <= F.col("before")[end])
    hit = lambda c: F.when(inside, F.col("before")[c])
    return near.select(*keys, t, "_pt.*", F.coalesce(inside, F.lit(False)).alias("covered"), hit(t).alias(start), *[hit(c).alias(c) for c in carried])


def resample_linear(df: DataFrame, clip: str, device: str, t: str, values: Sequence[str], steps: int, masked: bool = True) -> DataFrame:
    """Linear resampling of every device onto its clip's common grid of `steps` points.

    The grid runs from the earliest start to the latest end over the devices with two samples or
    more. Samples are first reduced, map-side, to the last and first one of each grid cell, so a
    clip of any length becomes at most `steps` rows per device before anything is sorted.
    """
    span = df.groupBy(clip, device).agg(F.min(t).alias("_s"), F.max(t).alias("_e"), F.count("*").alias("_n")).filter("_n >= 2")
    bounds = span.groupBy(clip).agg(F.min("_s").alias("_g0"), F.max("_e").alias("_g1"))
    grid = span.join(bounds.filter("_g0 < _g1"), clip)
    step = (F.col("_g1") - F.col("_g0")) / F.lit(float(steps - 1))
    cell = F.greatest(F.least(F.ceil((F.col(t) - F.col("_g0")) / step), F.lit(steps - 1)), F.lit(0))
    item = F.struct(t, *values)
    cells = (
        df.join(grid, [clip, device])
        .groupBy(clip, device, cell.cast("int").alias("step"))
        .agg(F.max(item).alias("_last"), F.min(item).alias("_first"))
    )
    points = grid.select(clip, device, "_s", "_e", "_g0", "_g1", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    w = W.partitionBy(clip, device).orderBy("step")
    dense = points.join(cells, [clip, device, "step"], "left")
    left = F.last("_last", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    right = F.first("_first", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    out = dense.withColumns({"_l": left, "_r": right, "g": F.col("_g0") + (F.col("_g1") - F.col("_g0")) * F.col("step") / F.lit(float(steps - 1))})
    support = F.col("g").between(F.col("_s"), F.col("_e"))
    share = (F.col("g") - F.col("_l")[t]) / (F.col("_r")[t] - F.col("_l")[t])
    cols = []
    for v in values:
        lo, hi = F.col("_l")[v], F.col("_r")[v]
        lerp = F.when(F.col("_l").isNull(), hi).when(F.col("_r").isNull(), lo).otherwise(lo + (hi - lo) * share)
        cols.append((F.when(support, lerp).otherwise(F.lit(0.0)) if masked else lerp).alias(v))
    return out.select(clip, device, "step", "g", *cols, support.alias("present"))


def fixed_rate_grid(bounds: DataFrame, start: str, end: str, rate: float = 10.0, limit: int = 48) -> DataFrame:
    """A centred grid of `rate` points a second per clip, at most `limit` valid steps."""
    dur = F.greatest(F.col(end) - F.col(start), F.lit(0.1))
    n = F.least(F.lit(limit), F.greatest(F.lit(2), F.floor(dur * rate).cast("int") + 1))
    slack = F.greatest(dur - (n - 1) / F.lit(rate), F.lit(0.0)) / 2.0
    return bounds.withColumns({"n_valid": n, "grid_start": F.col(start) + slack}).withColumn(
        "step", F.explode(F.sequence(F.lit(0), F.lit(limit - 1)))
    ).withColumns({"g": F.col("grid_start") + F.col("step") / F.lit(rate), "valid": F.col("step") < F.col("n_valid")})


def sample_rows(df: DataFrame, keys, order, seg, indices) -> DataFrame:
    """Rows at given positions of each ordered key: `indices(n)` is an array column of 0-based positions."""
    keys = list(keys)
    size = df.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    picks = size.select(*keys, "n_rows", F.posexplode(indices(F.col("n_rows"))).alias("slot", "idx"))
    rows = ordered_scan(df, keys, order, seg, row="_row").withColumn("idx", (F.col("_row") - 1).cast("int")).drop("_row")
    return picks.join(rows, [*keys, "idx"])


def centre_crop(df: DataFrame, keys, order, seg, length: int) -> DataFrame:
    """The middle `length` rows per key, padded to that length with an absent mask."""
    keys = list(keys)
    size = df.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    start = F.when(F.col("n_rows") > length, F.floor((F.col("n_rows") - length) / 2)).otherwise(F.lit(0))
    slots = size.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).withColumn("idx", F.col("slot") + start)
    rows = ordered_scan(df, keys, order, seg, row="_row").withColumn("idx", F.col("_row") - 1).drop("_row")
    return slots.join(rows, [*keys, "idx"], "left").withColumn("present", F.col("idx") < F.col("n_rows"))


def quantile_matched_length(lengths: DataFrame, target: DataFrame, key: str, length: str) -> DataFrame:
    """Trim each clip to the target length at the same rank of the length distribution."""
    count = lambda d: d.agg(F.count("*")).scalar()
    theirs = ranked(target, [], length, [key], "_t").select((F.col("_t") - 1).alias("_slot"), F.col(length).alias("_target"))
    ours = ranked(lengths, [], length, [key], "_rank").withColumns({"_n": count(lengths), "_m": count(target)})
    share = (F.col("_rank") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))
    placed = ours.withColumn("_slot", F.least(F.floor(share * (F.col("_m") - 1)), F.col("_m") - 1))
    return placed.join(theirs, "_slot").withColumn("trim_to", F.least(F.col(length), F.col("_target"))).drop("_rank", "_n", "_m", "_slot", "_target")


def channel_statistics(df: DataFrame, keys: Sequence[str], t: str, tie: str, value: str, seg: str | None, direct: int = DIRECT_LENGTH) -> DataFrame:
    """Thirteen descriptors of each ordered series plus its sample count."""
    keys = list(keys)
    x = F.col(value)
    totals = {"_rows": F.lit(1), "_some": F.when(x.isNotNull(), 1), "_sum": x}
    # series that each fit one array are scanned whole: they are shuffled once, by their keys, and their statistics stay there
    fits = (df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0) <= direct
    linked = ordered_scan(df, keys, [t, tie], None if fits else seg, prev=[value], totals=totals).withColumn("_mu", F.col("_sum") / F.col("_some"))
    d = x - F.col(f"prev_{value}")
    crossed = F.signum(x - F.col("_mu")) != F.signum(F.col(f"prev_{value}") - F.col("_mu"))
    edge = F.struct(t, tie, x.alias("v"))
    plain = [
        F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"),
        (F.max(edge)["v"] - F.min(edge)["v"]).alias("last_first"),
        F.coalesce(F.avg(F.abs(d)), F.lit(0.0)).alias("mean_abs_step"), F.coalesce(F.stddev_pop(d), F.lit(0.0)).alias("sd_step"),
        F.coalesce(F.max(F.abs(d)), F.lit(0.0)).alias("max_abs_step"),
        F.when(F.count("*") > 2, F.avg(crossed.cast("double"))).otherwise(F.lit(0.0)).alias("zero_cross"),
    ]
    names = [*keys, "n", *STATISTICS]
    # a series short enough for one array has its quantiles and its spectrum from the array, without a join
    short = linked.filter(F.col("_rows") <= direct).groupBy(*keys).agg(*plain, F.sort_array(F.collect_list(F.struct(t, tie, x.alias("_x")))).alias("_s"))
    short = short.withColumn("_s", F.transform("_s", lambda s: s["_x"].cast("double")))
    short = short.withColumns({"_f": array_features("_s"), "_q": F.sort_array(F.array_compact("_s"))})
    out = short.select("*", array_quantile("_q", 0.25).alias("p25"), array_quantile("_q", 0.75).alias("p75"), "_f.*").select(*names)
    if fits:
        return out
    long = linked.filter(F.col("_rows") > direct)
    rows = long.select(*df.columns)
    long_out = long.groupBy(*keys).agg(*plain).join(quantiles(rows, keys, value, {"p25": 0.25, "p75": 0.75}), keys)
    return out.unionByName(long_out.join(spectrum_features(rows, keys, [t, tie], value, seg, direct).drop("n_samples"), keys).select(*names))


STATISTICS = ["mean", "sd", "min", "max", "p25", "p75", "last_first", "mean_abs_step", "sd_step", "max_abs_step", "zero_cross", "low_share", "peak_bin"]


def index_grid(df: DataFrame, keys, order, seg, value: str, steps: int) -> DataFrame:
    """Each ordered series interpolated at `steps` evenly spaced positions; zeros below two samples."""
    keys = list(keys)
    rows = ordered_scan(df, keys, order, seg, row="_row", totals={"_n": F.lit(1)}).select(*keys, (F.col("_row") - 1).alias("i"), "_n", value)
    # every row knows the steps it is next to, so no table of positions is joined (or broadcast)
    last, i, gaps = F.lit(steps - 1), F.col("i"), F.col("_n") - 1
    first_step = F.when(gaps > 0, F.greatest(F.floor((i - 1) * last / gaps), F.lit(0))).otherwise(F.lit(0))
    last_step = F.when(gaps > 0, F.least(F.ceil((i + 1) * last / gaps), last)).otherwise(last)
    taps = rows.withColumn("step", F.explode(F.sequence(first_step.cast("int"), last_step.cast("int"))))
    at = F.col("step") * gaps / F.lit(float(steps - 1))
    lo = F.floor(at)
    taps = taps.filter((lo == i) | (lo + 1 == i)).withColumn("_w", F.when(lo == i, 1.0 - (at - lo)).otherwise(at - lo))
    hit = taps.groupBy(*keys, "step").agg(F.sum(F.col("_w") * F.col(value)).alias("_v"), F.max("_n").alias("_n"))
    return hit.select(*keys, "step", F.when(F.col("_n") > 1, F.col("_v")).otherwise(F.lit(0.0)).alias(value))


def device_coupling(grid: DataFrame, clip: str, device: str, value: str, devices: Sequence[str], steps: int) -> DataFrame:
    """Correlation and mean absolute difference of every device pair on a common grid.

    One pivoted row per (clip, step), then plain aggregates: no self-join. Absent devices are 0.
    """
    wide = grid.groupBy(clip, "step").pivot(device, list(devices)).agg(F.first(value)).na.fill(0.0)
    aggs, names = [], []
    for i, a in enumerate(devices):
        for b in devices[i + 1:]:
            flat = (F.stddev_pop(a) <= 1e-9) | (F.stddev_pop(b) <= 1e-9)
            aggs += [F.when(flat, 0.0).otherwise(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))).alias(f"corr_{a}_{b}"), F.avg(F.abs(F.col(a) - F.col(b))).alias(f"mad_{a}_{b}")]
            names.append((a, b))
    return wide.groupBy(clip).agg(*aggs)


def clip_feature_vector(df: DataFrame, clip, device, t, tie, channels: dict[str, Column], devices, coupling_on: str, seg, steps=32) -> DataFrame:
    """One wide row per clip: 13 statistics per (device, series), a count per device, couplings.

    With eight series and five devices this is 5 * (8 * 13 + 1) + 10 * 2 = 545 features.
    """
    names = list(channels)
    base = df.select(clip, device, t, tie, *([seg] if seg else []), *[c.alias(n) for n, c in channels.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("channel"), F.col(n).alias("v")) for n in names])
    long = base.select(clip, device, t, tie, *([seg] if seg else []), F.explode(pairs).alias("_c")).select("*", "_c.channel", "_c.v").drop("_c")
    stats = channel_statistics(long, [clip, device, "channel"], t, tie, "v", seg)
    slots = [f"{d}_{n}" for d in devices for n in names]
    picked = F.struct(*[F.col(s).cast("double").alias(s) for s in ["n", *STATISTICS]])
    wide = stats.withColumn("_slot", F.concat_ws("_", device, "channel")).groupBy(clip).pivot("_slot", slots).agg(F.first(picked))
    coupling = device_coupling(index_grid(base, [clip, device], [t, tie], seg, coupling_on, steps), clip, device, coupling_on, devices, steps)
    flat = [F.coalesce(F.col(f"{d}_{n}")[s], F.lit(0.0)).alias(f"{d}_{n}_{s}") for d in devices for n in names for s in STATISTICS]
    n_cols = [F.coalesce(F.col(f"{d}_{names[0]}")["n"], F.lit(0.0)).alias(f"{d}_count") for d in devices]
    # a row per clip on both sides
    return wide.select(clip, *flat, *n_cols).join(coupling.hint("merge"), clip)


def series_summary(df: DataFrame, keys, order, seg, value: str, ticks: int = 1_000_000) -> DataFrame:
    """Mean, spread, signed rank pooling, mean rise and mean fall of a series, each within [0, 1].

    Rank pooling sums integers (values in steps of 1/ticks, doubled ranks) and divides once, so that it does not
    depend on the order of rows; its sums come along as `pool_top` and `pool_base`.
    """
    keys = list(keys)
    size = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = ordered_scan(df, keys, order, seg, prev=[value], row="_row").join(size, keys)
    weight = 2 * (F.col("_row") - 1) - (F.col("_n") - 1)
    x, d = F.col(value), F.col(value) - F.col(f"prev_{value}")
    unit = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    top, base = F.sum(weight * F.round(x * ticks).cast("long")), F.sum(F.abs(weight)) * ticks
    pooled = F.when(base > 0, top / base.cast("double")).otherwise(F.lit(0.0))
    return rows.groupBy(*keys).agg(
        F.avg(x).alias("mean"), unit(F.stddev_pop(x) * 4).alias("spread"), unit(0.5 + 0.5 * pooled).alias("rank_pool"), top.alias("pool_top"), base.alias("pool_base"),
        unit(zero(F.avg(F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))))) * 4).alias("rise"), unit(zero(F.avg(F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0))))) * 4).alias("fall"),
    )


def phase_views(df: DataFrame, keys, order, seg, phases: int) -> DataFrame:
    """Tag every row with its interleaved view: every `phases`-th row from that phase on."""
    return ordered_scan(df, keys, order, seg, row="_row").withColumn("phase", F.pmod(F.col("_row") - 1, F.lit(phases))).drop("_row")


def isotropic_normalise(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    """2-D points scaled to [-1, 1] with one factor per clip; 0 with fewer than four points.

    The bounds are aggregated first and joined back, so a large clip is never sorted.
    """
    keys = list(keys)
    b = df.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min(x).alias("_xl"), F.max(x).alias("_xh"), F.min(y).alias("_yl"), F.max(y).alias("_yh")
    ).withColumn("_sc", F.greatest(F.col("_xh") - F.col("_xl"), F.col("_yh") - F.col("_yl")))
    flat = (F.col("_n") < 4) | (F.col("_sc") == 0)

    def unit(c, lo, hi):
        origin = (F.col(lo) + F.col(hi) - F.col("_sc")) / 2
        return F.when(flat, 0.0).otherwise(F.greatest(F.least(((F.col(c) - origin) / F.col("_sc") - 0.5) * 2, F.lit(1.0)), F.lit(-1.0)))

    return df.join(b, keys).withColumns({"nx": unit(x, "_xl", "_xh"), "ny": unit(y, "_yl", "_yh")}).drop("_n", "_xl", "_xh", "_yl", "_yh", "_sc")


def image_axes(x: Column, y: Column, z: Column) -> dict[str, Column]:
    """World to image: x stays, image y is -z (z is up), y becomes depth."""
    return {"ix": x, "iy": -z, "depth": y}
