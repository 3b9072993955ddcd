"""Ordered scans and exact quantiles that survive one key holding a large share of all rows.

A plain window sorts a whole key inside one task. Here a key is cut into *segments* by an
integer column that never decreases along the order (a day number, `floor(t / width)`, a
position block). Rows are windowed inside (key, segment); one summary row per segment is
windowed per key; the carry is joined back on (key, segment), the partitioning the rows
already have. The result is the same as the plain window's, whatever the segment width.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strideline.session import cut_lineage

MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def bounded_broadcast(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """Hint a broadcast for a side whose row count has a proven bound (classes, settings);
    beyond the byte limit leave the join to Catalyst."""
    return F.broadcast(df) if rows * row_bytes <= MAX_BROADCAST_BYTES else df


def settings(df: DataFrame, rows: Sequence[Mapping], name: str = "setting") -> DataFrame:
    """Each row once per setting of a literal grid (a narrow explode, no join)."""
    grid = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in rows])
    keys = list(rows[0])
    return df.withColumn(name, F.explode(grid)).select("*", *[F.col(name)[k].alias(k) for k in keys]).drop(name)


NO_SEGMENT = -(1 << 62)


def null_free(df: DataFrame, keys: Sequence[str], seg: str | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """Columns that stand for the keys and the segment but are never NULL, so that rows can be windowed by them and
    joined back on them with plain equality: NULL keys form a key of their own, a NULL segment comes first.

    Returns the rows with the columns, their names without the segment, and with it. A column of that name would be
    lost, so it raises.
    """
    if clash := [c for c in df.columns if c in ("_s", "_nul") or c in [f"_k{j}" for j in range(len(keys))]]:
        raise ValueError(f"columns {clash} stand for keys and segments here")
    kinds, out, mask = dict(df.dtypes), {}, F.lit(0)
    if not keys:  # one key without a column: rows go by their segment alone
        return (df, [], []) if seg is None else (df.withColumn("_s", F.coalesce(F.col(seg).cast("long"), F.lit(NO_SEGMENT))), [], ["_s"])
    for j, c in enumerate(keys):
        empty = "" if kinds[c] == "string" else "1970-01-01" if kinds[c].startswith(("date", "timestamp")) else 0
        out[f"_k{j}"] = F.coalesce(F.col(c), F.lit(empty).cast(kinds[c]))
        mask = mask + F.when(F.col(c).isNull(), 1 << j).otherwise(0)
    out["_nul"] = mask
    names = list(out)
    if seg is None:
        return df.withColumns(out), names, names
    out["_s"] = F.coalesce(F.col(seg).cast("long"), F.lit(NO_SEGMENT))
    return df.withColumns(out), names, [*names, "_s"]


def segment_unless_small(df: DataFrame, keys: Sequence[str], seg: str, limit: int = 4096) -> str | None:
    """The segment column, or None where every key has at most `limit` rows: such keys are scanned whole, in one shuffle.

    Counted map-side; `df` should be cheap to read and the wider of the tables that the answer is used for.
    """
    most = df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0]
    return seg if (most or 0) > limit else None


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    seg: str | None = None,
    prev: Sequence[str] = (),
    next: Sequence[str] = (),
    sums: Mapping[str, Column] | None = None,
    row: str | None = None,
    totals: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Attach `prev_<c>`, `next_<c>`, running sums, a 1-based row number along a total order and sums over the whole key.

    `order` must be a total order within a key. With `seg` the scan is cut into segments;
    without it the caller asserts that a key is small (a clip, a recording).
    """
    keys, order, sums, totals = list(keys), list(order), dict(sums or {}), dict(totals or {})
    if row:
        sums[row] = F.lit(1)
    if seg is None:
        local = W.partitionBy(*keys).orderBy(*order)
        upto = local.rowsBetween(W.unboundedPreceding, 0)
        out = {f"prev_{c}": F.lag(c).over(local) for c in prev}
        out |= {f"next_{c}": F.lead(c).over(local) for c in next}
        out |= {k: F.sum(c).over(upto) for k, c in sums.items()}
        out |= {k: F.sum(c).over(W.partitionBy(*keys)) for k, c in totals.items()}
        return df.withColumns(out)

    df, whole, part = null_free(df, keys, seg)
    local = W.partitionBy(*part).orderBy(*order)
    upto = local.rowsBetween(W.unboundedPreceding, 0)
    edges = []
    if prev:
        edges.append(F.max(F.struct(*order, *[F.col(c).alias(f"v_{c}") for c in prev])).alias("_tail"))
    if next:
        edges.append(F.min(F.struct(*order, *[F.col(c).alias(f"v_{c}") for c in next])).alias("_head"))
    edges += [F.sum(c).alias(f"_sum_{k}") for k, c in sums.items()]
    edges += [F.sum(c).alias(f"_all_{k}") for k, c in totals.items()]
    chain = W.partitionBy(*whole).orderBy("_s")
    before = chain.rowsBetween(W.unboundedPreceding, -1)
    carry = []
    if prev:
        carry.append(F.lag("_tail").over(chain).alias("_before"))
    if next:
        carry.append(F.lead("_head").over(chain).alias("_after"))
    carry += [F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_off_{k}") for k in sums]
    carry += [F.sum(f"_all_{k}").over(W.partitionBy(*whole)).alias(k) for k in totals]
    summary = df.groupBy(*part).agg(*edges).select(*part, *carry)
    # one row per segment, which may be as many as the rows; the windows below want the rows dealt by `part` anyway
    joined = df.join(summary.hint("merge"), part)
    out = {}
    for c in prev:
        first = F.row_number().over(local) == 1
        out[f"prev_{c}"] = F.when(first, F.col("_before")[f"v_{c}"]).otherwise(F.lag(c).over(local))
    for c in next:
        last = F.lead(F.lit(True)).over(local).isNull()
        out[f"next_{c}"] = F.when(last, F.col("_after")[f"v_{c}"]).otherwise(F.lead(c).over(local))
    for k, c in sums.items():
        out[k] = F.col(f"_off_{k}") + F.sum(c).over(upto)
    drop = [c for c in ("_before", "_after") if c in joined.columns] + [f"_off_{k}" for k in sums] + part
    return joined.withColumns(out).drop(*drop)


def _place(splitters: Column, v: Column) -> Column:
    """2 * (splitters below v), and one more where v is a splitter: equal values of weight get a segment of their own.

    v is bound to a lambda's variable, or its expression would be evaluated again for every splitter.
    """
    at = lambda y: 2 * F.size(F.filter(splitters, lambda x: x < y)) + F.array_contains(splitters, y).cast("int")
    return F.transform(F.array(v), at)[0]


def _as_number(c: str, kind: str) -> Column:
    """A number that never decreases along the order of a tie column: its value, or a text's first bytes."""
    head = F.rpad(F.hex(F.substring(F.col(c).cast("binary"), 1, 6)), 12, "0")
    return F.conv(head, 16, 10).cast("double") if kind == "string" else F.col(c).cast("double")


def value_segments(df: DataFrame, keys: Sequence[str], value: str, out: str, tie: str | None = None, parts: int = 128) -> DataFrame:
    """Number slices of nearly equal row counts along a value, per key: a segment column for ranking by value.

    Splitters are quantile sketches (combined map-side), so that an outlier shifts none of them. A value that is a
    splitter itself has a slice of its own, cut again by sketched splitters of the `tie` column. Splitters are fixed
    before they are used: without keys they are at most `parts` numbers on the driver, with keys a written table of one
    row per key. NULL values have no segment.
    """
    kinds = dict(df.dtypes)
    parts = parts if not keys else 32
    probs = lambda n: F.array(*[F.lit(k / n) for k in range(1, n)])
    df, whole, _ = null_free(df, keys)
    v = F.col(value).cast("double")
    if not keys:
        found = df.agg(F.percentile_approx(v, probs(parts), 100 * parts).alias("b")).first()["b"]
        df = df.withColumn(out, _place(F.array(*[F.lit(float(x)) for x in sorted(set(found or []))]).cast("array<double>"), v))
    else:
        bounds = cut_lineage(df.groupBy(*whole).agg(F.array_distinct(F.percentile_approx(v, probs(parts), 100 * parts)).alias("_b")))
        df = df.join(bounds, whole).withColumn(out, _place(F.col("_b"), v)).drop("_b")
    if tie is None:
        return df.drop(*whole)
    t = _as_number(tie, kinds[tie])
    heavy = df.filter(F.col(out) % 2 == 1).groupBy(*whole, out).agg(F.array_distinct(F.percentile_approx(t, probs(parts), 100 * parts)).alias("_t"))
    heavy = cut_lineage(heavy)
    inner = F.coalesce(_place(F.col("_t"), t), F.lit(0))
    # at most `parts` slices per key have a row here
    df = df.join(F.broadcast(heavy) if not keys else heavy, [*whole, out], "left")
    return df.withColumn(out, F.col(out).cast("long") * (2 * parts) + inner).drop("_t", *whole)


def ranked(df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str], out: str, descending: bool = False) -> DataFrame:
    """1-based rank by a numeric value and tie columns, ascending unless told otherwise; over all rows where `keys` is empty."""
    signed = F.col(value).cast("double") * (-1 if descending else 1)
    sliced = value_segments(df.withColumn("_v", signed), keys, "_v", "_seg", ties[0] if ties else None)
    return ordered_scan(sliced, keys, ["_v", *ties], "_seg", row=out).drop("_v", "_seg")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], parts: int = 1024) -> DataFrame:
    """Exact linear-interpolation quantiles of a column per key, one output column per entry.

    Equal values are counted map-side first; ranks come from a segmented running count, and the
    two order statistics around each position are plain min aggregates. No group is collected.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_q")).agg(F.count("*").alias("_n"))
    counts, whole, _ = null_free(counts, keys)
    if not keys:
        cut = value_segments(counts.withColumn("_size", F.lit(counts.agg(F.sum("_n")).first()[0])), [], "_q", "_seg")
        placed = ordered_scan(cut, [], ["_q"], "_seg", sums={"_cum": F.col("_n")})
        return placed.agg(*_quantile_columns(probs))
    span = counts.groupBy(*whole).agg(F.min("_q").alias("_lo"), F.max("_q").alias("_hi"), F.sum("_n").alias("_size"))
    slot = F.floor((F.col("_q") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * parts)
    sliced = counts.join(span, whole).drop(*whole).withColumn("_seg", F.when(F.col("_hi") > F.col("_lo"), slot).otherwise(F.lit(0)))
    placed = ordered_scan(sliced, keys, ["_q"], "_seg", sums={"_cum": F.col("_n")})
    return placed.groupBy(*keys).agg(*_quantile_columns(probs))


def _quantile_columns(probs: Mapping[str, float]) -> list[Column]:
    aggs = []
    for name, p in probs.items():
        at = (F.col("_size") - 1) * F.lit(float(p))
        low = F.min(F.when(F.col("_cum") > F.floor(at), F.col("_q")))
        high = F.min(F.when(F.col("_cum") > F.ceil(at), F.col("_q")))
        frac = F.max(at - F.floor(at))
        aggs.append((low + (high - low) * frac).alias(name))
    return aggs


def array_quantile(ordered: str, p: float) -> Column:
    """The linear-interpolation quantile of an ascending array of numbers, as `quantiles` gives it for a column."""
    at = (F.size(ordered) - 1) * F.lit(float(p))
    low, high = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int"))
    return low + (high - low) * (at - F.floor(at))


def neighbours(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], seg: str, marked: str, cols: Sequence[str], back: str = "before", ahead: str = "after"
) -> DataFrame:
    """Attach to every row the nearest marked row at or before it and at or after it.

    `marked` is a boolean column; `back` and `ahead` become structs of (order..., cols...), NULL
    where there is none. Sorted once inside (key, segment); carries come from one row per segment.
    """
    order = list(order)
    df, whole, part = null_free(df, keys, seg)
    # a marked row without a place is nobody's neighbour, and a row without a place has none
    placed = F.col(order[0]).isNotNull()
    df = df.withColumn("_item", F.when(F.col(marked) & placed, F.struct(*order, *cols)))
    chain = W.partitionBy(*whole).orderBy("_s")
    summary = (
        df.groupBy(*part)
        .agg(F.max("_item").alias("_last"), F.min("_item").alias("_first"))
        .select(
            *part,
            F.last("_last", ignorenulls=True).over(chain.rowsBetween(W.unboundedPreceding, -1)).alias("_carry_b"),
            F.first("_first", ignorenulls=True).over(chain.rowsBetween(1, W.unboundedFollowing)).alias("_carry_a"),
        )
    )
    local = W.partitionBy(*part).orderBy(*order)
    upto = local.rowsBetween(W.unboundedPreceding, 0)
    # the look ahead runs the other way, so that both frames grow from one end
    since = W.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(W.unboundedPreceding, 0)
    return (
        df.join(summary, part)
        .withColumn(back, F.when(placed, F.coalesce(F.last("_item", ignorenulls=True).over(upto), F.col("_carry_b"))))
        .withColumn(ahead, F.when(placed, F.coalesce(F.last("_item", ignorenulls=True).over(since), F.col("_carry_a"))))
        .drop("_item", "_carry_b", "_carry_a", *part)
    )


def count_breaks(df: DataFrame, keys: Sequence[str], order: Sequence[str], seg: str, cols: Sequence[str], breaks, out: str) -> DataFrame:
    """Running count of breaks per key. `breaks(cur, prev)` says, from two dicts of columns, whether a
    new stretch starts between a row and the one before it; the first row of a key is stretch 0.

    Rows are shuffled once on (key, segment). A segment counts its inner breaks; the break between
    two segments is judged from their edge rows.
    """
    order = list(order)
    df, whole, part = null_free(df, keys, seg)
    local = W.partitionBy(*part).orderBy(*order)
    pick = lambda s: {c: F.col(s)[c] for c in cols}
    cur = {c: F.col(c) for c in cols}
    d = df.withColumn("_p", F.lag(F.struct(*cols)).over(local))
    inner = F.when(F.col("_p").isNotNull() & breaks(cur, pick("_p")), 1).otherwise(0)
    d = d.withColumn("_b", inner).withColumn("_cum", F.sum("_b").over(local.rowsBetween(W.unboundedPreceding, 0))).drop("_p")
    row = F.struct(*order, *[c for c in cols if c not in order])
    edges = d.groupBy(*part).agg(F.min(row).alias("_head"), F.max(row).alias("_tail"), F.sum("_b").alias("_n"))
    chain = W.partitionBy(*whole).orderBy("_s")
    edges = edges.withColumn("_before", F.lag("_tail").over(chain))
    edge = F.when(F.col("_before").isNotNull() & breaks(pick("_head"), pick("_before")), 1).otherwise(0)
    edges = edges.withColumn("_edge", edge)
    offset = F.sum(F.col("_n") + F.col("_edge")).over(chain.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    return d.join(edges.select(*part, offset.alias("_off")), part).withColumn(out, F.col("_off") + F.col("_cum")).drop("_b", "_cum", "_off", *part)
