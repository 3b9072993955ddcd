"""Recordings, runs, blocks and twins: the order structure above single clips."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.operators.scan import count_breaks, ordered_scan

RUNS_PER_SEGMENT = 4096
TIE_SECONDS = 1e-6


def run_table(rows: DataFrame, key: str, run: str, start: str, end: str, tie: str) -> DataFrame:
    """One row per run: size, first start, and the end of its last row."""
    return rows.groupBy(key, run).agg(F.count("*").alias("n"), F.min(start).alias("run_start"), F.max(F.struct(start, tie, F.col(end).alias("e")))["e"].alias("run_end"))


def blocks_of_three(runs: DataFrame, key: str, session_gap, per_segment: int = RUNS_PER_SEGMENT) -> DataFrame:
    """Greedy left-to-right triples of equally long runs within the session gap; others stand alone.

    The greedy walk is a three-state machine (how many runs the last triple still covers). Each
    segment of runs is folded for all three entry states at once, entry states are chained over
    segments, and every segment then replays its own runs: no key is gathered whole.
    Runs of a key are numbered without holes. Returns (key, run, block = first run, rep, triple).
    """
    # every run is sent to itself and to the two runs before it, so a run sees its followers in one shuffle
    roles = F.array(*[F.struct((F.col("run") - i).alias("run"), F.lit(i).alias("role")) for i in range(3)])
    sent = runs.select(key, F.explode(roles).alias("_x"), "n", "run_start", "run_end").select(key, "_x.*", "n", "run_start", "run_end")
    at = lambda i, c: F.max(F.when(F.col("role") == i, F.col(c)))
    seen = sent.groupBy(key, "run").agg(at(0, "n").alias("n0"), at(1, "n").alias("n1"), at(2, "n").alias("n2"), at(0, "run_end").alias("e0"), at(2, "run_start").alias("s2"))
    fits = (F.col("n0") == F.col("n1")) & (F.col("n0") == F.col("n2")) & (F.col("s2") - F.col("e0") < session_gap)
    d = seen.filter("n0 is not null").select(key, "run", F.floor(F.col("run") / per_segment).alias("_seg"), F.coalesce(fits, F.lit(False)).alias("ok"))
    seg = d.groupBy(key, "_seg").agg(F.sort_array(F.collect_list(F.struct("run", "ok"))).alias("a"))  # per_segment rows at most

    def walk(entry):
        """left = runs of this segment still covered by an earlier triple after each step"""
        step = lambda left, x: F.when(left > 0, left - 1).when(x["ok"], F.lit(2)).otherwise(F.lit(0))
        return F.aggregate("a", entry, step)

    maps = seg.withColumn("_map", F.array(*[walk(F.lit(s)) for s in range(3)]))
    # chain the segments of a key: one array of three small numbers per segment
    chain = maps.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_seg", "_map"))).alias("m"))
    push = lambda acc, x: F.concat(acc, F.array(x["_map"][F.element_at(acc, -1)]))
    chain = chain.withColumn("_in", F.aggregate("m", F.array(F.lit(0)), push))
    entry = chain.select(key, F.explode(F.arrays_zip(F.transform("m", lambda x: x["_seg"]).alias("s"), F.slice("_in", 1, F.size("m")).alias("e"))).alias("x"))
    entry = entry.select(key, F.col("x.s").alias("_seg"), F.col("x.e").alias("_entry"))
    replay = lambda acc, x: F.concat(acc, F.array(F.when(F.element_at(acc, -1) > 0, F.element_at(acc, -1) - 1).when(x["ok"], F.lit(2)).otherwise(F.lit(0))))
    lefts = maps.join(entry, [key, "_seg"]).withColumn("_l", F.aggregate("a", F.array(F.col("_entry")), replay))
    rows = lefts.select(key, "_seg", F.explode(F.arrays_zip(F.col("a").alias("r"), F.slice("_l", 1, F.size("a")).alias("before"))).alias("x"))
    rows = rows.select(key, F.col("x.r.run").alias("run"), F.col("x.r.ok").alias("ok"), F.col("x.before").alias("before"))
    # `before` > 0: covered by an earlier triple, as its second (2) or third (1) run
    rep = F.when(F.col("before") == 0, 0).otherwise(3 - F.col("before"))
    return rows.select(key, "run", (F.col("run") - rep).alias("block"), rep.alias("rep"), ((F.col("before") > 0) | F.col("ok")).alias("triple"))


def recording_blocks(rows: DataFrame, key: str, run: str, start: str, end: str, tie: str, session_gap) -> DataFrame:
    """`key, run, block, rep, triple` of all runs of `rows`: triples and single runs of the timed rows, and every row without
    a start as a single run of its own (its run number is its alone)."""
    timed, untimed = rows.filter(F.col(start).isNotNull()), rows.filter(F.col(start).isNull())
    blocks = blocks_of_three(run_table(timed, key, run, start, end, tie), key, session_gap)
    kinds = dict(blocks.dtypes)
    alone = untimed.select(key, *[F.col(run).cast(kinds[c]).alias(c) for c in ("run", "block")], F.lit(0).cast(kinds["rep"]).alias("rep"), F.lit(False).alias("triple"))
    return blocks.unionByName(alone)


def positional_alignment(rows: DataFrame, blocks: DataFrame, key: str, run: str, start: str, tie: str, seg: str | None = None) -> DataFrame:
    """Rows of clean triples with their position inside the run: equal (key, block, pos) rows match."""
    placed = ordered_scan(rows, [key, run], [start, tie], seg, row="pos")
    return placed.join(blocks.filter("triple").select(key, run, "block", "rep"), [key, run])


def twin_runs(recordings: DataFrame, owner: str, key: str, size: str, start: str, end: str, gap, seg: str) -> DataFrame:
    """Number maximal chains of consecutive equally sized recordings (two clips or more) closer than the gap."""
    r = recordings.filter(F.col(size) >= 2)
    apart = lambda cur, prev: (cur[size] != prev[size]) | (cur[start] - prev[end] >= gap)
    return count_breaks(r, [owner], [start, key], seg, [start, end, size], apart, "twin_run")


def ambiguous_groups(rows: DataFrame, keys: Sequence[str], start: str, tie: str, seg: str, tolerance: float = TIE_SECONDS) -> DataFrame:
    """Per group: size, and whether order is unknown (a start missing, or two within the tolerance)."""
    keys = list(keys)
    timed = rows.filter(F.col(start).isNotNull())
    d = ordered_scan(timed, keys, [start, tie], seg, prev=[start])
    close = d.groupBy(*keys).agg(F.max((F.col(start) - F.col(f"prev_{start}") <= tolerance).cast("int")).alias("_close"))
    size = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.col(start).isNull().cast("int")).alias("_missing"))
    return size.join(close, keys, "left").select(*keys, "n", ((F.coalesce("_close", F.lit(0)) == 1) | (F.col("_missing") == 1)).alias("ambiguous"))


def build_recordings(rows: DataFrame, key: str, owner: str, start: str, end: str, tie: str, chosen: str, seg: str) -> DataFrame:
    """One row per recording with a chosen clip: bounds of the chosen clips, completeness, owners, ambiguity."""
    on = lambda c: F.when(F.col(chosen), c)
    g = rows.groupBy(key).agg(
        F.min(owner).alias(owner), F.count(on(F.lit(1))).alias("n"), F.min(on(F.col(start))).alias("rec_start"), F.max(on(F.col(end))).alias("rec_end"),
        F.min(F.col(chosen).cast("int")).alias("_all"), F.count_distinct(owner).alias("n_owners"),
    )
    amb = ambiguous_groups(rows, [key], start, tie, seg).select(key, "ambiguous")
    return g.filter("n > 0").join(amb, key).withColumn("complete", F.col("_all") == 1).drop("_all")


def seen_day_share(train: DataFrame, test: DataFrame, day: str) -> DataFrame:
    """Test rows on days that occur in training, and on days that do not."""
    days = test.groupBy(day).agg(F.count("*").alias("n"))
    known = train.select(day).distinct().withColumn("_k", F.lit(True))
    d = days.join(known, day, "left").withColumn("seen", F.coalesce("_k", F.lit(False)))
    total = days.agg(F.sum("n").alias("n")).scalar()
    return d.groupBy("seen").agg(F.count("*").alias("n_days"), F.sum("n").alias("n"), (F.sum("n") / F.first(total)).alias("share"))
