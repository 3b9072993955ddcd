"""Top-k reports, pseudo-label selection, seeded sampling and balanced batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.functions import posterior as P
from strideline.operators.scan import ordered_scan, ranked
from strideline.session import cut_lineage

DIGITS = 9


def seeded_hash(seed, *cols):
    """sha256 of seed:key..., the sort key of every deterministic shuffle."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in cols]), 256)


def hash_segment(h, digits: int = 3):
    """The leading hex digits of a hash as a number: slices a seeded order evenly."""
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("int")


def seeded_rank(df: DataFrame, keys: Sequence[str], seed, by: Sequence[str], out: str) -> DataFrame:
    """1-based place of every row in its key's seeded random order."""
    d = df.withColumn("_h", seeded_hash(seed, *by)).withColumn("_seg", hash_segment(F.col("_h")))
    return ordered_scan(d, keys, ["_h", *by], "_seg", row=out).drop("_h", "_seg")


def top_k_accuracy(post: DataFrame, key: str, label: str, ks: Sequence[int], n_classes: int) -> DataFrame:
    """(k, member accuracy..., any member): one pass; only counts are shuffled."""
    d = post.select(key, "member", F.col(label).cast("int").alias("_l"), *[F.rint(x * 10.0**DIGITS).alias(f"_p{i}") for i, x in enumerate(P.items("probs", n_classes))])
    xs, own = [F.col(f"_p{i}") for i in range(n_classes)], F.lit(None).cast("double")
    for i, x in enumerate(xs):
        own = F.when(F.col("_l") == i, x).otherwise(own)
    per = d.withColumn("_own", own).select(key, "member", P.place_of(xs, F.col("_own"), "_l").alias("place"))
    one = per.groupBy("member").agg(*[F.avg((F.col("place") <= k).cast("double")).alias(f"top_{k}") for k in ks]).withColumn("member", F.col("member").cast("string"))
    best = per.groupBy(key).agg(F.min("place").alias("place"))
    both = best.agg(*[F.avg((F.col("place") <= k).cast("double")).alias(f"top_{k}") for k in ks]).select(F.lit("any").alias("member"), *[f"top_{k}" for k in ks])
    return one.unionByName(both)


def top_fraction(post: DataFrame, key: str, probs: str, fraction: float, excluded: DataFrame, labelled: DataFrame, n: int | None = None) -> DataFrame:
    """The most confident share of the rows that are neither evaluation rows nor labelled already. Ranking reads the pool
    several times, so its confidences are worked out once and written."""
    pool = post.select(key, F.round(P.confidence(probs, n), DIGITS).alias("conf"), P.argmax(probs, DIGITS, n).alias("pseudo_label"))
    pool = cut_lineage(pool.join(excluded.select(key), key, "left_anti").join(labelled.select(key), key, "left_anti"))
    r = ranked(pool, [], "conf", [key], "_rk", descending=True).withColumn("_n", pool.agg(F.count("*")).scalar())
    return r.filter(F.col("_rk") <= F.greatest(F.lit(1), F.floor(F.lit(fraction) * F.col("_n")))).select(key, "conf", "pseudo_label")


def confident_by_subject(post: DataFrame, subject: str, probs: str, label: str, tau: float, least: int) -> DataFrame:
    """Per subject with enough rows at or above tau: how many, and how often the pseudo-label is right."""
    d = post.filter(F.round(P.confidence(probs), DIGITS) >= tau)
    ok = (P.argmax(probs, DIGITS) == F.col(label)).cast("double")
    return d.groupBy(subject).agg(F.count("*").alias("n"), F.avg(ok).alias("acc")).filter(F.col("n") >= least)


def inverse_frequency_weights(df: DataFrame, label: str) -> DataFrame:
    """Each row's share of one draw: 1 / (classes * rows of its class)."""
    per = df.groupBy(label).agg(F.count("*").alias("_n"))
    k = per.agg(F.count("*").alias("k")).scalar()
    return df.join(per.withColumn("weight", 1.0 / (F.col("_n") * k)).drop("_n"), label)


def weighted_replicates(weighted: DataFrame, key: str, draws: int | None, seed: int) -> DataFrame:
    """Sampling with replacement as independent Poisson copies per row (mean weight * draws).

    Copies depend on the row's seeded hash only, so a lost task repeats the same sample.
    """
    total = weighted.agg(F.count("*").alias("n")).scalar() if draws is None else F.lit(draws)
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    d = weighted.withColumn("_m", F.col("weight") * total).withColumn("_u", u)
    # inverse of the Poisson distribution function, walked upwards until it passes u
    span = (F.ceil(F.col("_m") + 12 * F.sqrt(F.col("_m"))) + 20).cast("int")
    start = F.struct(F.lit(0).alias("k"), F.exp(-F.col("_m")).alias("p"), F.exp(-F.col("_m")).alias("c"))

    def step(s, i):
        p = s["p"] * F.col("_m") / i
        more = F.col("_u") > s["c"]
        return F.struct(F.when(more, i).otherwise(s["k"]).alias("k"), p.alias("p"), (s["c"] + p).alias("c"))

    k = F.aggregate(F.sequence(F.lit(1), span), start, step)["k"]
    return d.withColumn("copies", k).drop("_m", "_u")


def cap_per_class(df: DataFrame, label: str, key: str, k: int, seed) -> DataFrame:
    return seeded_rank(df, [label], seed, [key], "_rk").filter(F.col("_rk") <= k).drop("_rk")


def balanced_batches(df: DataFrame, label: str, user: str, key: str, classes: int, per_class: int, seed) -> DataFrame:
    """(key, label, user, batch): every batch holds `classes` classes with `per_class` rows each, taken
    over subjects in turn, and the classes used least so far come first.

    Rows are put in rounds: the r-th row of each subject of a class belongs to round r, rounds are laid
    end to end, and consecutive `per_class` rows form a unit of the class. A unit's rows come from
    different subjects while the class has that many left in the round; the first two are made distinct
    by dropping back units of one subject. Units are dealt to batches round by round over the classes.
    """
    eligible = df.groupBy(label, user).agg(F.count("*").alias("_c")).groupBy(label).agg(F.count("*").alias("_u")).filter("_u >= 2").select(label)
    d = df.select(key, label, user).join(eligible, label, "left_semi")
    d = seeded_rank(d, [label, user], seed, [key], "_round")
    # order inside a class: round first, then a seeded order of subjects; segments are blocks of rounds
    d = d.withColumn("_h", seeded_hash(seed, user)).withColumn("_seg", F.floor(F.col("_round") / 64))
    d = ordered_scan(d, [label], ["_round", "_h", user, key], "_seg", row="_place").drop("_h")
    d = d.withColumn("unit", F.floor((F.col("_place") - 1) / per_class))
    units = d.groupBy(label, "unit").agg(F.count("*").alias("_n"), F.count_distinct(user).alias("_users")).filter((F.col("_n") == per_class) & (F.col("_users") >= 2))
    units = units.withColumn("_seg", F.floor(F.col("unit") / 4096))
    units = ordered_scan(units, [label], ["unit"], "_seg", row="_turn").select(label, "unit", "_turn")
    # deal: the t-th unit of every class, classes in seeded order, fills batches of `classes` units
    units = units.withColumns({"_one": F.lit(0), "_seg": F.floor(F.col("_turn") / 256), "_h": seeded_hash(seed, "_turn", label)})
    units = ordered_scan(units, ["_one"], ["_turn", "_h", label], "_seg", row="_n")
    units = units.withColumn("batch", F.floor((F.col("_n") - 1) / classes)).select(label, "unit", "batch")
    full = units.groupBy("batch").agg(F.count_distinct(label).alias("_c")).filter(F.col("_c") == classes).select("batch")
    return d.join(units.join(full, "batch", "left_semi"), [label, "unit"]).select(key, label, user, "batch")


def covering_batches(df: DataFrame, label: str, user: str, key: str, classes: int, per_class: int, seed) -> DataFrame:
    """(key, label, user, batch): batches of `classes` classes with `per_class` rows each that hold every row of the
    classes with two subjects or more. Rows of a scarce class are repeated, all of a class equally often within one
    (but for a subject with most of the class, see below).

    A class of n rows needs n / per_class units, or more if one subject has nearly all of it: a unit takes at most
    per_class - 1 rows of it. Batches are as few as all units fit into, at most one of a class in a batch; units left
    over go to the classes used least. A class's rows lie subject by subject in its slots, and slot s belongs to unit
    s modulo the units, so that a subject meets a unit as seldom as possible and a row never meets a unit twice
    unless the class has fewer than per_class rows. Units lie class by class, and unit u belongs to batch u modulo
    the batches; batches are numbered in a seeded order.
    """
    if per_class < 2:
        raise ValueError("per_class must be at least 2")
    d = df.select(key, label, user).filter(F.col(label).isNotNull())
    users = d.groupBy(label, user).agg(F.count("*").alias("_c"))
    per = users.groupBy(label).agg(F.sum("_c").alias("n"), F.max("_c").alias("m"), F.count("*").alias("u")).filter("u >= 2")
    rows = sorted((r[label], r["n"], r["m"]) for r in per.collect())  # one row per class
    if len(rows) < classes:
        raise ValueError(f"{len(rows)} classes have two subjects; a batch needs {classes}")
    least = [max(-(-n // per_class), -(-m // (per_class - 1))) for _, n, m in rows]
    batches = max(max(least), -(-sum(least) // classes))
    turns = _shared_turns(least, batches, classes)
    first = [sum(turns[:k]) for k in range(len(turns))]
    # a subject with more than its share of the slots gets per_class - 1 of a unit, the others one
    plan = [(c, n, m, per_class * m > (per_class - 1) * n, v, f) for (c, n, m), v, f in zip(rows, turns, first)]
    kind = users.schema[label].dataType.simpleString()
    plan = F.broadcast(df.sparkSession.createDataFrame(plan, f"_label {kind}, _n long, _m long, _hot boolean, _v long, _f long"))

    users = users.join(plan, F.col(label) == F.col("_label")).withColumn("_most", F.col("_hot") & (F.col("_c") == F.col("_m")))
    users = users.withColumn("_h", seeded_hash(seed, user)).withColumn("_s1", hash_segment(F.col("_h")))
    users = ordered_scan(users, [label, "_most"], ["_h", user], "_s1", sums={"_upto": F.col("_c")})
    users = users.select(F.col(label).alias("_label"), F.col(user).alias("_user"), "_n", "_m", "_hot", "_most", "_v", "_f", (F.col("_upto") - F.col("_c")).alias("_before"))
    d = seeded_rank(d, [label, user], seed, [key], "_place")
    d = d.join(users, (F.col(label) == F.col("_label")) & F.col(user).eqNullSafe(F.col("_user")))
    of = F.when(~F.col("_hot"), F.col("_n")).when(F.col("_most"), F.col("_m")).otherwise(F.col("_n") - F.col("_m"))
    slots = F.col("_v") * F.when(~F.col("_hot"), per_class).when(F.col("_most"), per_class - 1).otherwise(1)
    start = F.when(F.col("_hot") & ~F.col("_most"), F.col("_v") * (per_class - 1)).otherwise(0)
    d = d.withColumns({"_i": F.col("_before") + F.col("_place") - 1, "_of": of, "_slots": slots, "_start": start})
    # whole numbers throughout: i * slots stays below 2^63 up to some 10^9 rows of a class
    at = lambda i: F.col("_start") + F.expr(f"({i} * _slots) div _of")
    d = d.select(key, label, user, "_v", "_f", F.explode(F.sequence(at("_i"), at("(_i + 1)") - 1)).alias("_slot"))
    d = d.withColumn("_b", F.pmod(F.col("_f") + F.pmod("_slot", "_v"), F.lit(batches)))
    order = df.sparkSession.range(batches).select(F.col("id").alias("_b"), F.lit(0).alias("_one"))
    order = seeded_rank(order, ["_one"], seed, ["_b"], "_rank").select("_b", (F.col("_rank") - 1).cast("long").alias("batch"))
    return d.join(order, "_b").select(key, label, user, "batch")


def _shared_turns(least: Sequence[int], batches: int, classes: int) -> list[int]:
    """Units per class, `batches * classes` in all: at least `least`, at most one a batch, the rest to the classes with fewest."""
    lo, hi = 0, batches
    total = lambda level: sum(max(n, level) for n in least)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if total(mid) <= batches * classes else (lo, mid - 1)
    out, left = [max(n, lo) for n in least], batches * classes - total(lo)
    for k, n in enumerate(out):
        if left and n == lo and lo < batches:
            out[k], left = n + 1, left - 1
    return out


def cross_subject_pair_counts(df: DataFrame, label: str, user: str) -> DataFrame:
    """Same-class pairs of different subjects per class, and rows that have a partner: from counts."""
    per = df.groupBy(label, user).agg(F.count("*").alias("_c"))
    g = per.groupBy(label).agg(F.sum("_c").alias("_n"), F.sum(F.col("_c") * F.col("_c")).alias("_sq"), F.count("*").alias("_users"))
    return g.select(label, ((F.col("_n") * F.col("_n") - F.col("_sq")) / 2).cast("long").alias("n_pairs"), F.when(F.col("_users") > 1, F.col("_n")).otherwise(0).alias("rows_with_partner"))


def batch_positive_pairs(batches: DataFrame, key: str, label: str, user: str) -> DataFrame:
    """The positive pairs inside batches: same batch and class, different subject. A class holds a fixed
    number of rows in a batch, so a row meets at most that many partners."""
    a = batches.select("batch", label, F.col(key).alias("a"), F.col(user).alias("user_a"))
    b = batches.select("batch", label, F.col(key).alias("b"), F.col(user).alias("user_b"))
    return a.join(b, ["batch", label]).filter((F.col("a") < F.col("b")) & (F.col("user_a") != F.col("user_b")))


def md5_split(df: DataFrame, key: str, parts: int = 4) -> DataFrame:
    """Held-out flag: md5(id) as a number, modulo the parts (a power of two), equals 0."""
    if parts & (parts - 1):
        raise ValueError("parts must be a power of two: only the last hex digits are read")
    tail = F.conv(F.substring(F.md5(F.col(key).cast("string")), 25, 8), 16, 10).cast("long")
    return df.withColumn("held_out", F.pmod(tail, F.lit(parts)) == 0)
