"""Subject-grouped fold design."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.operators.scan import ordered_scan


def round_robin_folds(rows: DataFrame, subject: str, n_folds: int, seg: Column) -> DataFrame:
    """(subject, fold): subjects in order of id, dealt in turn. `seg` slices the id order (never
    decreasing along it), so that millions of subjects are not ranked in one task."""
    d = rows.select(subject).distinct().withColumns({"_one": F.lit(0), "_seg": seg})
    return ordered_scan(d, ["_one"], [subject], "_seg", row="_rk").select(subject, ((F.col("_rk") - 1) % n_folds).cast("int").alias("fold"))


def leave_one_out_folds(rows: DataFrame, subject: str, seg: Column) -> DataFrame:
    """(subject, fold): every subject is its own fold."""
    d = rows.select(subject).distinct().withColumns({"_one": F.lit(0), "_seg": seg})
    return ordered_scan(d, ["_one"], [subject], "_seg", row="_rk").select(subject, (F.col("_rk") - 1).alias("fold"))


def subject_counts(rows: DataFrame, subject: str, label: str, n_classes: int) -> DataFrame:
    """(subject, samples, class counts array): what fold design needs, one row per subject."""
    return rows.groupBy(subject).agg(F.count("*").alias("samples"), F.array(*[F.sum((F.col(label) == c).cast("long")) for c in range(n_classes)]).alias("counts"))


def largest_gap_blocks(subjects: Sequence[int]) -> list[list[int]]:
    """Two blocks of subject ids, cut at the (first) largest gap between neighbours."""
    ids = sorted(subjects)
    gaps = [b - a for a, b in zip(ids, ids[1:])]
    if not gaps or max(gaps) <= 1:
        raise ValueError("subject ids have no gap to split at")
    cut = gaps.index(max(gaps)) + 1
    return [ids[:cut], ids[cut:]]


def balanced_folds(rows: DataFrame, subject: str, label: str, n_classes: int, n_folds: int) -> DataFrame:
    """(subject, fold) that maximises the sorted class coverage of the folds, then sample balance, then
    class balance, with each id block spread evenly over the folds.

    Rows are reduced to one count vector per subject. The search alternates over the blocks: all ways
    to deal one block to the folds are candidates of a DataFrame, scored against the other block's
    standing totals, and the best one (first in order on ties) stands for the next pass. It is made for
    the tens of subjects of a study, since candidates grow with the factorial of the block.
    """
    stats = {r[subject]: (r["samples"], list(r["counts"])) for r in subject_counts(rows, subject, label, n_classes).collect()}  # one row per subject
    blocks = largest_gap_blocks(list(stats))
    spark = rows.sparkSession
    total = [sum(stats[s][1][c] for s in stats) for c in range(n_classes)]
    capacity = []
    for b, ids in enumerate(blocks):
        q, r = divmod(len(ids), n_folds)
        capacity.append([q + (1 if (f - b) % n_folds < r else 0) for f in range(n_folds)])
    sizes = [sum(c[f] for c in capacity) for f in range(n_folds)]
    zero = [[0] * (n_classes + 1) for _ in range(n_folds)]

    def candidates(ids, caps) -> DataFrame:
        """Every dealing of `ids` as an array of folds, built subject by subject under the capacities."""
        d = spark.range(1).select(F.array().cast("array<int>").alias("a"), F.array(*[F.lit(c) for c in caps]).alias("left"))
        for i in range(len(ids)):
            d = d.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))).filter(F.col("left")[F.col("f")] > 0)
            d = d.select(F.concat("a", F.array("f")).alias("a"), F.transform("left", lambda x, j: F.when(j == F.col("f"), x - 1).otherwise(x)).alias("left"))
            if i == 2:
                d = d.repartition(spark.sparkContext.defaultParallelism * 4)
        return d.select("a")

    def totals(ids, dealt):
        out = [list(z) for z in zero]
        for s, f in zip(ids, dealt):
            n, counts = stats[s]
            out[f][n_classes] += n
            for c in range(n_classes):
                out[f][c] += counts[c]
        return out

    tables = [candidates(ids, caps) for ids, caps in zip(blocks, capacity)]

    def best(b, other):
        ids = blocks[b]
        vectors = [[*stats[s][1], stats[s][0]] for s in ids]
        # products of two counts pass 32 bits
        long = lambda x: F.lit(x).cast("long")
        cell = lambda f, c: sum_((F.when(F.col("a")[i] == f, long(vectors[i][c])).otherwise(long(0)) for i in range(len(ids))), long(other[f][c]))
        d = tables[b]
        fold = lambda f: F.array(*[cell(f, c) for c in range(n_classes + 1)])
        d = d.withColumn("t", F.array(*[fold(f) for f in range(n_folds)]))
        cover = F.sort_array(F.transform("t", lambda v: F.size(F.filter(F.slice(v, 1, n_classes), lambda x: x > 0))))
        users, n_all = sum(sizes), sum(total)
        dev = sum_((F.abs(F.col("t")[f][n_classes] * users - F.lit(sizes[f] * n_all)) for f in range(n_folds)), 0)
        cls = sum_((F.abs(F.col("t")[f][c] * n_all - F.col("t")[f][n_classes] * F.lit(total[c])) for f in range(n_folds) for c in range(n_classes)), 0)
        key = F.struct(cover.alias("cover"), (-dev).alias("dev"), (-cls).alias("cls"), F.transform("a", lambda x: -x).alias("order"))
        return d.agg(F.max(F.struct(key.alias("k"), F.col("a"))).alias("m")).select("m.a", "m.k").first()

    dealt = [None, None]
    state = [zero, zero]
    while True:  # the key of the standing dealing grows with every pass that changes it
        before = list(dealt)
        for b in (0, 1):
            dealt[b] = list(best(b, state[1 - b])["a"])
            state[b] = totals(blocks[b], dealt[b])
        if dealt == before:
            break
    rows_out = [(int(s), int(f)) for ids, d in zip(blocks, dealt) for s, f in zip(ids, d)]
    return spark.createDataFrame(rows_out, f"{subject} long, fold int")


def sum_(items, start):
    out = start if isinstance(start, Column) else F.lit(start)
    for x in items:
        out = out + x
    return out


def fold_quality(rows: DataFrame, folds: DataFrame, subject: str, label: str) -> DataFrame:
    """Per fold: subjects, samples and classes covered."""
    return rows.join(folds, subject).groupBy("fold").agg(F.count_distinct(subject).alias("n_subjects"), F.count("*").alias("n"), F.count_distinct(label).alias("n_classes"))
