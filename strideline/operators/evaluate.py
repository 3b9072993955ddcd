"""Accuracy, paired comparison, error structure and selection on scored rows.

A scored row has a subject, a label and one prediction (or several). Reports first reduce rows to
per-key counts with map-side combine; ranks and quantiles then run over those counts only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strideline.operators.scan import quantiles, ranked
from strideline.session import cut_lineage

hit = lambda pred="pred", label="label": (F.col(pred) == F.col(label)).cast("long")


def accuracy_summary(scored: DataFrame, subset: Sequence[int], pred="pred", label="label") -> DataFrame:
    """Micro accuracy, accuracy on a class subset and off it, macro (mean over classes) in one row."""
    per = scored.groupBy(label).agg(F.count("*").alias("n"), F.sum(hit(pred, label)).alias("h"))
    inside = F.col(label).isin(list(subset))
    share = lambda cond: F.sum(F.when(cond, F.col("h"))) / F.sum(F.when(cond, F.col("n")))
    return per.agg(
        F.sum("n").alias("n"), (F.sum("h") / F.sum("n")).alias("micro"), share(inside).alias("inside"), share(~inside).alias("outside"),
        F.avg(F.col("h") / F.col("n")).alias("balanced"),
    )


def per_key_accuracy(scored: DataFrame, keys: Sequence[str], pred="pred", label="label") -> DataFrame:
    return scored.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(hit(pred, label)).alias("hits")).withColumn("acc", F.col("hits") / F.col("n"))


def subject_spread(per_subject: DataFrame, subject: str, worst: int = 3) -> DataFrame:
    """One row over subject accuracies: macro, sd, worst, mean of the worst k, p10, worst quarter, macro - sd."""
    per_subject = cut_lineage(per_subject)  # read several times by the ranks
    r = ranked(per_subject, [], "acc", [subject], "_rk").withColumn("_n", per_subject.agg(F.count("*")).scalar())
    quarter = F.greatest(F.lit(1), F.floor(F.col("_n") / 4))
    stats = r.agg(
        F.count("*").alias("n_subjects"), F.avg("acc").alias("macro"), F.stddev_pop("acc").alias("sd"), F.min("acc").alias("worst"),
        F.avg(F.when(F.col("_rk") <= worst, F.col("acc"))).alias("worst_k"), F.avg(F.when(F.col("_rk") <= quarter, F.col("acc"))).alias("cvar25"),
    )
    p10 = quantiles(per_subject, [], "acc", {"p10": 0.1}).scalar()
    return stats.withColumn("p10", p10).withColumn("macro_minus_sd", F.col("macro") - F.col("sd"))


def loso_summary(per_subject: DataFrame, subject: str, draw: int = 8) -> DataFrame:
    """Leave-one-subject-out table's foot: mean, sd (n-1), SE of a draw, lower and upper quartile means."""
    per_subject = cut_lineage(per_subject)  # read several times by the ranks
    r = ranked(per_subject, [], "acc", [subject], "_rk").withColumn("_n", per_subject.agg(F.count("*")).scalar())
    q = F.ceil(F.col("_n") / 4)
    return r.agg(
        F.avg("acc").alias("mean"), F.stddev_samp("acc").alias("sd"), (F.stddev_samp("acc") / F.sqrt(F.lit(float(draw)))).alias("se_draw"),
        F.avg(F.when(F.col("_rk") <= q, F.col("acc"))).alias("lower_quartile"),
        F.avg(F.when(F.col("_rk") > F.col("_n") - q, F.col("acc"))).alias("upper_quartile"), (F.max("acc") - F.min("acc")).alias("spread"),
    )


def paired_comparison(scored: DataFrame, base: str, cand: str, label="label", keys: Sequence[str] = ()) -> DataFrame:
    """Rescues, harms, net gain and the paired standard error sd(n-1)/sqrt(n)."""
    b, c = hit(base, label), hit(cand, label)
    return scored.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.when((b == 0) & (c == 1), 1).otherwise(0)).alias("rescues"), F.sum(F.when((b == 1) & (c == 0), 1).otherwise(0)).alias("harms"),
        F.avg(c - b).alias("delta"), (F.stddev_samp(c - b) / F.sqrt(F.count("*"))).alias("se"),
    )


def fold_gate(scored: DataFrame, fold: str, base: str, cand: str, label="label") -> DataFrame:
    """Mean fold delta, its SE over folds, t, and whether the mean is positive and above 2 SE."""
    per = scored.groupBy(fold).agg((F.avg(hit(cand, label)) - F.avg(hit(base, label))).alias("d"))
    g = per.agg(F.count("*").alias("n_folds"), F.avg("d").alias("mean"), (F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("se"))
    return g.withColumn("t", F.when(F.col("se") > 0, F.col("mean") / F.col("se"))).withColumn("passed", (F.col("mean") > 2 * F.col("se")) & (F.col("mean") > 0))


def correctness_patterns(scored: DataFrame, preds: Sequence[str], fused: str, label="label") -> DataFrame:
    """Counts per bit pattern of which members are right, with how often the fusion is right on it."""
    bits = F.concat(*[F.when(F.col(p) == F.col(label), "1").otherwise("0") for p in preds])
    return scored.groupBy(bits.alias("pattern")).agg(F.count("*").alias("n"), F.sum(hit(fused, label)).alias("fused_hits"))


def complementarity(patterns: DataFrame, members: int) -> DataFrame:
    """From the patterns (2^M rows): any right, none right, and rescues only one member makes."""
    k = F.length(F.replace("pattern", F.lit("0"), F.lit("")))
    only = [F.sum(F.when((k == 1) & (F.substring("pattern", i + 1, 1) == "1"), F.col("n")).otherwise(0)).alias(f"only_{i}") for i in range(members)]
    return patterns.agg(F.sum(F.when(k > 0, F.col("n")).otherwise(0)).alias("any_right"), F.sum(F.when(k == 0, F.col("n")).otherwise(0)).alias("all_wrong"), *only)


def error_cells(scored: DataFrame, subject="subject", pred="pred", label="label", least: int = 3) -> DataFrame:
    """One row: error cells (subject, true, predicted), the repeated ones, errors inside them, and
    class pairs of a subject with `least` errors that go one way only."""
    cells = scored.filter(F.col(pred) != F.col(label)).groupBy(subject, label, pred).agg(F.count("*").alias("n"))
    a, b = F.least(label, pred), F.greatest(label, pred)
    up = F.col(label) < F.col(pred)
    pairs = cells.groupBy(subject, a.alias("a"), b.alias("b")).agg(
        F.sum(F.when(up, F.col("n")).otherwise(0)).alias("ab"), F.sum(F.when(up, 0).otherwise(F.col("n"))).alias("ba")
    ).filter(F.col("ab") + F.col("ba") >= least)
    one_way = pairs.agg(F.count("*").alias("pairs"), F.sum((F.least("ab", "ba") == 0).cast("long")).alias("one_way"))
    big = F.col("n") >= least
    total = cells.agg(
        F.count("*").alias("cells"), F.sum(big.cast("long")).alias("repeated"), F.sum(F.when(big, F.col("n")).otherwise(0)).alias("inside"), F.sum("n").alias("errors")
    )
    return total.crossJoin(one_way)  # one row each


def reference_available(scored: DataFrame, subject="subject", label="label", first="top1", second="top2", sample="sample_id") -> DataFrame:
    """For rank-2 errors: does the subject have a correct clip of the true, and of the wrong class?

    Correct clips are first reduced to (subject, class); an error row is never correct itself, so
    excluding the row itself changes nothing.
    """
    right = scored.filter(F.col(first) == F.col(label)).select(subject, F.col(label).alias("_c")).distinct()
    r2 = scored.filter((F.col(first) != F.col(label)) & (F.col(second) == F.col(label)))
    have = lambda cls, name: right.select(subject, F.col("_c").alias(cls), F.lit(1).alias(name))
    d = r2.join(have(label, "_t"), [subject, label], "left").join(have(first, "_w"), [subject, first], "left")
    return d.agg(F.count("*").alias("rank2_errors"), F.count("_t").alias("have_true"), F.count("_w").alias("have_wrong"))


def confusion(scored: DataFrame, pred="pred", label="label") -> DataFrame:
    return scored.groupBy(F.col(label).alias("truth"), F.col(pred).alias("guess")).agg(F.count("*").alias("n"))


def symmetric_pairs(conf: DataFrame) -> DataFrame:
    off = conf.filter("truth <> guess")
    return off.groupBy(F.least("truth", "guess").alias("a"), F.greatest("truth", "guess").alias("b")).agg(F.sum("n").alias("n"))


def confusion_clusters(conf: DataFrame, min_pair: int, min_support: int, max_size: int) -> DataFrame:
    """Greedy union of class pairs by weight under a size limit: (cls, cluster), clusters of two or more.

    The confusion matrix has C x C rows whatever the data, and the greedy merge is sequential by
    definition, so it runs once over that matrix in a single small group.
    """
    import pandas as pd

    support = conf.groupBy("truth").agg(F.sum("n").alias("support"))
    e = symmetric_pairs(conf).filter(F.col("n") >= min_pair)
    ok = support.filter(F.col("support") >= min_support).select(F.col("truth").alias("c"))
    e = e.join(ok.withColumnRenamed("c", "a"), "a", "left_semi").join(ok.withColumnRenamed("c", "b"), "b", "left_semi")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        home, members = {}, {}
        for r in pdf.sort_values(["n", "a", "b"], ascending=[False, True, True]).itertuples():
            ra, rb = home.setdefault(r.a, r.a), home.setdefault(r.b, r.b)
            left, right = members.setdefault(ra, {ra}), members.setdefault(rb, {rb})
            if ra == rb or len(left) + len(right) > max_size:
                continue
            for c in right:
                home[c] = ra
            left |= members.pop(rb)
        rows = [(int(c), int(min(m))) for m in members.values() if len(m) >= 2 for c in m]
        return pd.DataFrame(rows, columns=["cls", "cluster"])

    return e.groupBy(F.lit(0).alias("_g")).applyInPandas(merge, "cls int, cluster int")


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node id reachable. Stars shrink each round (large star, then
    small star), so rounds grow with the logarithm of the diameter; each round is cut by a checkpoint."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    nodes = e.select("u").union(e.select("v")).distinct()
    cur = cut_lineage(e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        # large star: every larger neighbour of u points at the least of u's neighbourhood
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour of u, and u, point at the least of them
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        before, cur = cur, cut_lineage(small)
        # edges are distinct, so the same number and none that is new is the same graph
        if before.count() == cur.count() and cur.join(before, ["u", "v"], "left_anti").isEmpty():
            break
    return nodes.join(cur.select(F.col("u"), F.col("v").alias("component")), "u", "left").select(
        F.col("u").alias("node"), F.coalesce("component", "u").alias("component")
    )


def cohort_edges(rows: DataFrame, user: str, day: str, share: float = 0.10) -> DataFrame:
    """Users linked through a day that holds at least `share` of their own rows: each user of a day
    is linked to the day's first user, so a crowded day gives one edge per user, not all pairs."""
    per = rows.groupBy(user, day).agg(F.count("*").alias("_c"))
    all_rows = per.groupBy(user).agg(F.sum("_c").alias("_t"))
    strong = per.join(all_rows, user).filter(F.col("_c") >= share * F.col("_t")).select(user, day)
    first = strong.groupBy(day).agg(F.min(user).alias("_first"))
    return strong.join(first, day).select(F.col(user).alias("a"), F.col("_first").alias("b")).distinct()


def group_purity(rows: DataFrame, group: Sequence[str], label: str) -> DataFrame:
    """Row-weighted share of each group's commonest label."""
    per = rows.groupBy(*group, label).agg(F.count("*").alias("_c"))
    best = per.groupBy(*group).agg(F.max("_c").alias("_m"), F.sum("_c").alias("_n"))
    return best.agg(F.count("*").alias("n_groups"), (F.sum("_m") / F.sum("_n")).alias("purity"))


def rank_auc(df: DataFrame, keys: Sequence[str], score: str, positive: Column) -> DataFrame:
    """Mann-Whitney AUC with average ranks on ties, per key.

    Counts per (key, score) are ranked by a segmented running sum, so a hot key is never sorted in one task.
    """
    from strideline.operators.scan import ordered_scan, value_segments

    keys = list(keys)
    cells = df.groupBy(*keys, F.col(score).cast("double").alias("_score")).agg(F.count("*").alias("_n"), F.sum(positive.cast("long")).alias("_p"))
    run = ordered_scan(value_segments(cells, keys, "_score", "_seg"), keys, ["_score"], "_seg", sums={"_cum": F.col("_n")})
    mean_rank = F.col("_cum") - (F.col("_n") - 1) / 2.0
    g = run.groupBy(*keys).agg(F.sum("_p").alias("n_pos"), F.sum(F.col("_n") - F.col("_p")).alias("n_neg"), F.sum(F.col("_p") * mean_rank).alias("_r"))
    auc = (F.col("_r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0) / (F.col("n_pos") * F.col("n_neg"))
    return g.withColumn("auc", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), auc)).drop("_r")


def correlation_report(df: DataFrame, x: str, y: str, tie: str) -> DataFrame:
    """Pearson, Spearman (average ranks) and mean absolute error of an estimate against an outcome."""
    both = df
    for c in (x, y):
        both = average_rank(both, [], c, f"_r_{c}")
    return both.agg(F.corr(x, y).alias("pearson"), F.corr(f"_r_{x}", f"_r_{y}").alias("spearman"), F.avg(F.abs(F.col(x) - F.col(y))).alias("mae"))


def average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Average rank of ties: computed on (value, count) cells, then joined back on the value."""
    from strideline.operators.scan import ordered_scan, value_segments

    keys = list(keys)
    cells = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    run = ordered_scan(value_segments(cells, keys, value, "_seg"), keys, [value], "_seg", sums={"_cum": F.col("_n")})
    ranks = run.select(*keys, value, (F.col("_cum") - (F.col("_n") - 1) / 2.0).alias(out))
    return df.join(ranks, [*keys, value])


def row_diff(a: DataFrame, b: DataFrame, key: str, pred: str, classes: Sequence[int]) -> DataFrame:
    """Changed rows, flow into and out of a class set, predictions in the set."""
    j = a.select(key, F.col(pred).alias("_a")).join(b.select(key, F.col(pred).alias("_b")), key)
    ina, inb, diff = F.col("_a").isin(list(classes)), F.col("_b").isin(list(classes)), F.col("_a") != F.col("_b")
    n = lambda c: F.sum(c.cast("long"))
    return j.agg(n(diff).alias("changed"), n(diff & inb & ~ina).alias("into"), n(diff & ina & ~inb).alias("out_of"), n(inb).alias("in_set"))


def compare_scores(a: DataFrame, b: DataFrame, key: str, probs: str, n_classes: int) -> DataFrame:
    """Two runs of the same rows: largest and mean |difference|, arg-max flips, mean row cosine."""
    from strideline.functions import posterior as P
    from strideline.functions import vectors as V

    j = a.select(key, F.col(probs).alias("_a")).join(b.select(key, F.col(probs).alias("_b")), key)
    d = F.zip_with("_a", "_b", lambda x, y: F.abs(x - y))
    return j.agg(
        F.count("*").alias("n"), F.max(F.array_max(d)).alias("max_abs"), (F.sum(P.total(d)) / (F.count("*") * n_classes)).alias("mean_abs"),
        F.sum((P.argmax("_a", 9) != P.argmax("_b", 9)).cast("long")).alias("flips"), F.avg(V.cosine("_a", "_b")).alias("mean_cosine"),
    )


def nested_selection(inner: DataFrame, fold: str, setting: Sequence[str], hits: str, ties: Mapping[str, bool]) -> DataFrame:
    """For every outer fold the setting with most hits on the other folds.

    `inner` has (fold, setting..., hits). A setting's score without a fold is its total minus that
    fold's, so every outer fold comes from one aggregate. `ties` orders equal scores: column -> ascending.
    """
    setting = list(setting)
    per = inner.groupBy(fold, *setting).agg(F.sum(hits).alias("_h"))
    total = per.groupBy(*setting).agg(F.sum("_h").alias("_t"))
    scored = per.join(total, setting).withColumn("score", F.col("_t") - F.col("_h"))
    order = [F.col("score").desc()] + [F.col(c).asc() if up else F.col(c).desc() for c, up in ties.items()]
    return scored.withColumn("_rk", F.row_number().over(W.partitionBy(fold).orderBy(*order))).filter("_rk = 1").select(fold, *setting, "score")


def lineage_gate(base: DataFrame, cand: DataFrame, key: str, min_coverage: float, min_delta: float, base_tag: str | None = None, cand_tag: str | None = None) -> DataFrame:
    """One row: does the candidate beat the baseline on exactly the same ids, or why it cannot be said.

    Both have (key, label, pred). Ids are compared by one full outer join and lineage by tag.
    """
    b = base.select(key, F.col("pred").alias("_b"), F.col("label").alias("_lb"), F.lit(1).alias("_inb"))
    c = cand.select(key, F.col("pred").alias("_c"), F.col("label").alias("_lc"), F.lit(1).alias("_inc"))
    j = b.join(c, key, "full_outer")
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    both = F.col("_inb").isNotNull() & F.col("_inc").isNotNull()
    g = j.agg(
        n(both).alias("shared"), n(F.col("_inc").isNotNull()).alias("candidates"), n(~both).alias("unmatched"), n(both & (F.col("_lb") != F.col("_lc"))).alias("label_conflicts"),
        F.avg(F.when(both, (F.col("_b") == F.col("_lc")).cast("double"))).alias("base_acc"), F.avg(F.when(both, (F.col("_c") == F.col("_lc")).cast("double"))).alias("cand_acc"),
    )
    reason = (
        F.when(F.col("unmatched") > 0, "ids differ").when(F.col("label_conflicts") > 0, "labels differ")
        .when(F.lit(base_tag != cand_tag), "lineage differs")
    )
    g = g.withColumns({"reason": reason, "coverage": F.col("shared") / F.greatest("candidates", F.lit(1)), "delta": F.col("cand_acc") - F.col("base_acc")})
    ok = F.col("reason").isNull() & (F.col("coverage") >= min_coverage) & (F.col("delta") >= min_delta)
    return g.withColumns({"available": F.col("reason").isNull(), "passed": ok})


def weight_sweep(wide: DataFrame, logits: Sequence[str], grid: Sequence[Sequence[float]], label: str, n_classes: int, fold: str | None = None) -> DataFrame:
    """Hits of every weight vector of a grid (setting, hits, n[, fold]), from one scan whatever the grid: the members sit
    side by side in a row, a task scores its batches under all settings, and only counts leave it."""
    weights = np.array([[float(x) for x in w] for w in grid])

    def count(batches):
        for b in batches:
            if not b.num_rows:
                continue
            members = [b.column(k).flatten().to_numpy(zero_copy_only=False).reshape(-1, n_classes) for k in range(len(logits))]
            truth, keys = b.column(len(logits)).to_numpy(zero_copy_only=False), b.column(len(logits) + 1).to_numpy(zero_copy_only=False)
            folds, at = np.unique(keys, return_inverse=True)
            sizes, out = np.bincount(at, minlength=len(folds)), []
            for k, w in enumerate(weights):
                z = w[0] * members[0]
                for x, m in zip(w[1:], members[1:]):
                    z = z + x * m
                hit = np.rint(z * 1e9).argmax(axis=1) == truth
                out += [(int(f), k, int(h), int(n)) for f, h, n in zip(folds, np.bincount(at[hit], minlength=len(folds)), sizes)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], names=["_f", "setting", "hits", "n"])

    d = wide.select(*logits, F.col(label).cast("long").alias("_y"), (F.col(fold).cast("long") if fold else F.lit(0).cast("long")).alias("_f"))
    seen = d.mapInArrow(count, "_f long, setting long, hits long, n long").groupBy("_f", "setting").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    keys = [F.col("_f").cast(dict(wide.dtypes)[fold]).alias(fold)] if fold else []
    return seen.select(*keys, F.col("setting").cast("int").alias("setting"), "hits", "n")
