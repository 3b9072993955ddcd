"""Aligning is elsewhere; here members' posteriors are calibrated and combined.

Posteriors come as (id, member, probs array). Members are combined by one grouped aggregate of
C element-wise sums, so a fusion of any number of members is one shuffle with map-side combine.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strideline.functions import posterior as P
from strideline.operators.scan import bounded_broadcast
from strideline.session import cut_lineage


def class_prior(labels: DataFrame, label: str, n_classes: int) -> DataFrame:
    """One row holding the class shares as an array; 0 for a class never seen."""
    shares = [F.sum(F.when(F.col(label) == c, 1.0).otherwise(0.0)) / F.count(label) for c in range(n_classes)]
    return labels.agg(F.array(*shares).alias("prior"))


def literal_map(values: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def attach_row(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Add the single value of a one-row, one-column table as a column (a scalar subquery)."""
    return df.withColumn(name, one_row.scalar())


def uniform_space(post: DataFrame, prior: DataFrame | None, train_prior_members: Sequence, n_classes: int) -> DataFrame:
    """Add `_adj`: the posterior, divided by the prior for members trained under it."""
    if not train_prior_members:
        return post.withColumn("_adj", F.col("probs"))
    in_train = F.col("member").isin(list(train_prior_members))
    d = attach_row(post, prior, "_q")
    return d.withColumn("_adj", F.array(*[F.when(in_train, F.col("probs")[i] / F.col("_q")[i]).otherwise(F.col("probs")[i]) for i in range(n_classes)])).drop("_q")


def fuse_log_linear(
    post: DataFrame,
    ids: Sequence[str],
    weights: Mapping,
    n_classes: int,
    prior: DataFrame | None = None,
    prior_weight: float = 0.0,
    train_prior_members: Sequence = (),
    keep: Sequence[str] = (),
    weight: Column | None = None,
) -> DataFrame:
    """z = sum_m w_m log(p_m, divided by the prior for members trained under it) + w log prior.

    `prior` is a one-row table with an array. Returns (ids, keep, z array, probs array); `keep`
    columns are constant per id.
    """
    w = F.coalesce(literal_map({k: float(x) for k, x in weights.items()})[F.col("member")], F.lit(0.0)) if weight is None else weight
    d = uniform_space(post.withColumn("_w", w), prior, train_prior_members, n_classes).select(*ids, *[k for k in keep if k not in ids], "_w", P.safe_log("_adj", n=n_classes).alias("_l"))
    z = F.array(*[F.sum(F.col("_w") * F.col("_l")[i]) for i in range(n_classes)])
    g = d.groupBy(*ids).agg(z.alias("z"), *[F.first(k).alias(k) for k in keep])
    if prior is not None and prior_weight:
        g = attach_row(g, prior, "_q")
        lq = P.log_items("_q", n_classes)
        g = g.withColumn("z", F.array(*[F.col("z")[i] + F.lit(float(prior_weight)) * lq[i] for i in range(n_classes)])).drop("_q")
    return g.withColumn("probs", P.softmax("z", n_classes))


def bag(post: DataFrame, ids, n_classes: int, keep=()) -> DataFrame:
    """Geometric mean over members: mean of log p, then softmax."""
    d = post.withColumn("_l", P.safe_log("probs", n=n_classes))
    z = F.array(*[F.avg(F.col("_l")[i]) for i in range(n_classes)])
    return d.groupBy(*ids).agg(z.alias("z"), *[F.first(k).alias(k) for k in keep]).withColumn("probs", P.softmax("z", n_classes))


def nested_blend(post: DataFrame, ids, blocks: Mapping[object, str], block_weights: Mapping[str, float], n_classes: int, keep=()) -> DataFrame:
    """Mean of the members of each block, then the weighted sum of the blocks, in one shuffle."""
    sizes: dict[str, int] = {}
    for b in blocks.values():
        sizes[b] = sizes.get(b, 0) + 1
    share = {m: block_weights[b] / sizes[b] for m, b in blocks.items()}
    w = literal_map({k: float(x) for k, x in share.items()})[F.col("member")]
    mixed = F.array(*[F.sum(w * F.col("probs")[i]) for i in range(n_classes)])
    return post.filter(F.col("member").isin(list(blocks))).groupBy(*ids).agg(mixed.alias("probs"), *[F.first(k).alias(k) for k in keep])


def merge_weights(weights: DataFrame, moves: DataFrame, dropped: DataFrame) -> DataFrame:
    """Prune members: a dropped tag's weight goes to its survivor in the same fold, then weights sum to 1.

    weights(tag, fold, weight), moves(tag, survivor), dropped(tag). Weight with no survivor is lost.
    """
    gone = weights.join(dropped, "tag", "left_semi")
    kept = weights.join(dropped, "tag", "left_anti")
    moved = gone.join(moves, "tag").select(F.col("survivor").alias("tag"), "fold", F.col("weight").alias("_extra"))
    extra = moved.groupBy("tag", "fold").agg(F.sum("_extra").alias("_extra"))
    merged = kept.join(extra, ["tag", "fold"], "left").withColumn("weight", F.col("weight") + F.coalesce("_extra", F.lit(0.0)))
    total = merged.agg(F.sum("weight").alias("t")).scalar()
    return merged.select("tag", "fold", (F.col("weight") / total).alias("weight"))


def sinkhorn(post: DataFrame, key: str, target: DataFrame, n_classes: int, iters: int, tau: float = 1.0) -> DataFrame:
    """Alternate row and column scaling in log space so that class masses approach `target` counts.

    Only the class potentials (C numbers) change between rounds: each round is one pass over the
    posteriors with a C-wide aggregate, and nothing but C numbers comes back to the driver.
    `target` is one row with an array of counts.
    """
    want = [float(x) for x in target.first()[0]]
    if len(want) != n_classes:
        raise ValueError("target must have one count per class")
    import math

    log_target = [math.log(max(x, P.LOG_FLOOR)) for x in want]
    base = post.select(key, F.array(*[x / F.lit(float(tau)) for x in P.log_items("probs", n_classes)]).alias("_l"))
    base = cut_lineage(base)
    shift = [0.0] * n_classes
    for _ in range(iters):
        moved = [F.col("_l")[i] + F.lit(s) for i, s in enumerate(shift)]
        row = base.select(P.softmax(moved, n_classes).alias("_p"))
        mass = row.agg(*[F.sum(F.col("_p")[i]).alias(f"m{i}") for i in range(n_classes)]).first()
        shift = [shift[i] + log_target[i] - math.log(max(mass[i], 1e-300)) for i in range(n_classes)]
    moved = [F.col("_l")[i] + F.lit(s) for i, s in enumerate(shift)]
    return base.select(key, P.softmax(moved, n_classes).alias("probs"))


def largest_remainder(shares: DataFrame, total: int | Column, cls: str = "cls", share: str = "q") -> DataFrame:
    """Integer targets that sum to `total`: floors, then one more for the largest remainders.

    `shares` has one row per class, so the rank runs over C rows.
    """
    raw = F.col(share) * (F.lit(total) if isinstance(total, int) else total)
    d = shares.withColumns({"_raw": raw, "_floor": F.floor(raw)}).withColumn("_one", F.lit(0))
    w = W.partitionBy("_one")
    left = F.round(F.sum("_raw").over(w)).cast("long") - F.sum("_floor").over(w)
    rank = F.row_number().over(w.orderBy(F.round(F.col("_raw") - F.col("_floor"), 9).desc(), cls))
    return d.withColumns({"_left": left, "_rk": rank}).select(
        cls, share, (F.col("_floor") + F.when(F.col("_rk") <= F.col("_left"), 1).otherwise(0)).cast("long").alias("n_target")
    )


def temperature_grid(post: DataFrame, label: str, temps: Sequence[float], n_classes: int) -> DataFrame:
    """Mean confidence and accuracy per temperature: one pass, one row per grid point."""
    d = post.select(P.safe_log("probs", n=n_classes).alias("_l"), (P.argmax("probs", 9, n_classes) == F.col(label)).cast("double").alias("_hit"))
    # confidence at T is 1 / sum exp((l - max l) / T): one plain aggregate per grid point, no rows added
    top = P.confidence("_l", n_classes)
    d = d.withColumn("_d", F.array(*[x - top for x in P.items("_l", n_classes)]))
    conf = [F.expr(f"avg(1D / ({' + '.join(f'exp(_d[{i}] / {float(t)!r}D)' for i in range(n_classes))}))") for t in temps]
    g = d.agg(F.avg("_hit").alias("acc"), F.array(*[F.struct(F.lit(float(t)).alias("temp"), c.alias("conf")) for t, c in zip(temps, conf)]).alias("_g"))
    g = g.select("acc", F.explode("_g").alias("_g")).select("_g.temp", "_g.conf", "acc")
    return g.withColumn("gap", F.abs(F.col("conf") - F.col("acc")))


def calibration_temperature(post: DataFrame, label: str, n_classes: int, low: float = 0.05, high: float = 25.0, points: int = 33, rounds: int = 3) -> float:
    """The temperature in [low, high] at which mean confidence equals accuracy.

    Each round is one pass over the data for a whole log-spaced grid, narrowed around the best point.
    """
    import math

    best = low
    for _ in range(rounds):
        ratio = (high / low) ** (1.0 / (points - 1))
        grid = [low * ratio**i for i in range(points)]
        rows = temperature_grid(post, label, grid, n_classes).collect()  # one row per grid point
        best = min(rows, key=lambda r: (r["gap"], r["temp"]))["temp"]
        low, high = max(grid[0], best / ratio), min(grid[-1], best * ratio)
        if math.isclose(low, high):
            break
    return best


def distillation_target(post: DataFrame, ids, label: str, weights, n_classes: int, prior: DataFrame, prior_weight: float, temperature: float, train_prior_members=()) -> DataFrame:
    """Mean log p of the members that were right (the fused score where none was), tempered."""
    d = uniform_space(post, prior, train_prior_members, n_classes)
    w = literal_map({k: float(x) for k, x in weights.items()})[F.col("member")]
    d = d.withColumns({"_l": P.safe_log("_adj", n=n_classes), "_w": w, "_ok": P.argmax("probs", 9, n_classes) == F.col(label)})
    right = [F.avg(F.when(F.col("_ok"), F.col("_l")[i])) for i in range(n_classes)]
    fused = [F.sum(F.col("_w") * F.col("_l")[i]) for i in range(n_classes)]
    g = d.groupBy(*ids).agg(
        F.first(label).alias(label), F.max(F.col("_ok").cast("int")).alias("any_right"),
        F.array(*[F.coalesce(a, b) for a, b in zip(right, fused)]).alias("_z"),
    )
    lq = P.log_items("_q", n_classes)
    z = [(F.col("_z")[i] + F.lit(float(prior_weight)) * lq[i]) / F.lit(float(temperature)) for i in range(n_classes)]
    return attach_row(g, prior, "_q").withColumn("target", P.softmax(z, n_classes)).drop("_z", "_q")


def substitute_member(post: DataFrame, absent, n_classes: int) -> DataFrame:
    """Replace one member by its own mean posterior everywhere."""
    mean = post.filter(F.col("member") == absent).agg(P.vector_agg(F.avg, "probs", n_classes).alias("m"))
    d = attach_row(post, mean, "_m")
    return d.withColumn("probs", F.when(F.col("member") == absent, F.col("_m")).otherwise(F.col("probs"))).drop("_m")


def recipe_search(wide: DataFrame, base: str, members: Sequence[str], target: str, weights: Sequence[float], n_classes: int, max_members: int = 3) -> DataFrame:
    """Largest |difference| to a target table for base^(1-w) * (geometric mean of k members)^w.

    One scan whatever the grid: a task tries all member subsets and weights on its batches, and one number per recipe leaves it.
    """
    from itertools import combinations

    combos = [c for k in range(1, max_members + 1) for c in combinations(range(len(members)), k)]
    grid = [(c, float(w)) for c in combos for w in weights]

    def compare(batches):
        """Largest difference of every recipe over a batch: rows are read and their logarithms taken once."""
        for b in batches:
            if not b.num_rows:
                continue
            target, own, *logs = (b.column(k).flatten().to_numpy(zero_copy_only=False).reshape(-1, n_classes) for k in range(2 + len(members)))
            worst = []
            for combo, w in grid:
                mixed = logs[combo[0]]
                for j in combo[1:]:
                    mixed = mixed + logs[j]
                z = (1.0 - w) * own + w / len(combo) * mixed
                e = np.exp(z - z.max(axis=1, keepdims=True))
                worst.append(float(np.abs(e / e.sum(axis=1, keepdims=True) - target).max()))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(grid)), pa.int32()), pa.array(worst)], names=["_g", "d"])

    logs = wide.select(F.col(target).alias("_t"), P.safe_log(base, n=n_classes).alias("_b"), *[P.safe_log(m, n=n_classes).alias(f"_m{i}") for i, m in enumerate(members)])
    best = logs.mapInArrow(compare, "_g int, d double").groupBy("_g").agg(F.max("d").alias("max_delta"))
    names, shares = F.array(*[F.lit("+".join(members[j] for j in c)) for c, _ in grid]), F.array(*[F.lit(w) for _, w in grid])
    return best.select(names[F.col("_g")].alias("combo"), shares[F.col("_g")].alias("w"), "max_delta")


def centre_groups(vectors: DataFrame, group: str, vec: str, dim: int, train_mean: DataFrame, min_size: int = 5) -> DataFrame:
    """f - mean of its group + training mean, for groups of `min_size` rows or more."""
    means = vectors.groupBy(group).agg(F.count("*").alias("_n"), P.vector_agg(F.avg, vec, dim).alias("_mu"))
    moved = F.zip_with(F.zip_with(F.col(vec), F.col("_mu"), lambda a, b: a - b), F.col("_all"), lambda a, b: a + b)
    d = attach_row(vectors.join(means, group), train_mean, "_all")
    return d.withColumn("centred", F.when(F.col("_n") >= min_size, moved).otherwise(F.col(vec))).drop("_n", "_mu", "_all")


def class_residual(vectors: DataFrame, label: str, vec: str, dim: int, n_classes: int) -> DataFrame:
    """f - mean of its class; the class means are C rows, so their side is broadcast."""
    means = vectors.groupBy(label).agg(P.vector_agg(F.avg, vec, dim).alias("_mu"))
    return vectors.join(bounded_broadcast(means, n_classes, 8 * dim), label).withColumn(
        "residual", F.zip_with(vec, "_mu", lambda a, b: a - b)
    ).drop("_mu")


def conditioned_blend(df: DataFrame, base: str, other: str, classes: Sequence[int], inside: float, outside: float, n: int | None = None) -> DataFrame:
    """Linear blend whose weight depends on whether either arg-max lies in a class set; spelled out for `n` classes."""
    cond = P.argmax(base, 9, n).isin(list(classes)) | P.argmax(other, 9, n).isin(list(classes))
    d = df.withColumn("in_set", cond).withColumn("_w", F.when(F.col("in_set"), float(inside)).otherwise(float(outside)))
    return d.withColumn("blended", P.linear_blend(base, other, F.col("_w"), n)).drop("_w")


def masked_pool(df: DataFrame, keys, present: Column, value: str, tie: Sequence[str], k: int) -> DataFrame:
    """Mean, max and top-k mean over the present steps of each clip; 0 where none is present."""
    keys = list(keys)
    # a rank that is only compared with k is cut off before the shuffle, so a long key sends k rows from every task
    first = W.partitionBy(*keys).orderBy((-F.col(value).cast("double")).asc_nulls_last(), *tie)
    top = df.filter(present).withColumn("_rk", F.row_number().over(first)).filter(F.col("_rk") <= k)
    none = F.lit(None).cast("double")
    here = df.select(*keys, F.when(present, F.col(value).cast("double")).alias("_x"), none.alias("_top"))
    both = here.unionByName(top.select(*keys, none.alias("_x"), F.col(value).cast("double").alias("_top")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.groupBy(*keys).agg(
        zero(F.avg("_x")).alias("mean"), zero(F.max("_x")).alias("max"), zero(F.avg("_top")).alias("top_k_mean"),
        zero(F.sum(F.exp("_x") * F.col("_x")) / F.sum(F.exp("_x"))).alias("softmax_mean"),
    )


def expected_accuracy(train: DataFrame, test: DataFrame, label: str, temperature: float, seen: DataFrame, n_classes: int) -> DataFrame:
    """Mean confidence of held-out rows under the calibrated temperature, on seen and on new days, beside their
    accuracy, which the confidence stands for where labels are missing."""
    conf = P.confidence(P.softmax_items([x / float(temperature) for x in P.log_items("probs", n_classes)]), n_classes)
    tagged = test.join(seen, "day", "left").withColumn("days", F.when(F.col("_seen"), "seen").otherwise("new"))
    hit = (P.argmax("probs", 9, n_classes) == F.col(label)).cast("double")
    return tagged.groupBy("days").agg(F.count("*").alias("n"), F.avg(conf).alias("expected"), F.avg(hit).alias("accuracy"))
