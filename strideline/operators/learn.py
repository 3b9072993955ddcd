"""Learners and vector-space checks, on the built-in machine-learning library."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.functions import posterior as P
from strideline.functions import vectors as V
from strideline.operators.boosting import boosted_oof
from strideline.operators.evaluate import rank_auc
from strideline.operators.scan import bounded_broadcast, ordered_scan


def centroids(df: DataFrame, key: str, vec: str, dim: int, extra=None) -> DataFrame:
    """Mean vector per key: `dim` plain averages, combined map-side."""
    return df.groupBy(key).agg(P.vector_agg(F.avg, vec, dim).alias("centroid"), *(extra or []))


def nearest_centroid(df: DataFrame, key: str, vec: str, dim: int, n_keys: int, digits: int = 9) -> DataFrame:
    """Each row's nearest key centroid (first key on ties) and the distance to it.

    The centroids become one array (n_keys x dim numbers) beside every row; no pairs are shuffled.
    """
    table = centroids(df, key, vec, dim).agg(F.sort_array(F.collect_list(F.struct(F.col(key).cast("long").alias("k"), F.col("centroid").alias("c")))).alias("t"))
    d = df.withColumn("_t", table.scalar())
    dist = F.transform("_t", lambda s: F.struct(F.round(V.distance(F.col(vec), s["c"]), digits).alias("r"), s["k"].alias("k")))
    return d.withColumn("_best", F.array_min(dist)).withColumns({"nearest": F.col("_best.k"), "dist": F.col("_best.r")}).drop("_t", "_best")


def separability(df: DataFrame, key: str, vec: str, dim: int, n_keys: int) -> DataFrame:
    """Mean spread within a key against the median distance to the nearest other key's centroid."""
    c = df.groupBy(key).agg(P.vector_agg(F.avg, vec, dim).alias("c"), P.vector_agg(F.stddev_pop, vec, dim).alias("s"))
    within = c.select(F.explode("s").alias("s")).agg(F.avg("s").alias("within_sd"))
    table = c.agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col("c"))).alias("t"))
    others = c.withColumn("_t", table.scalar()).withColumn("_o", F.filter("_t", lambda s: s["k"] != F.col(key)))
    near = others.select(F.array_min(F.transform("_o", lambda s: V.distance(F.col("c"), s["c"]))).alias("d"))
    return near.agg(F.percentile("d", 0.5).alias("between_distance")).withColumn("within_sd", within.scalar())


def cluster_groups(df: DataFrame, group: str, vec: str, dim: int, k: int, seed: int = 7) -> DataFrame:
    """Unsupervised clusters of group mean vectors: (group, cluster)."""
    means = centroids(df, group, vec, dim).withColumn("features", array_to_vector("centroid"))
    model = BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(means)
    return model.transform(means).select(group, "cluster")


def forest_oof(df: DataFrame, features: str, label: str, fold: str, n_folds: int, n_classes: int, trees: int = 20, depth: int = 5, smooth: float = 1e-3) -> DataFrame:
    """Out-of-fold posteriors of a tree ensemble; absent classes get 0, then every row is smoothed."""
    d = df.withColumn("_f", array_to_vector(features)).withColumn("_y", F.col(label).cast("double"))
    out = None
    for f in range(n_folds):
        train, held = d.filter(F.col(fold) != f), d.filter(F.col(fold) == f)
        model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=0, featuresCol="_f", labelCol="_y").fit(train)
        p = vector_to_array(F.col("probability"))
        full = F.array(*[F.coalesce(F.get(p, F.lit(c)), F.lit(0.0)) for c in range(n_classes)])
        scored = model.transform(held).withColumn("probs", P.laplace(full, smooth, n_classes)).select(*df.columns, "probs")
        out = scored if out is None else out.unionByName(scored)
    return out


def pair_features(post: DataFrame, ids: Sequence[str], members: Sequence, n_classes: int, keep: Sequence[str] = ()) -> DataFrame:
    """One row per (sample, class): per member p, log p, rank, margin, entropy, top-1; means and votes.

    Member posteriors meet in one row per sample of plain numbers, and whatever does not depend on the class is computed
    there.
    """
    classes = range(n_classes)
    cell = lambda m, c: f"_p{m}_{c}"
    wide = post.groupBy(*ids, *keep).agg(*[F.first(F.when(F.col("member") == m, F.col("probs")[c]), ignorenulls=True).alias(cell(m, c)) for m in members for c in classes])
    # rounded and negated, so that a smaller number ranks first
    d = wide.withColumns({f"_n{m}_{c}": -F.round(cell(m, c), 9) for m in members for c in classes})
    parts = {}
    for m in members:
        p, neg = [F.col(cell(m, c)) for c in classes], [F.col(f"_n{m}_{c}") for c in classes]
        rank = [P.sum_columns([((neg[o] <= neg[c]) if o < c else (neg[o] < neg[c])).cast("int") for o in classes if o != c] or [F.lit(0)]) for c in classes]
        parts |= {f"_p{m}": F.array(*p), f"_l{m}": F.array(*[F.log(x + F.lit(1e-12)) for x in p]), f"_r{m}": F.array(*rank)}
        parts |= {f"_t{m}": F.array_max(F.array(*p)), f"_e{m}": -P.sum_columns([x * F.log(F.greatest(x, F.lit(P.LOG_FLOOR))) for x in p])}
    d = d.select(*ids, *keep, *[c.alias(n) for n, c in parts.items()])
    d = d.withColumn("cls", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))))
    at = lambda n: F.col(n)[F.col("cls")]
    out, logs, ps, votes = {}, [], [], []
    for m in members:
        p, lg, rank, top = at(f"_p{m}"), at(f"_l{m}"), at(f"_r{m}"), F.col(f"_t{m}")
        out |= {f"p_{m}": p, f"log_{m}": lg, f"rank_{m}": rank, f"margin_{m}": p - top, f"entropy_{m}": F.col(f"_e{m}"), f"top_{m}": top}
        logs.append(lg)
        ps.append(p)
        votes.append(F.when(rank == 0, 1).otherwise(0))
    out |= {"geo": P.sum_columns(logs) / len(logs), "arith": P.sum_columns(ps) / len(ps), "votes": P.sum_columns(votes)}
    return d.select(*ids, *keep, "cls", *[c.alias(n) for n, c in out.items()])


def pair_arrays(members: Sequence[np.ndarray]) -> list[np.ndarray]:
    """The columns of `pair_features`, in their order, for arrays (classes, samples) of member posteriors."""
    out, logs, votes = [], [], 0
    for p in members:
        neg = -np.rint(p * 1e9)
        rank = np.zeros(p.shape, np.int16)
        for c in range(len(p)):
            for o in range(c):
                ahead = neg[o] <= neg[c]
                rank[c] += ahead
                rank[o] += ~ahead
        log, top = np.log(p + 1e-12), p.max(axis=0)
        out += [p, log, rank, p - top, -(p * np.log(np.maximum(p, P.LOG_FLOOR))).sum(axis=0), top]
        logs.append(log)
        votes = votes + (rank == 0)
    return [*out, sum(logs) / len(logs), sum(members) / len(members), votes]


def boosted_stacker(samples: DataFrame, ids: Sequence[str], label: str, fold: str, n_folds: int, members: Sequence[str], n_classes: int, rounds: int = 10) -> DataFrame:
    """Out-of-fold stacked prediction: boosted trees score every (sample, class) row, best class wins.

    `members` are the posteriors of one row per sample; the features are those of `pair_features`.
    """
    return boosted_oof(samples, ids, label, fold, n_folds, members, n_classes, pair_arrays, rounds)


def logistic_oof(df: DataFrame, features: str, label: str, fold: str, n_folds: int, reg: float = 0.01, standardise: bool = True) -> DataFrame:
    """Standardise on the training folds, fit a logistic model, predict the held-out fold."""
    d = df.withColumn("_x", array_to_vector(features)).withColumn("_y", F.col(label).cast("double"))
    out = None
    for f in range(n_folds):
        train, held = d.filter(F.col(fold) != f), d.filter(F.col(fold) == f)
        if standardise:
            scaler = StandardScaler(withMean=True, withStd=True, inputCol="_x", outputCol="_f").fit(train)
            train, held = scaler.transform(train), scaler.transform(held)
        else:
            train, held = train.withColumn("_f", F.col("_x")), held.withColumn("_f", F.col("_x"))
        model = LogisticRegression(regParam=reg, maxIter=50, featuresCol="_f", labelCol="_y").fit(train)
        s = model.transform(held).withColumn("pred", F.col("prediction").cast("int")).withColumn("score", vector_to_array("probability")[1])
        s = s.select(*df.columns, "pred", "score")
        out = s if out is None else out.unionByName(s)
    return out


def pair_verifier(df: DataFrame, vec: str, label: str, first: str, second: str, fold: str, n_folds: int, n_classes: int, dim: int) -> DataFrame:
    """Keep rank 1 or flip to rank 2, by a logistic model on the difference of both classes' similarity
    features (cosine, -squared distance, squared cosine) to prototypes of the training subjects."""
    unit = df.withColumn("_v", V.l2_normalise(vec))
    out = None
    for f in range(n_folds):
        proto = unit.filter(F.col(fold) != f).groupBy(label).agg(P.vector_agg(F.avg, "_v", dim).alias("_p"))
        side = lambda key, name: bounded_broadcast(proto.select(F.col(label).alias(key), V.l2_normalise("_p").alias(name)), n_classes, 8 * dim)
        d = unit.join(side(first, "_pa"), first).join(side(second, "_pb"), second)

        def feats(p):
            cos = V.dot("_v", p)
            dist = V.distance("_v", p)
            return cos, -(dist * dist), cos * cos

        diff = [a - b for a, b in zip(feats("_pa"), feats("_pb"))]
        d = d.withColumn("_x", array_to_vector(F.array(*diff))).withColumn("_y", (F.col(label) == F.col(first)).cast("double"))
        train = d.filter((F.col(fold) != f) & ((F.col(label) == F.col(first)) | (F.col(label) == F.col(second))))
        model = LogisticRegression(maxIter=100, featuresCol="_x", labelCol="_y").fit(train)
        s = model.transform(d.filter(F.col(fold) == f)).withColumn("pick", F.when(F.col("prediction") == 1.0, F.col(first)).otherwise(F.col(second)))
        s = s.select(*df.columns, "pick")
        out = s if out is None else out.unionByName(s)
    return out


def subject_curve(df: DataFrame, features: str, label: str, subject: str, pool: DataFrame, test: DataFrame, sizes: Sequence[int], draws: int, seed: int = 0) -> DataFrame:
    """(k, draws, mean, sd, mean clips): accuracy of a probe trained on k seeded-random subjects."""
    d = df.withColumn("_x", array_to_vector(features)).withColumn("_y", F.col(label).cast("double"))
    held = d.join(test.select(subject), subject, "left_semi")
    out = None
    for k in sizes:
        for i in range(draws):
            order = F.sha2(F.concat_ws(":", F.lit(seed), F.lit(k), F.lit(i), F.col(subject)), 256)
            chosen = pool.select(subject).orderBy(order).limit(k)
            train = d.join(chosen, subject, "left_semi")
            scaler = StandardScaler(withMean=True, withStd=True, inputCol="_x", outputCol="_f").fit(train)
            model = LogisticRegression(regParam=0.1, maxIter=30, featuresCol="_f", labelCol="_y").fit(scaler.transform(train))
            acc = model.transform(scaler.transform(held)).agg(F.avg((F.col("prediction") == F.col("_y")).cast("double")).alias("acc"))
            row = acc.select(F.lit(k).alias("k"), F.lit(i).alias("draw"), "acc")
            out = row if out is None else out.unionByName(row)
    return out.groupBy("k").agg(F.count("*").alias("draws"), F.avg("acc").alias("mean"), F.coalesce(F.stddev_samp("acc"), F.lit(0.0)).alias("sd"))


def grouped_auc(texts: DataFrame, n_folds: int = 4) -> DataFrame:
    """(model, auc) of grouped-fold logistic scores: the signal, the same with permuted labels, and the
    confound alone. Folds are source groups, so no source is on both sides."""
    d = texts.withColumn("fold", F.pmod(F.xxhash64("source"), F.lit(n_folds)).cast("int"))
    d = d.withColumn("signal", F.array(F.log1p("n_chars"), F.pow(F.log1p("n_chars"), F.lit(2))))
    # the permutation control gives each row the label of its successor in a seeded hash order
    order = F.sha2(F.concat(F.lit("0:"), F.col("doc_id")), 256)
    slot = F.conv(F.substring(order, 1, 2), 16, 10).cast("int")
    shuffled = ordered_scan(d.withColumns({"_o": order, "_seg": slot}), [], ["_o", "doc_id"], "_seg", next=["quality"])
    d = shuffled.withColumn("permuted", F.coalesce("next_quality", F.lit(0))).drop("_o", "_seg", "next_quality")
    index = StringIndexer(inputCol="lang", outputCol="_i", stringOrderType="alphabetAsc").fit(d)
    hot = OneHotEncoder(inputCol="_i", outputCol="_h", dropLast=False).fit(index.transform(d))
    d = hot.transform(index.transform(d)).withColumn("confound", vector_to_array("_h")).drop("_i", "_h")
    out = None
    for name, feats, label in (("signal", "signal", "quality"), ("permuted", "signal", "permuted"), ("confound", "confound", "quality")):
        s = logistic_oof(d, feats, label, "fold", n_folds, standardise=False)
        a = rank_auc(s, [], "score", F.col(label) == 1).select(F.lit(name).alias("model"), "n_pos", "n_neg", "auc")
        out = a if out is None else out.unionByName(a)
    return out
