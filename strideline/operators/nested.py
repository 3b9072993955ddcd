"""Decoding under many models in one pass, and settings chosen by sources that never held the scored subjects."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strideline.operators import sequence as S


class Setting(NamedTuple):
    """A model and its weights; `fold` says which recordings it decodes (None: all)."""

    fold: int | None
    start: np.ndarray
    trans: np.ndarray
    weight: float
    start_weight: float = 0.0


def decode_hits(rows: DataFrame, group: str, order: Sequence[str], sample: str, probs: str, label: str, seg: str, settings: Sequence[Setting], fold: str | None = None, chunk: int = S.CHUNK) -> DataFrame:
    """`setting, hits, n`: right labels of every setting's exact best paths over the recordings it decodes.

    A task reads its packed recordings once and decodes them under all settings; only counts leave it. Recordings of more
    than `chunk` rows are decoded in parts, setting by setting. Without rows a setting has no row here.
    """
    d = rows.select(group, *order, sample, probs, F.col(label).cast("int").alias("_truth"), seg, (F.col(fold).cast("int") if fold else F.lit(None).cast("int")).alias("_fold"))
    c = settings[0].trans.shape[0]

    def count(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            lens, truth = np.array([len(t) for t in pdf["truths"]]), np.concatenate(list(pdf["truths"]))
            e = np.log(np.clip(np.concatenate(list(pdf["flat"])).astype(np.float64).reshape(-1, c), 1e-12, 1.0))
            folds, out = pdf["_fold"].to_numpy(), []
            for k, s in enumerate(settings):
                mine = np.full(len(lens), True) if s.fold is None else folds == s.fold
                rows = np.repeat(mine, lens)
                path = S.best_paths(e[rows], lens[mine], s.weight * s.trans, s.start_weight * s.start)
                out.append((k, int((path == truth[rows]).sum()), int(rows.sum())))
            yield pd.DataFrame(out, columns=["setting", "hits", "n"])

    size = d.groupBy(group).agg(F.count("*").alias("_size"))
    long = (size.agg(F.max("_size")).first()[0] or 0) > chunk
    sized = d.join(size, group) if long else d.filter(F.col(group).isNotNull())
    short = sized.filter(F.col("_size") <= chunk) if long else sized
    item = F.struct(*[F.col(o).alias(f"o{j}") for j, o in enumerate(order)], F.col(sample).alias("s"), F.col(probs).alias("p"), F.col("_truth").alias("t"))
    packed = short.groupBy(group, "_fold").agg(F.sort_array(F.collect_list(item)).alias("_a"))
    packed = packed.select("_fold", F.flatten(F.transform("_a", lambda r: r["p"])).alias("flat"), F.transform("_a", lambda r: r["t"]).alias("truths"))
    found = [packed.mapInPandas(count, "setting int, hits long, n long")]
    if long:
        longer = sized.filter(F.col("_size") > chunk)
        for k, s in enumerate(settings):
            mine = longer if s.fold is None else longer.filter(F.col("_fold") == s.fold)
            decoded = S.viterbi_decode(S.pack_sequences(mine, group, order, sample, probs, seg, chunk), group, sample, s.start, s.trans, s.weight, s.start_weight, chunk=chunk)
            hit = F.sum((F.col("decoded") == F.col("_truth")).cast("long"))
            found.append(mine.select(sample, "_truth").join(decoded, sample).agg(F.lit(k).alias("setting"), hit.alias("hits"), F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, found).groupBy("setting").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).filter("n > 0")


def paired_models(counts: DataFrame, fold: str, n_folds: int, n_classes: int, **how) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """(start, transition) scores without the subjects of both folds of every pair, from counts per fold: nothing is
    counted again. The pair (k, k) leaves out fold k alone. n_folds^2 * (C + 1) * C numbers come to the driver."""
    spark = counts.sparkSession
    pairs = spark.range(n_folds * n_folds).select(F.floor(F.col("id") / n_folds).cast("int").alias("_f"), (F.col("id") % n_folds).cast("int").alias("_g"))
    rest = counts.join(F.broadcast(pairs), (F.col(fold) != F.col("_f")) & (F.col(fold) != F.col("_g"))).groupBy("_f", "_g", "kind", "prev", "next").agg(F.sum("n").alias("n"))
    out: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for r in S.transition_scores(rest, n_classes, by=["_f", "_g"], **how).select("_f", "_g", "prev", "next", "score").collect():
        start, trans = out.setdefault((r["_f"], r["_g"]), (np.zeros(n_classes), np.zeros((n_classes, n_classes))))
        if r["prev"] < 0:
            start[r["next"]] = r["score"]
        else:
            trans[r["prev"], r["next"]] = r["score"]
    if len(out) < n_folds * n_folds:
        raise ValueError("no source rows are left without some pair of folds")
    return out


def nested_decoder(rows: DataFrame, models: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], group: str, order: Sequence[str], sample: str, probs: str, label: str, seg: str, fold: str,
                   n_folds: int, weights: Sequence[float], chunk: int = S.CHUNK) -> DataFrame:
    """`outer, weight, selection_hits, hits, n` per outer fold: the weight chosen on the other folds, and what it gives here.

    For outer fold f every inner fold j is decoded by the model without f and j, so that no label of f takes part in the
    choice; ties go to the smaller weight. Fold f is then decoded by the model without f under the chosen weight.
    """
    settings = [(f, j, w, Setting(j, *models[f, j], w)) for f in range(n_folds) for j in range(n_folds) for w in weights]
    seen = decode_hits(rows, group, order, sample, probs, label, seg, [s[3] for s in settings], fold, chunk)
    spark = rows.sparkSession
    names = spark.createDataFrame([(k, f, j, float(w)) for k, (f, j, w, _) in enumerate(settings)], "setting int, outer int, inner int, weight double")
    grid = seen.join(F.broadcast(names), "setting").select("outer", "inner", "weight", "hits", "n")
    grid = grid.groupBy("outer", "weight").agg(
        F.sum(F.when(F.col("outer") != F.col("inner"), F.col("hits")).otherwise(0)).alias("selection_hits"), F.sum(F.when(F.col("outer") == F.col("inner"), F.col("hits")).otherwise(0)).alias("hits"),
        F.sum(F.when(F.col("outer") == F.col("inner"), F.col("n")).otherwise(0)).alias("n"),
    )
    first = F.row_number().over(W.partitionBy("outer").orderBy(F.col("selection_hits").desc(), "weight"))
    return grid.withColumn("_r", first).filter("_r = 1").drop("_r")
