"""Ranks, quantiles and AUC by sketched splitters: outliers and equal values leave no large segment, and no shuffle on a constant."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideline.operators import evaluate, sampling, scan, timeseries


def series(kind, n=4000):
    rng = random.Random(3)
    return {
        "outlier": [1e12, -1e15] + [rng.random() for _ in range(n - 2)],
        "constant": [7.0] * n,
        "mixed": [5.0 if k % 3 else rng.random() for k in range(n)],
        "nulls": [None if k % 4 == 0 else float(rng.randrange(9)) for k in range(n)],
    }[kind]


@pytest.mark.parametrize("kind", ["outlier", "constant", "mixed", "nulls"])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_ranks_by_sketched_segments(spark, kind, keys):
    rows = [(i, x, "a" if i % 5 else None) for i, x in enumerate(series(kind))]
    d = spark.createDataFrame(rows, "id long, x double, k string")
    got = {r.id: r.rank for r in scan.ranked(d, keys, "x", ["id"], "rank").collect()}
    for key in {r[2] for r in rows} if keys else [None]:
        mine = sorted((r for r in rows if not keys or r[2] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
        assert [got[r[0]] for r in mine] == list(range(1, len(mine) + 1))
    if not keys and kind != "nulls":
        sizes = scan.value_segments(d, [], "x", "seg", "id").groupBy("seg").count().agg(F.max("count")).first()[0]
        assert sizes < 0.05 * len(rows)


def test_no_exchange_on_a_constant(spark):
    d = spark.createDataFrame([(i, float(i % 7), [0.5, 0.5]) for i in range(300)], "id long, acc double, probs array<double>")
    none = d.select("id").limit(0)
    plans = [
        evaluate.subject_spread(d, "id"), evaluate.loso_summary(d, "id"), evaluate.correlation_report(d.withColumn("est", F.col("acc") + 1), "est", "acc", "id"),
        sampling.top_fraction(d, "id", "probs", 0.3, none, none), timeseries.quantile_matched_length(d, d, "id", "acc"),
    ]
    for p in plans:
        text = p._jdf.queryExecution().explainString(p.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert "_one" not in text and "hashpartitioning(0" not in text


def test_auc_of_many_ties_is_stable(spark):
    rng = np.random.default_rng(4)
    score, label = rng.integers(0, 40, 3000).astype(float), rng.integers(0, 2, 3000)
    d = spark.createDataFrame([(int(i), float(s), int(x)) for i, (s, x) in enumerate(zip(score, label))], "id long, score double, label int")
    wins = sum(((score[label == 1][:, None] > score[label == 0][None]) + 0.5 * (score[label == 1][:, None] == score[label == 0][None])).ravel())
    for keys in ([], ["k"]):
        out = evaluate.rank_auc(d.withColumn("k", F.lit("x")), keys, "score", F.col("label") == 1).first()
        assert out.auc == pytest.approx(wins / (label.sum() * (1 - label).sum()), rel=1e-12)
    with pytest.raises(ValueError, match="_s"):
        scan.ordered_scan(d.withColumnRenamed("score", "_s"), ["label"], ["_s"], "id", row="r")
