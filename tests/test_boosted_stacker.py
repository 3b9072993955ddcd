"""Boosting by histograms: the trees of the built-in learner, one pass a level for all folds, bins from all rows."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from strideline.operators import boosting as B
from strideline.operators import learn as L

CLASSES = 3
INPUTS = ["p0", "p1"]
coarse = lambda members: [np.round(x, 6) for x in L.pair_arrays(members)]


def studies(n=240, folds=3, seed=3):
    """Coarse posteriors, so that the built-in learner's bins are those of all distinct values; with equal samples."""
    rng = np.random.default_rng(seed)
    label = rng.integers(0, CLASSES, n)
    units = 1 + np.stack([np.stack([rng.multinomial(3, (np.arange(CLASSES) == y) * 0.25 + 0.25) for y in label]) for _ in INPUTS])
    p = units / units.sum(axis=2, keepdims=True)
    return [(k, p[0, k].tolist(), p[1, k].tolist(), int(label[k]), int(rng.integers(0, folds))) for k in range(n)]


def frame(spark, rows, parts=2):
    return spark.createDataFrame(rows, "id long, p0 array<double>, p1 array<double>, label int, fold int").repartition(parts)


def built_in(spark, rows, folds, rounds):
    x = [f if f.ndim == 2 else np.tile(f, (CLASSES, 1)) for f in coarse([np.array([r[1 + m] for r in rows]).T for m in range(2)])]
    pairs = [(r[0], c, r[4], float(r[3] == c), [float(f[c, k]) for f in x]) for k, r in enumerate(rows) for c in range(CLASSES)]
    d = spark.createDataFrame(pairs, "id long, cls int, fold int, y double, x array<double>").withColumn("f", array_to_vector("x")).coalesce(1)
    out = {}
    for k in range(folds):
        model = GBTClassifier(maxIter=rounds, maxDepth=4, stepSize=0.2, seed=0, featuresCol="f", labelCol="y").fit(d.filter(F.col("fold") != k))
        for r in model.transform(d.filter(F.col("fold") == k)).select("id", "cls", vector_to_array("probability")[1].alias("s")).collect():
            out[r.id] = max(out.get(r.id, (-1.0, 0)), (round(r.s, 6), -r.cls))
    return {i: -c for i, (_, c) in out.items()}


@pytest.mark.parametrize("parts, gathered, largest", [(1, B.GATHERED, B.LARGEST), (5, 1, 12)])
def test_predictions_are_those_of_the_built_in_learner(spark, parts, gathered, largest, monkeypatch):
    monkeypatch.setattr(B, "GATHERED", gathered)
    monkeypatch.setattr(B, "LARGEST", largest)
    rows = studies()
    out = B.boosted_oof(frame(spark, rows, parts), ["id"], "label", "fold", 3, INPUTS, CLASSES, coarse, rounds=4).collect()
    assert {r.id: r.pred for r in out} == built_in(spark, rows, 3, 4) and len(out) == len(rows)
    assert {r.id: (r.label, r.fold) for r in out} == {r[0]: (r[3], r[4]) for r in rows}


def test_equal_samples_follow_each_other():
    x, y = np.array([3, 1, 3, 1, 1, 2, 3]), np.array([0, 5, 0, 5, 6, 5, 0])
    for words in ([x, y], [y, x]):
        order, runs = B.distinct(words)
        assert sorted(order.tolist()) == list(range(7)) and sorted(runs.tolist()) in ([1, 1, 2, 3], [1] * 7)
        for lo, n in zip(np.cumsum(runs) - runs, runs):
            assert len({(x[i], y[i]) for i in order[lo : lo + n]}) == 1
    assert B.distinct([np.tile(x, 2), np.tile(y, 2)])[1].tolist().count(1) == 0
    assert B.distinct([np.arange(9)])[0].tolist() == list(range(9))


def test_arrays_are_the_columns_of_pair_features(spark):
    rows = [*studies(60), (60, [0.5, 0.5, 0.0], [0.1, 0.2, 0.7], 0, 0)]
    long = spark.createDataFrame([(r[0], m, r[1 + m]) for r in rows for m in range(2)], "id long, member int, probs array<double>")
    want = {(r.id, r.cls): r[2:] for r in L.pair_features(long, ["id"], [0, 1], CLASSES).collect()}
    got = L.pair_arrays([np.array([r[1 + m] for r in rows]).T for m in range(2)])
    for k, r in enumerate(rows):
        for c in range(CLASSES):
            assert want[r[0], c] == pytest.approx([float(x[c, k] if x.ndim == 2 else x[k]) for x in got], abs=1e-12)


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    run().collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_a_level_is_one_pass_for_all_folds(spark):
    run = lambda folds: lambda: L.boosted_stacker(frame(spark, studies(folds=folds)), ["id"], "label", "fold", folds, INPUTS, CLASSES, rounds=2)
    n = jobs(spark, "two-folds", run(2))
    assert n <= 2 * (2 * 4 + 4) and jobs(spark, "five-folds", run(5)) == n  # a pass is two jobs: the sums and their aggregate


def test_samples_are_never_shuffled(spark):
    out = L.boosted_stacker(spark.createDataFrame(studies(60, 2), "id long, p0 array<double>, p1 array<double>, label int, fold int"), ["id"], "label", "fold", 2, INPUTS, CLASSES, rounds=1)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def cuts_of(spark, columns, weights=None):
    """Thresholds of features given as (1, n) arrays."""
    rows = [([float(v) for v in r], i % 2, 0) for i, r in enumerate(zip(*columns))]
    d = spark.createDataFrame(rows, "x array<double>, fold int, label int").repartition(3)
    n = len(columns)
    return B.cut_points(B.stored(d, [], "label", "fold", ["x"], n), 1, n, lambda m: [m[0][i : i + 1] for i in range(n)], 32)


def test_bins_come_from_all_rows(spark):
    rng = np.random.default_rng(4)
    n = 20000
    few = rng.integers(-2, 3, n)
    near = 1.8e9 + rng.integers(0, 50000, n)  # one cell of 0.1 %
    wide = np.exp(rng.normal(size=n) * 5) * rng.choice([-1, 1], n)
    heavy = np.where(rng.random(n) < 0.5, 0.0, rng.random(n))
    cuts = cuts_of(spark, [few, near, wide, heavy, np.ones(n)])
    assert cuts[0].at.tolist() == [-1.5, -0.5, 0.5, 1.5] and not len(cuts[4].at)
    for i, x in ((1, near), (2, wide)):
        share = np.bincount(cuts[i].place(x.astype(float)), minlength=32) / n
        assert len(share) == 32 and share.min() > 0.02 and share.max() < 0.045
    assert cuts[1].bins is None and cuts[2].bins is not None
    assert 15 <= len(cuts[3].at) <= 17 and 0 < cuts[3].at[0] < 0.1
    for c, x in zip(cuts, (few, near, wide, heavy)):
        assert (c.place(x.astype(float)) == np.searchsorted(c.at, x)).all()


def test_odd_rows(spark):
    rows = studies(90, 2)
    odd = [*rows, (900, *rows[0][1:3], None, 0), (901, *rows[1][1:3], 1, None), (902, *rows[2][1:3], 2, 7)]
    run = lambda r: {x.id: x.pred for x in L.boosted_stacker(frame(spark, r), ["id"], "label", "fold", 2, INPUTS, CLASSES, rounds=2).collect()}
    got = run(odd)
    assert got.keys() == {r[0] for r in rows} | {900}  # no label: scored; no fold below 2: not scored
    unlabelled, nowhere = run([*rows, odd[-3]]), run([*rows, odd[-2]])
    assert {i: p for i, p in unlabelled.items() if i != 900} == nowhere == run(rows)
    assert run([]) == {}
    for bad in ([0.5, 0.5], [0.5, None, 0.5], [0.5, float("nan"), 0.5], None):
        with pytest.raises(Exception, match="boosting needs"):
            run([*rows, (903, bad, rows[0][2], 0, 0)])
    with pytest.raises(ValueError, match="outside fold 1"):
        run([(*r[:4], 1) for r in rows])
