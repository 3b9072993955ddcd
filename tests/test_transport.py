"""Assignment under capacities against an exact solver on small tables, also when little is listed at a time."""

import numpy as np
import pytest

from strideline.operators import transport
from strideline.operators.assignment import _min_cost_rows


@pytest.mark.parametrize(("seed", "listed", "classes"), [(1, 200_000, 4), (2, 1, 4), (3, 1, 3), (4, 200_000, 6)])
def test_capacity_assignment_is_optimal(spark, monkeypatch, seed, listed, classes):
    monkeypatch.setattr(transport, "LISTED", listed)
    rng = np.random.default_rng(seed)
    n = 90
    probs = rng.dirichlet(np.ones(classes) * 0.4, n)
    probs[::7] = probs[0]  # ties
    probs[3] = np.eye(classes)[0]
    want = rng.multinomial(n, rng.dirichlet(np.ones(classes)))
    d = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(probs)] , "sample_id long, probs array<double>")
    targets = spark.createDataFrame([(c, int(w)) for c, w in enumerate(want) if w], "cls int, n_target long")
    out = transport.capacity_assignment(d, "sample_id", "probs", targets, classes)
    rows = sorted((r.sample_id, r.assigned, tuple(r._cost)) for r in out.collect())
    assert np.bincount([r[1] for r in rows], minlength=classes).tolist() == want.tolist()
    cost = np.array([r[2] for r in rows], float)
    slots = np.repeat(np.arange(classes), want)
    best = slots[_min_cost_rows(cost[:, slots])]
    assert sum(r[2][r[1]] for r in rows) == int(cost[np.arange(n), best].sum())
    assert {r.measure: r.n for r in transport.transport_certificate(out, targets, classes).collect()} == {"rows": n, "off_capacity": 0, "negative_cycles": 0, "cost_over_bound": 0}


def test_certificate_sees_a_worse_assignment(spark):
    d = spark.createDataFrame([(1, [0.9, 0.1]), (2, [0.2, 0.8])], "sample_id long, probs array<double>")
    targets = spark.createDataFrame([(0, 1), (1, 1)], "cls int, n_target long")
    from pyspark.sql import functions as F

    worse = d.select("sample_id", transport.transport_costs("probs").alias("_cost"), (F.col("sample_id") % 2).cast("int").alias("assigned"))
    found = {r.measure: r.n for r in transport.transport_certificate(worse, targets, 2).collect()}
    assert found["negative_cycles"] == 1 and found["cost_over_bound"] > 0
    with pytest.raises(ValueError, match="capacities"):
        transport.capacity_assignment(d, "sample_id", "probs", targets.limit(1), 2)


def test_missing_and_no_rows(spark):
    d = spark.createDataFrame([(1, [None, 0.5]), (2, [0.5, 0.5]), (None, [0.1, 0.9])], "sample_id long, probs array<double>")
    targets = spark.createDataFrame([(0, 1), (1, 2)], "cls int, n_target long")
    got = {r.sample_id: r.assigned for r in transport.capacity_assignment(d, "sample_id", "probs", targets, 2).collect()}
    assert got == {1: 1, 2: 0, None: 1}
    assert transport.capacity_assignment(d.limit(0), "sample_id", "probs", targets.limit(0), 2).count() == 0


def test_equal_costs_move_together(spark, monkeypatch):
    passes = []
    cut = transport.cut_lineage
    monkeypatch.setattr(transport, "LISTED", 1)
    monkeypatch.setattr(transport, "cut_lineage", lambda d: passes.append(1) or cut(d))
    kinds = [[0.7, 0.2, 0.1], [0.5, 0.3, 0.2], [0.1, 0.1, 0.8]]
    d = spark.createDataFrame([(k, kinds[k % 3]) for k in range(600)], "sample_id long, probs array<double>")
    targets = spark.createDataFrame([(0, 150), (1, 160), (2, 290)], "cls int, n_target long")
    out = transport.capacity_assignment(d, "sample_id", "probs", targets, 3)
    found = {r.measure: r.n for r in transport.transport_certificate(out, targets, 3).collect()}
    assert found == {"rows": 600, "off_capacity": 0, "negative_cycles": 0, "cost_over_bound": 0} and len(passes) <= 6
