import numpy as np

from strideline.operators import learn as L


def test_pair_features_rank_ties_by_class_and_aggregate_plain_numbers(spark):
    rows = [(1, 0, [0.2, 0.5, 0.3]), (1, 1, [0.4, 0.4, 0.2]), (2, 0, [1.0, 0.0, 0.0]), (2, 1, [0.1, 0.1, 0.8])]
    d = L.pair_features(spark.createDataFrame(rows, "id long, member int, probs array<double>"), ["id"], [0, 1], 3)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    got = {(r.id, r.cls): r for r in d.collect()}
    assert len(got) == 6
    for i, m, p in rows:
        order = np.argsort(-np.array(p), kind="stable").tolist()
        for c in range(3):
            r = got[i, c]
            assert r[f"p_{m}"] == p[c] and r[f"rank_{m}"] == order.index(c) and r[f"margin_{m}"] == p[c] - max(p) and r[f"top_{m}"] == max(p)
            assert abs(r[f"entropy_{m}"] + sum(x * np.log(max(x, 1e-12)) for x in p)) < 1e-12
    assert [got[1, c].votes for c in range(3)] == [1, 1, 0] and abs(got[2, 2].arith - 0.4) < 1e-12
