"""Ward's tree against a brute-force version, subset unranking, one-scan grids, beam masks beyond 64 classes, decode by SQL."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideline.functions.tables import register
from strideline.operators import align, evaluate, nested, sequence, ward


def brute_ward(x):
    clusters = {k: [k] for k in range(len(x))}
    heights = []
    while len(clusters) > 1:
        gap = lambda a, b: 2 * len(clusters[a]) * len(clusters[b]) / (len(clusters[a]) + len(clusters[b])) * ((x[clusters[a]].mean(0) - x[clusters[b]].mean(0)) ** 2).sum()
        a, b = min(combinations(sorted(clusters), 2), key=lambda p: gap(*p))
        heights.append((gap(a, b), a, b))
        clusters[a] += clusters.pop(b)
    return heights


@pytest.mark.parametrize("seed", [1, 2])
def test_ward_matches_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(23, 3)) + rng.integers(0, 3, (23, 1)) * 4
    d = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    got = sorted((r.height, r.a, r.b) for r in ward.ward_merges(d, "id", "v").collect())
    want = sorted(brute_ward(x))
    assert [g[1:] for g in got] == [w[1:] for w in want] and [g[0] for g in got] == pytest.approx([w[0] for w in want])
    out = {r.id: r.cluster for r in ward.ward_clusters(d, "id", "v", 4).collect()}
    own = {k: [k] for k in range(23)}
    for _, a, b in want[: 23 - 4]:
        own[a] += own.pop(b)
    assert out == {k: min(c) for c in own.values() for k in c}
    assert ward.ward_merges(d.limit(1), "id", "v").count() == 0


def test_subsets_are_unranked(spark):
    for n, size in ((7, 3), (5, 5), (6, 1), (3, 4)):
        got = sorted(tuple(sorted(r.members)) for r in align.ranked_subsets(spark, n, size, 3).collect())
        assert got == sorted(combinations(range(n), size))


def test_one_scan_for_any_grid(spark):
    rng = np.random.default_rng(3)
    a, b, y = rng.normal(size=(200, 3)), rng.normal(size=(200, 3)), rng.integers(0, 3, 200)
    d = spark.createDataFrame([(p.tolist(), q.tolist(), int(t), k % 2) for k, (p, q, t) in enumerate(zip(a, b, y))], "a array<double>, b array<double>, y int, fold int")
    grid = [(w, 1 - w) for w in np.linspace(0, 1, 40)]
    out = evaluate.weight_sweep(d, ["a", "b"], grid, "y", 3)
    assert {r.setting: r.hits for r in out.collect()} == {k: int(((w * a + v * b).argmax(1) == y).sum()) for k, (w, v) in enumerate(grid)}
    per = evaluate.weight_sweep(d, ["a", "b"], grid, "y", 3, "fold").collect()
    assert len(per) == 80 and {r.n for r in per} == {100}
    assert out._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1


def test_beam_forbids_repeats_beyond_64_classes(spark):
    c = 130
    rng = np.random.default_rng(5)
    e = rng.dirichlet(np.ones(c) * 0.05, 9)
    e[1], e[4], e[6] = e[0], e[0], e[2]
    d = spark.createDataFrame([(1, k, p.tolist()) for k, p in enumerate(e)], "g long, id long, probs array<double>").withColumn("seg", F.lit(0))
    for chunk in (100, 4):
        packed = sequence.pack_sequences(d, "g", ["id"], "id", "probs", "seg", chunk)
        hard = sequence.beam_decode(packed, "g", "id", np.zeros(c), np.zeros((c, c)), 1.0, distinctness="hard", chunk=chunk)
        labels = [r.decoded for r in hard.orderBy("id").collect()]
        assert len(set(labels)) == 9 and labels[0] >= 0


def test_nested_settings_and_sql_decode(spark):
    rng = np.random.default_rng(7)
    c, rows = 3, []
    for g in range(30):
        for t in range(int(rng.integers(1, 12))):
            rows.append((g, t, len(rows), rng.dirichlet(np.ones(c)).tolist(), int(rng.integers(0, c)), g % 2))
    d = spark.createDataFrame(rows, "g long, t long, id long, probs array<double>, label int, fold int").withColumn("seg", F.lit(0))
    trans = np.log(rng.dirichlet(np.ones(c), c))
    sets = [nested.Setting(None, np.zeros(c), trans, 0.7), nested.Setting(1, np.zeros(c), trans, 0.2)]
    want = []
    for s in sets:
        path = {r.id: r.decoded for r in sequence.viterbi_decode(sequence.pack_sequences(d, "g", ["t", "id"], "id", "probs", "seg"), "g", "id", s.start, s.trans, s.weight).collect()}
        mine = [r for r in rows if s.fold is None or r[5] == s.fold]
        want.append((sum(path[r[2]] == r[4] for r in mine), len(mine)))
    for chunk in (4096, 4):
        out = nested.decode_hits(d, "g", ["t", "id"], "id", "probs", "label", "seg", sets, "fold", chunk)
        assert [(r.hits, r.n) for r in out.orderBy("setting").collect()] == want
    register(spark)
    scores = ", ".join(f"{x!r}D" for x in trans.ravel().tolist())
    got = spark.sql(f"select * from viterbi_decode(table(select * from {{d}}) partition by g order by t, 'id', 'probs', array({scores}), 0.7D)".replace("order by t,", "order by (t),"), d=d).collect()
    path = {r.id: r.decoded for r in sequence.viterbi_decode(sequence.pack_sequences(d, "g", ["t", "id"], "id", "probs", "seg"), "g", "id", np.zeros(c), trans, 0.7).collect()}
    assert {r.id: r.decoded for r in got} == path
