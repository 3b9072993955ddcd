"""Extremely randomised trees against the same trees grown in memory."""

import numpy as np
import pytest

from strideline.operators import trees


def grown(x, y, fold, tree, classes, depth, tries, least, seed):
    """Nodes of one tree: (feature, threshold, left) or the class counts of a leaf, numbered level by level."""
    nodes, level, used = {}, [(0, np.arange(len(x)), 0)], 1
    while level:
        after = []
        for node, rows, deep in level:
            n = np.bincount(y[rows], minlength=classes)
            cols, share = trees.candidates(seed, fold, tree, node, x.shape[1], tries)
            lo, hi = x[rows][:, cols].min(0), x[rows][:, cols].max(0)
            nodes[node] = n / max(n.sum(), 1)
            if n.sum() < least or (n > 0).sum() < 2 or deep >= depth or not (hi > lo).any():
                continue
            cols, where = cols[hi > lo], (lo + share * (hi - lo))[hi > lo]
            gains = []
            for c, w in zip(cols, where):
                sides = [np.bincount(y[rows][(x[rows, c] > w) == s], minlength=classes) for s in (False, True)]
                gains.append(round(sum((s.astype(float) ** 2).sum() / max(s.sum(), 1) for s in sides), 9))
            i = int(np.argmax(gains))
            right = x[rows, cols[i]] > where[i]
            nodes[node] = (cols[i], where[i], used)
            after += [(used, rows[~right], deep + 1), (used + 1, rows[right], deep + 1)]
            used += 2
        level = after
    return nodes


@pytest.mark.parametrize("parts", [1, 5])
def test_forest_matches_trees_in_memory(spark, parts):
    rng = np.random.default_rng(6)
    n, dims, classes = 160, 6, 3
    y = rng.integers(0, classes, n)
    x = rng.normal(size=(n, dims)).round(3) + (y[:, None] == np.arange(dims) % classes) * 1.5
    x[:, 5] = 1.0
    fold = np.arange(n) % 3
    d = spark.createDataFrame([(k, x[k].tolist(), int(y[k]), int(fold[k])) for k in range(n)], "id long, v array<double>, y int, fold int").repartition(parts)
    how = {"depth": 4, "tries": 3, "least": 2, "seed": 9}
    forest = trees.grow_forest(d, "v", "y", "fold", 3, classes, dims, trees=4, **how)
    got = {r.id: r.probs for r in trees.forest_posteriors(d, "id", "v", "fold", forest, classes, dims).collect()}
    for f in range(3):
        mine = fold != f
        for k in np.flatnonzero(~mine)[:12]:
            want = np.zeros(classes)
            for t in range(4):
                nodes, at = grown(x[mine], y[mine], f, t, classes, **how), 0
                while isinstance(nodes[at], tuple):
                    c, w, left = nodes[at]
                    at = left + int(x[k, c] > w)
                want += nodes[at] / 4
            assert got[int(k)] == pytest.approx(want.tolist())
    assert np.mean([np.argmax(got[k]) == y[k] for k in range(n)]) > 0.5


def test_forest_without_rows(spark):
    d = spark.createDataFrame([], "id long, v array<double>, y int, fold int")
    forest = trees.grow_forest(d, "v", "y", "fold", 2, 3, 4, trees=2)
    assert (forest.feature == -1).all() and trees.forest_posteriors(d, "id", "v", "fold", forest, 3, 4).count() == 0
