"""Extremely randomised trees grown level by level, with out-of-fold posteriors.

A level takes two passes over the rows: bounds of the candidate features in every open node, then class counts on either
side of the candidates' random thresholds. A task runs its rows through the trees so far (arrays of bounded size that travel
with the job) and only sums per (fold, tree, node, candidate) are shuffled: rows are neither copied per tree nor gathered.
Candidates and thresholds come from a seeded generator per (fold, tree, node), so that results do not depend on partitions.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 4096


class Forest(NamedTuple):
    """Per (fold, tree): feature (-1: leaf), threshold, left child and class counts of every node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    counts: np.ndarray


def candidates(seed: int, fold: int, tree: int, node: int, features: int, tries: int) -> tuple[np.ndarray, np.ndarray]:
    """The features a node tries, and where between its bounds each is cut (0 to 1)."""
    rng = np.random.default_rng([seed, fold, tree, node])
    return rng.choice(features, min(tries, features), replace=False), rng.random(min(tries, features))


def route(forest: Forest, fold: int, tree: int, x: np.ndarray) -> np.ndarray:
    """The node that each row of x has come to."""
    at = np.zeros(len(x), np.int64)
    while True:
        f = forest.feature[fold, tree, at]
        go = np.flatnonzero(f >= 0)
        if not len(go):
            return at
        right = x[go, f[go]] > forest.threshold[fold, tree, at[go]]
        at[go] = forest.left[fold, tree, at[go]] + right


def gini_gain(counts: np.ndarray) -> np.ndarray:
    """Weighted purity of splits from class counts (..., side, class): the larger, the purer."""
    n = counts.sum(axis=-1)
    return (np.square(counts).sum(axis=-1) / np.maximum(n, 1)).sum(axis=-1)


def _batches(batches, dims: int):
    for big in batches:
        for lo in range(0, big.num_rows, ROWS):
            b = big.slice(lo, ROWS)
            yield b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), b.column(1).to_numpy(), b.column(2).to_numpy()


def grow_forest(rows: DataFrame, features: str, label: str, fold: str, n_folds: int, n_classes: int, dims: int, trees: int = 20, depth: int = 6, tries: int = 8, least: int = 2, seed: int = 7) -> Forest:
    """One forest per fold, from the rows of the other folds. Nodes of fewer than `least` rows, of one class, or at `depth`
    are leaves. Rows with a NULL label, fold or feature array take no part."""
    width = (1 << (depth + 1)) - 1
    shape = (n_folds, trees, width)
    forest = Forest(np.full(shape, -1), np.zeros(shape), np.zeros(shape, np.int64), np.zeros((*shape, n_classes)))
    d = rows.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("long").alias("y"), F.col(fold).cast("long").alias("f")).dropna()
    tries = min(tries, dims)
    open_ = {(f, t): {0} for f in range(n_folds) for t in range(trees)}
    used = dict.fromkeys(open_, 1)

    def tables(batches):
        """Class counts of open nodes, and bounds of their candidates."""
        for x, y, f in _batches(batches, dims):
            out = []
            for (k, t), nodes in open_.items():
                mine = f != k
                at = route(forest, k, t, x[mine]) if nodes else np.zeros(0, np.int64)
                for node in sorted(nodes.intersection(at.tolist())):
                    here = x[mine][at == node]
                    cols, _ = candidates(seed, k, t, node, dims, tries)
                    out.append((k, t, node, here[:, cols].min(0).tolist(), here[:, cols].max(0).tolist(), np.bincount(y[mine][at == node], minlength=n_classes).astype(float).tolist()))
            yield pa.RecordBatch.from_pylist([dict(zip(("f", "t", "node", "lo", "hi", "n"), o)) for o in out], schema=BOUNDS)

    while any(open_.values()):
        size = lambda c, n, agg: F.array(*[agg(F.col(c)[i]) for i in range(n)]).alias(c)
        seen = d.mapInArrow(tables, "f long, t long, node long, lo array<double>, hi array<double>, n array<double>")
        seen = seen.groupBy("f", "t", "node").agg(size("lo", tries, F.min), size("hi", tries, F.max), size("n", n_classes, F.sum)).collect()
        cuts: dict[tuple[int, int], dict[int, tuple[np.ndarray, np.ndarray]]] = {}
        for r in seen:
            n = np.array(r.n)
            forest.counts[r.f, r.t, r.node] = n
            lo, hi = np.array(r.lo), np.array(r.hi)
            cols, share = candidates(seed, r.f, r.t, r.node, dims, tries)
            level = depth_of(forest, r.f, r.t, r.node)
            if n.sum() >= least and (n > 0).sum() > 1 and level < depth and (hi > lo).any():
                cuts.setdefault((r.f, r.t), {})[r.node] = (cols[hi > lo], (lo + share * (hi - lo))[hi > lo])
        if not cuts:
            break

        def sides(batches):
            """Class counts on either side of every candidate cut."""
            for x, y, f in _batches(batches, dims):
                out = []
                for (k, t), nodes in cuts.items():
                    mine = f != k
                    own, truth = x[mine], y[mine]
                    at = route(forest, k, t, own)
                    for node, (cols, where) in nodes.items():
                        here = at == node
                        if here.any():
                            right = own[here][:, cols] > where
                            for i in range(len(cols)):
                                both = [np.bincount(truth[here][right[:, i] == s], minlength=n_classes).astype(float) for s in (False, True)]
                                out.append((k, t, node, i, np.concatenate(both).tolist()))
                yield pa.RecordBatch.from_pylist([dict(zip(("f", "t", "node", "i", "n"), o)) for o in out], schema=SIDES)

        split = d.mapInArrow(sides, "f long, t long, node long, i long, n array<double>").groupBy("f", "t", "node", "i").agg(size("n", 2 * n_classes, F.sum)).collect()
        best: dict[tuple[int, int, int], tuple[float, int]] = {}
        for r in split:
            gain = float(gini_gain(np.array(r.n).reshape(2, n_classes)))
            best[r.f, r.t, r.node] = max(best.get((r.f, r.t, r.node), (-1.0, 0)), (round(gain, 9), -r.i))
        open_ = {key: set() for key in open_}
        for (f, t, node), (_, i) in sorted(best.items()):
            cols, where = cuts[f, t][node]
            forest.feature[f, t, node], forest.threshold[f, t, node], forest.left[f, t, node] = cols[-i], where[-i], used[f, t]
            open_[f, t] |= {used[f, t], used[f, t] + 1}
            used[f, t] += 2
    return forest


def depth_of(forest: Forest, fold: int, tree: int, node: int) -> int:
    """Splits above a node: children are numbered after their parents."""
    level, left = 0, forest.left[fold, tree]
    while node:
        split = np.flatnonzero((forest.feature[fold, tree] >= 0) & ((left == node) | (left + 1 == node)))
        node, level = int(split[0]), level + 1
    return level


BOUNDS = pa.schema([("f", pa.int64()), ("t", pa.int64()), ("node", pa.int64()), *[(c, pa.list_(pa.float64())) for c in ("lo", "hi", "n")]])
SIDES = pa.schema([("f", pa.int64()), ("t", pa.int64()), ("node", pa.int64()), ("i", pa.int64()), ("n", pa.list_(pa.float64()))])


def forest_posteriors(rows: DataFrame, sample: str, features: str, fold: str, forest: Forest, n_classes: int, dims: int) -> DataFrame:
    """`sample, fold, probs`: every row's mean leaf distribution under the forest that has not seen its fold."""
    kinds = dict(rows.dtypes)

    def score(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, f = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), b.column(2).to_numpy()
            out = np.zeros((len(x), n_classes))
            for k in np.unique(f):
                mine, trees = f == k, forest.feature.shape[1]
                for t in range(trees):
                    n = forest.counts[k, t, route(forest, int(k), t, x[mine])]
                    out[mine] += n / np.maximum(n.sum(axis=1, keepdims=True), 1) / trees
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out.tolist(), pa.list_(pa.float64()))], names=[sample, fold, "probs"])

    d = rows.select(sample, F.col(features).cast("array<double>").alias("x"), F.col(fold).cast("long").alias(fold))
    return d.mapInArrow(score, f"{sample} {kinds[sample]}, {fold} long, probs array<double>")
