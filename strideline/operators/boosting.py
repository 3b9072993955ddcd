"""Gradient boosting of (sample, class) rows by histograms, out of fold.

A sample is one row with its arrays per class, so its (sample, class) rows never part and nothing of a sample is shuffled.
Samples are read once, to be stored in blocks, which are passed over to count the features' values, to store bin numbers and
to score. In between a level of the trees of all folds is one pass over the bin numbers, and only sums per (fold, node,
feature, bin) are shuffled. A task finds a row's residual by running it through the trees so far, which travel with the job.
Of two siblings the smaller one is counted and the other is the rest of the parent. Samples that are equal and met together
are worked out once and weigh as many as they are. Residuals are summed as whole numbers, so that results do not depend on
partitions.

The trees are those of the built-in boosted classifier: residuals of 2 log(1 + exp(-2 y F)) with y = -1 or 1, splits by
variance, a leaf's mean, the first tree at full weight. Bins are cut at quantiles of all rows, not of a sample.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.session import cut_lineage

SHIFTS = (42, 22)  # a value's cell is its key without that many low bits: 0.1 % of it; crowded cells are divided by the next
CELL_BITS = 12  # bits of the bin numbers that are counted together
NONE = np.iinfo(np.int64).min  # stands for NULL
UNIT = 1 << 24  # residuals are multiples of 1 / UNIT; their sums are exact below 2 ** 29
CELLS = pa.schema([("f", pa.int32()), *[(c, pa.int64()) for c in ("cell", "n", "lo", "hi")]])
GATHERED = 1 << 20  # numbers of samples that are searched for equal ones together
LARGEST = 1 << 15  # (sample, class) rows of a block
BLOCK = T.StructType([T.StructField("fold", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in ("block", "own", "weight")]])
SUMS = pa.schema([("slot", pa.int64()), ("n", pa.float64()), ("g", pa.float64())])


class Packing(NamedTuple):
    """Where a feature's bin number lies in a block: row, shift and mask per feature (row -1: constant, never split)."""

    row: list[int]
    shift: list[int]
    bits: list[int]
    used: list[int]


def keys(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the numbers x."""
    v = (x + 0.0).view(np.int64)
    return v ^ ((v >> 63) & np.int64(2**63 - 1))


def numbers(key: np.ndarray) -> np.ndarray:
    """The numbers of keys."""
    return (key ^ ((key >> 63) & np.int64(2**63 - 1))).view(np.float64)


class _Cells:
    """Rows per cell, and the cell's smallest and largest key."""

    def __init__(self):
        self.parts: list[np.ndarray] = []  # columns: cell, rows, smallest, largest
        self.size = 0

    def add(self, x: np.ndarray, shift: int, weight: np.ndarray | int) -> None:
        """Count numbers that are in order, with their weights or one for all."""
        key = keys(x)
        cell = key >> shift
        ends = np.append(np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell))
        starts = np.append(0, ends[:-1])
        n = (ends - starts) * weight if isinstance(weight, int) else np.add.reduceat(weight, starts)
        self.parts.append(np.stack([cell[starts], n, key[starts], key[ends - 1]]))
        self.size += len(ends)
        if self.size > 1 << 16 and len(self.parts) > 1:
            self.parts = [self.met()]
            self.size = self.parts[0].shape[1] // 2  # so that a table that stays large is not merged every time

    def met(self) -> np.ndarray:
        whole = np.concatenate(self.parts, axis=1)
        whole = whole[:, np.argsort(whole[0], kind="stable")]
        starts = np.append(0, np.flatnonzero(whole[0, 1:] != whole[0, :-1]) + 1)
        return np.stack([whole[0, starts], np.add.reduceat(whole[1], starts), np.minimum.reduceat(whole[2], starts), np.maximum.reduceat(whole[3], starts)])


class Cuts(NamedTuple):
    """A feature's thresholds, and the bin of every undivided cell from `lo` on (None if some cells are divided)."""

    at: np.ndarray
    lo: int
    bins: np.ndarray | None

    def place(self, x: np.ndarray) -> np.ndarray:
        """The bins of numbers that have been counted."""
        if self.bins is None:
            return np.searchsorted(self.at, x)
        return self.bins.take((keys(x) >> SHIFTS[0]) - self.lo)


def thresholds(first: np.ndarray, last: np.ndarray, n: np.ndarray, bins: int) -> np.ndarray:
    """At most bins - 1 numbers between cells in order (keys first to last, n rows each), next to the quantiles."""
    total = np.cumsum(n)
    if len(n) <= bins:
        cut = np.arange(len(n) - 1)
    else:
        want = total[-1] * np.arange(1, bins) / bins
        at = np.searchsorted(total, want)
        under = np.where(at > 0, total[at - 1], 0)
        at = np.where((at > 0) & (want - under <= total[at] - want), at - 1, at)
        cut = np.unique(at[at < len(n) - 1])
    a, b = numbers(last[cut]), numbers(first[cut + 1])
    mid = a / 2 + b / 2
    return np.where((a <= mid) & (mid < b), mid, a)


def packing(sizes: Sequence[int]) -> Packing:
    """Bin numbers side by side in rows of CELL_BITS bits, the widest first."""
    row, shift, bits, used = [-1] * len(sizes), [0] * len(sizes), [(s - 1).bit_length() for s in sizes], []
    for f in sorted((f for f in range(len(sizes)) if bits[f]), key=lambda f: (-bits[f], f)):
        at = next((g for g, b in enumerate(used) if b + bits[f] <= CELL_BITS), None)
        if at is None:
            at = len(used)
            used.append(0)
        row[f], shift[f] = at, used[at]
        used[at] += bits[f]
    return Packing(row, shift, bits, used)


class Tree(NamedTuple):
    """Splits per level, {position: (row, shift, mask, bin)}: larger bins go right; and the values at the deepest level."""

    levels: list[dict[int, tuple[int, int, int, int]]]
    values: np.ndarray


def route(tree: Tree, block: np.ndarray, levels: int) -> np.ndarray:
    """The position of a block's rows at a level of a tree. Nodes that are not split are left to the left."""
    at = np.zeros(block.shape[1], np.min_scalar_type(1 << len(tree.levels)))
    for level, splits in enumerate(tree.levels[:levels]):
        right = np.zeros(len(at), bool)
        for pos, (g, shift, mask, bin_) in splits.items():
            go = ((block[g] >> shift) & mask) > bin_
            right |= go & (at == pos) if level else go
        at += at
        at += right
    return at


def margin(trees: Sequence[Tree], block: np.ndarray, step: float) -> np.ndarray:
    """The sum of the trees' values, the first one at full weight."""
    out = np.zeros(block.shape[1])
    for i, t in enumerate(trees):
        out += (t.values * (step if i else 1.0))[route(t, block, len(t.levels))]
    return out


def residuals(trees: Sequence[Tree], block: np.ndarray, y: np.ndarray, step: float) -> np.ndarray:
    """What is left to fit, in multiples of 1 / UNIT; y is -1 or 1."""
    if not trees:
        return y * float(UNIT)
    with np.errstate(over="ignore"):
        return np.rint(4.0 * UNIT * y / (1.0 + np.exp(2.0 * y * margin(trees, block, step))))


def best_split(n: np.ndarray, g: np.ndarray, starts: Sequence[int]) -> tuple[int, int] | None:
    """(feature, last bin to the left) of the largest fall in variance, the first one on ties; the histograms of all
    features lie one after the other."""
    best = (1e-12, None)
    for f, (lo, hi) in enumerate(zip(starts, starts[1:])):
        if hi - lo < 2:
            continue
        ln, lg = np.cumsum(n[lo:hi]), np.cumsum(g[lo:hi]) / UNIT
        rn, rg = ln[-1] - ln[:-1], lg[-1] - lg[:-1]
        both = (ln[:-1] > 0) & (rn > 0)
        side = lambda s, k: s * s / np.maximum(k, 1)
        gain = (side(lg[:-1], ln[:-1]) + side(rg, rn) - side(lg[-1], ln[-1])) / max(ln[-1], 1)
        gain = np.where(both, np.round(gain, 12), -1.0)
        i = int(np.argmax(gain))
        if gain[i] > best[0]:
            best = (float(gain[i]), (f, i))
    return best[1]


class _Growth:
    """One tree on the driver while its levels are counted."""

    def __init__(self, depth: int):
        self.depth, self.tree = depth, Tree([], np.zeros(1 << depth))
        self.hist: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.ask = [0]  # positions of the present level to count
        self.rest: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}  # position: its sibling, and the histogram of both

    def settle(self, level: int, pos: int, n: float, g: float) -> None:
        width = self.depth - level
        self.tree.values[pos << width : (pos + 1) << width] = g / UNIT / n if n else 0.0

    def done(self) -> Tree:
        """The tree, filled up to its depth."""
        self.tree.levels.extend({} for _ in range(self.depth - len(self.tree.levels)))
        return self.tree

    def grow(self, counted: dict[int, tuple[np.ndarray, np.ndarray]], where: Packing, starts: Sequence[int]) -> None:
        """Split the nodes of the present level, of which `ask` has been counted."""
        level, hist = len(self.tree.levels), dict(counted)
        for pos, (sibling, n, g) in self.rest.items():
            hist[pos] = (n - hist[sibling][0], g - hist[sibling][1])
        splits, self.ask, self.rest = {}, [], {}
        for pos, (n, g) in sorted(hist.items()):
            found = best_split(n, g, starts)
            if found is None:
                continue
            f, bin_ = found
            splits[pos] = (where.row[f], where.shift[f], (1 << where.bits[f]) - 1, bin_)
            cut, end = starts[f] + bin_ + 1, starts[f + 1]
            sides = [(n[starts[f] : cut].sum(), g[starts[f] : cut].sum()), (n[cut:end].sum(), g[cut:end].sum())]
            for s, (k, total) in enumerate(sides):
                self.settle(level + 1, 2 * pos + s, k, total)
            if level + 1 < self.depth:
                less = 2 * pos + int(sides[1][0] < sides[0][0])
                self.ask.append(less)
                self.rest[less ^ 1] = (less, n, g)
        self.tree.levels.append(splits)


def _arrays(column: pa.Array, n_classes: int) -> np.ndarray:
    """A column of arrays, (classes, rows)."""
    flat = column.flatten()
    if column.null_count or flat.null_count or (np.diff(column.offsets.to_numpy()) != n_classes).any():
        raise ValueError(f"boosting needs {n_classes} numbers in every array")
    return flat.to_numpy(zero_copy_only=False).reshape(-1, n_classes).T


def distinct(words: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows in an order in which equal ones (in all words) follow each other, and the lengths of these runs. Where few are
    equal, or the words' hashes don't tell all apart, every row is a run."""
    mix = np.zeros(len(words[0]), np.int64)
    for w in words:
        mix = (mix ^ w) * np.int64(-7046029254386353131)
        mix ^= mix >> 32
    order = np.argsort(mix, kind="stable")
    fresh = np.diff(mix[order], prepend=~mix[order[:1]]) != 0
    first = order[fresh][np.cumsum(fresh) - 1]
    if 2 * fresh.sum() > len(mix) or not all((w[first] == w[order]).all() for w in words):
        return np.arange(len(mix)), np.ones(len(mix), np.int64)
    return order, np.diff(np.append(np.flatnonzero(fresh), len(mix)))


def _checked(columns: list[np.ndarray]) -> list[np.ndarray]:
    if any(np.isnan(x.sum()) and np.isnan(x).any() for x in columns):
        raise ValueError("boosting needs features that are numbers, not NaN")
    return [np.asarray(x, np.float64) for x in columns]


def _gathered(batches, rows: int):
    """Batches of at least so many rows, but for the last one."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def stored(rows: DataFrame, kept: Sequence[str], label: str, fold: str, inputs: Sequence[str], n_classes: int) -> DataFrame:
    """Blocks of distinct samples of one fold: their arrays (inputs x classes x samples), labels, how many each stands for,
    and the `kept` columns of these one after the other."""
    schema = T.StructType([*BLOCK, *[T.StructField(f"_{i}", T.ArrayType(rows.schema[c].dataType)) for i, c in enumerate(kept)]])
    largest = max(LARGEST // n_classes, 1)

    def store(batches):
        for b in _gathered(batches, GATHERED // (len(inputs) * n_classes)):
            members = [_arrays(c, n_classes) for c in b.columns[: len(inputs)]]
            folds, labels = b.column(len(inputs)).to_numpy(), b.column(len(inputs) + 1)
            own = np.where(labels.is_valid().to_numpy(zero_copy_only=False), labels.fill_null(0).to_numpy(), NONE)
            for k in np.unique(folds).tolist():
                here = np.flatnonzero(folds == k)
                mine = np.stack([m[:, here] for m in members])
                order, runs = distinct([own[here], *mine.view(np.int64).reshape(-1, len(here))])
                ends = np.cumsum(runs)
                for lo in range(0, len(runs), largest):
                    part, n = slice(lo, lo + largest), runs[lo : lo + largest]
                    one = order[(ends - runs)[part]]
                    whole = pa.array(here[order[ends[lo] - runs[lo] : ends[part][-1]]])
                    others = [pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), c.take(whole)) for c in b.columns[len(inputs) + 2 :]]
                    yield _row(k, mine[:, :, one], own[here[one]], n, others, schema.names)

    d = rows.select(*inputs, F.col(fold).cast("long").alias("_fold"), F.col(label).cast("long").alias("_own"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(kept)])
    return cut_lineage(d.mapInArrow(store, schema))


def _row(fold: int, block: np.ndarray, own: np.ndarray, weight: np.ndarray, others: Sequence[pa.Array] = (), names: Sequence[str] = ("fold", "block", "own", "weight")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([fold]), *[pa.array([x.tobytes()]) for x in (block, own, weight)], *others], names=list(names))


def _opened(batches, rows: int, n_classes: int, kind: type):
    """Fold, arrays (rows, classes, samples), labels, weights and what else was kept of every block."""
    for b in batches:
        for i in range(b.num_rows):
            own, weight = (np.frombuffer(b.column(c)[i].as_buffer(), np.int64) for c in (2, 3))
            block = np.frombuffer(b.column(1)[i].as_buffer(), kind).reshape(rows, n_classes, len(own))
            yield b.column(0)[i].as_py(), block, own, weight, [c[i].values for c in b.columns[4:]]


def cut_points(samples: DataFrame, inputs: int, n_classes: int, features: Callable, bins: int) -> list[Cuts]:
    """Thresholds of every feature. All rows are counted by cells of about 0.1 % of the value; a cell that holds more than a
    bin's share of rows is divided further, once, if they differ by more than about 1e-9 of the value."""
    total: list[int] = []
    done: dict[int, list[tuple[np.ndarray, ...]]] = {}
    targets: dict[int, list[int]] | None = None  # feature: cells to divide
    divided: set[int] = set()
    for level, shift in enumerate(SHIFTS):

        def count(batches, level=level, shift=shift, targets=targets):
            tables: dict[int, _Cells] = {}
            for _, members, _, weights, _ in _opened(batches, inputs, n_classes, np.float64):
                for f, x in enumerate(_checked(features(list(members)))):
                    if targets is not None and f not in targets:
                        continue
                    weight = n_classes if x.ndim == 1 else 1
                    if (weights > 1).any():
                        order = np.argsort(x, axis=None)
                        x, weight = x.ravel()[order], (weights * weight)[order % len(weights)]
                    else:
                        x = np.sort(x, axis=None)
                    if targets is not None:
                        mine = np.isin(keys(x) >> SHIFTS[level - 1], targets[f])
                        x, weight = x[mine], weight if isinstance(weight, int) else weight[mine]
                    if len(x):
                        tables.setdefault(f, _Cells()).add(x, shift, weight)
            for f, t in tables.items():
                met = t.met()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(met.shape[1], f, np.int32)), *[pa.array(c) for c in met]], schema=CELLS)

        seen = samples.select(*BLOCK.names).mapInArrow(count, "f int, cell long, n long, lo long, hi long").groupBy("f", "cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toArrow()
        f, cell, n, lo, hi = (seen.column(i).to_numpy() for i in range(5))
        if targets is None:
            if not len(f):
                return []
            total = [int(n[f == i].sum()) for i in range(int(f.max()) + 1)]
        crowd = (n * bins > np.array(total)[f]) & (hi - lo >> SHIFTS[-1] > 0) & (shift > SHIFTS[-1])
        for i in np.unique(f).tolist():
            keep = (f == i) & ~crowd
            done.setdefault(i, []).append((lo[keep], hi[keep], n[keep]))
        targets = {i: cell[crowd & (f == i)].tolist() for i in np.unique(f[crowd]).tolist()}
        divided |= set(targets)
        if not targets:
            break
    out = []
    for i in range(len(total)):
        lo, hi, n = (np.concatenate(c) for c in zip(*done[i]))
        order = np.argsort(lo)
        lo, hi, n = lo[order], hi[order], n[order]
        at, table, cell = thresholds(lo, hi, n, bins), None, lo >> SHIFTS[0]
        if i not in divided:
            table = np.zeros(int(cell[-1] - cell[0]) + 1, np.min_scalar_type(bins))
            table[cell - cell[0]] = np.searchsorted(at, numbers(lo))
        out.append(Cuts(at, int(cell[0]), table))
    return out


def _packed(columns: list[np.ndarray], cuts: Sequence[Cuts], where: Packing, n_classes: int, n: int) -> np.ndarray:
    """Bin numbers packed by `where`: rows x classes x samples."""
    out = np.zeros((len(where.used), n_classes, n), np.uint16)
    for f, x in enumerate(_checked(columns)):
        if where.bits[f]:
            out[where.row[f]] |= cuts[f].place(x).astype(np.uint16) << np.uint16(where.shift[f])
    return out


def binned(samples: DataFrame, inputs: int, n_classes: int, features: Callable, cuts: list[Cuts], where: Packing) -> DataFrame:
    """The labelled samples as stored blocks of bin numbers."""

    def store(batches):
        for fold, members, own, weight, _ in _opened(batches, inputs, n_classes, np.float64):
            mine = np.flatnonzero(own != NONE)
            if len(mine):
                yield _row(fold, _packed(features(list(members[:, :, mine])), cuts, where, n_classes, len(mine)), own[mine], weight[mine])

    return cut_lineage(samples.select(*BLOCK.names).mapInArrow(store, BLOCK))


def grow(blocks: DataFrame, n_folds: int, n_classes: int, where: Packing, sizes: Sequence[int], rounds: int, depth: int, step: float) -> list[list[Tree]]:
    """The trees of every fold, from the blocks of the other folds."""
    starts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    wide, models = starts[-1], [[] for _ in range(n_folds)]
    for _ in range(rounds):
        growing = [_Growth(depth) for _ in range(n_folds)]
        for level in range(depth):
            asked = [(f, pos) for f, t in enumerate(growing) for pos in t.ask]
            if not asked:
                break
            trees = [t.tree for t in growing]

            def count(batches, level=level, asked=asked, trees=trees):
                slots = {f: [(s, pos) for s, (k, pos) in enumerate(asked) if k == f] for f, _ in asked}
                sums = {f: [np.zeros((2, len(s) << b)) for b in where.used] for f, s in slots.items()}
                roots = {f: np.zeros(2) for f in slots}
                for fold, block, own, weight, _ in _opened(batches, len(where.used), n_classes, np.uint16):
                    block, weight = block.reshape(len(block), -1), np.tile(weight, n_classes).astype(float)
                    y = np.where(own == np.arange(n_classes)[:, None], 1.0, -1.0).ravel()
                    for f, mine in slots.items():
                        if f == fold:
                            continue
                        rows, n, r = block, weight, residuals(models[f], block, y, step) * weight
                        if not level:
                            roots[f] += n.sum(), r.sum()
                        else:
                            at = route(trees[f], block, level)
                            slot = np.full(1 << level, -1, np.int32)
                            for i, (_, pos) in enumerate(mine):
                                slot[pos] = i
                            slot = slot[at]
                            there = np.flatnonzero(slot >= 0)
                            rows, n, r, slot = block[:, there], n[there], r[there], slot[there]
                        for g, bits in enumerate(where.used):
                            cell = (rows[g] + (slot << bits) if level and len(mine) > 1 else rows[g]).astype(np.intp)
                            many = len(mine) << bits
                            sums[f][g][0] += np.bincount(cell, n, many)
                            sums[f][g][1] += np.bincount(cell, r, many)
                for f, mine in slots.items():
                    out = np.zeros((len(mine), 2, wide + 1))
                    out[:, :, wide] = roots[f]
                    for k, size in enumerate(sizes):
                        if where.row[k] < 0:
                            continue
                        bits = where.used[where.row[k]]
                        inner, own_bits = where.shift[k], where.bits[k]
                        s = sums[f][where.row[k]].reshape(2, len(mine), 1 << (bits - inner - own_bits), 1 << own_bits, 1 << inner)
                        out[:, :, starts[k] : starts[k] + size] = s.sum(axis=(2, 4)).transpose(1, 0, 2)[:, :, :size]
                    for i, (s, _) in enumerate(mine):
                        met = np.flatnonzero(out[i, 0])
                        yield pa.RecordBatch.from_arrays([pa.array(s * (wide + 1) + met), pa.array(out[i, 0, met]), pa.array(out[i, 1, met])], schema=SUMS)

            got = blocks.mapInArrow(count, "slot long, n double, g double").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).toArrow()
            hist = np.zeros((2, len(asked) * (wide + 1)))
            slot = got.column(0).to_numpy()
            hist[0, slot], hist[1, slot] = got.column(1).to_numpy(), got.column(2).to_numpy()
            hist = hist.reshape(2, len(asked), wide + 1)
            for f, t in enumerate(growing):
                if not level:
                    if not hist[0, f, wide]:
                        raise ValueError(f"no rows to learn from outside fold {f}")
                    t.settle(0, 0, *hist[:, f, wide])
                if t.ask:
                    t.grow({pos: (hist[0, s], hist[1, s]) for s, (k, pos) in enumerate(asked) if k == f}, where, starts)
        for f, t in enumerate(growing):
            models[f].append(t.done())
    return models


def boosted_oof(rows: DataFrame, ids: Sequence[str], label: str, fold: str, n_folds: int, inputs: Sequence[str], n_classes: int, features: Callable, rounds: int = 10, depth: int = 4, step: float = 0.2, bins: int = 32) -> DataFrame:
    """`ids, pred, label, fold`: every sample's best class by the trees that have not seen its fold, the first one on ties.

    `inputs` are arrays of one number per class; `features` makes lists of arrays of them, (classes, samples) or (samples,).
    Samples with a NULL label are scored and not learned from; those of no fold (NULL, or not below `n_folds`) are not scored.
    """
    kept = [*ids, label]
    samples = stored(rows.filter(F.col(fold).isNotNull()), kept, label, fold, inputs, n_classes)
    cuts = cut_points(samples, len(inputs), n_classes, features, bins)
    sizes = [len(c.at) + 1 for c in cuts]
    where = packing(sizes)
    models = grow(binned(samples, len(inputs), n_classes, features, cuts, where), n_folds, n_classes, where, sizes, rounds, depth, step) if cuts else []
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("pred", T.IntegerType()), T.StructField(fold, T.LongType())])

    def score(batches):
        for k, members, own, weight, others in _opened(batches, len(inputs), n_classes, np.float64):
            if not 0 <= k < n_folds:
                continue
            packed = _packed(features(list(members)), cuts, where, n_classes, len(own))
            with np.errstate(over="ignore"):
                p = 1.0 / (1.0 + np.exp(-2.0 * margin(models[k], packed.reshape(len(packed), -1), step)))
            best = np.argmax(np.round(p, 9).reshape(n_classes, -1), axis=0).astype(np.int32)
            n = weight.sum()
            yield pa.RecordBatch.from_arrays([*others, pa.array(np.repeat(best, weight)), pa.array(np.full(n, k))], names=schema.names)

    return samples.mapInArrow(score, schema).select(*ids, "pred", label, F.col(fold).cast(rows.schema[fold].dataType).alias(fold))
