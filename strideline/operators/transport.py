"""Assigning classes under exact capacities at least total cost (a transport problem), by prices and shortest paths."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strideline.functions import posterior as P
from strideline.operators.scan import bounded_broadcast, ranked
from strideline.session import cut_lineage

UNIT = 10**9
LISTED = 200_000


def transport_costs(probs: str, eps: float = P.LOG_FLOOR) -> Column:
    """-log p per class in whole billionths, so that sums and comparisons are exact; NULL counts as 0."""
    return F.transform(probs, lambda p: F.round(-F.log(F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(eps))) * UNIT).cast("long"))


def _cheapest(cost: str, price: np.ndarray) -> Column:
    """The class of least cost plus price, the first on ties."""
    with_price = F.zip_with(cost, F.array(*[F.lit(int(p)).cast("long") for p in price]), lambda a, b: a + b)
    return (F.array_position(with_price, F.array_min(with_price)) - 1).cast("int")


def _demand(groups: DataFrame, cls: Column, n_classes: int) -> np.ndarray:
    """Rows per class, of groups of `_n` rows each."""
    row = groups.select(cls.alias("c"), "_n").agg(*[F.sum(F.when(F.col("c") == c, F.col("_n"))) for c in range(n_classes)]).first()
    return np.array([x or 0 for x in row], dtype=np.int64)


def balancing_prices(base: DataFrame, want: np.ndarray, enough: int, tolerance: float = 1e-4) -> np.ndarray:
    """Prices whose demand comes near the capacities: steps against excess demand that grow while they help and are
    halved while they don't, until the misfit is `enough` or a step moves no price by `tolerance`. A pass is one
    aggregate of a count per class."""
    n = len(want)
    price, step = np.zeros(n), 1.0
    units = lambda p: np.round(p * UNIT).astype(np.int64)
    got = _demand(base, _cheapest("_cost", units(price)), n)
    gap = int(np.abs(got - want).sum())
    while gap > enough and step > tolerance:
        trial = price + step * n * (got - want) / max(int(want.sum()), 1)
        seen = _demand(base, _cheapest("_cost", units(trial)), n)
        if (near := int(np.abs(seen - want).sum())) < gap:
            price, got, gap, step = trial, seen, near, step * 1.2
        else:
            step *= 0.5
    return units(price)


class _Moves:
    """Cheapest moves between classes of rows in groups of equal costs, exact as far as the listed groups reach."""

    def __init__(self, n: int, depth: int, listed: list[tuple]):
        """`listed`: (from, to, change of cost, id, group, rows per class, costs), the `depth` cheapest of every (from, to)."""
        self.n = n
        self.at: dict[int, list[int]] = {}
        self.costs: dict[int, tuple] = {}
        self.heaps: dict[tuple[int, int], list] = {(a, b): [] for a in range(n) for b in range(n) if a != b}
        for a, b, d, key, group, rows, cost in listed:
            self.at[group], self.costs[group] = list(rows), (key, cost)
            self.heaps[a, b].append((d, key, group))
        # beyond the last of a full list there may be unlisted groups
        self.reach = {e: max(h)[:2] if len(h) == depth else None for e, h in self.heaps.items()}
        self.queued = {(a, b, g) for (a, b), h in self.heaps.items() for _, _, g in h}
        for h in self.heaps.values():
            heapq.heapify(h)

    def best(self, a: int, b: int) -> tuple | None:
        """The cheapest move from a to b; raises LookupError where an unlisted group may be cheaper."""
        heap = self.heaps[a, b]
        while heap and not self.at[heap[0][2]][a]:
            self.queued.discard((a, b, heapq.heappop(heap)[2]))
        limit = self.reach[a, b]
        if limit is not None and (not heap or heap[0][:2] > limit):
            raise LookupError
        return heap[0] if heap else None

    def weights(self) -> np.ndarray:
        out = np.full((self.n, self.n), np.inf)
        for a, b in self.heaps:
            if (m := self.best(a, b)) is not None:
                out[a, b] = m[0]
        return out

    def along(self, path: list[int], most: int) -> tuple[int, set[int]]:
        """Move as many rows as there are along a path, `most` at most: the path stays a shortest one until one of its
        groups has no row left. Returns their number and the groups."""
        steps = [(a, b, self.best(a, b)[2]) for a, b in zip(path, path[1:])]
        rows = min(most, *[self.at[g][a] for a, _, g in steps])
        for a, b, g in steps:
            self.at[g][a] -= rows
            self.at[g][b] += rows
        for _, b, g in steps:
            key, cost = self.costs[g]
            for c in range(self.n):
                if c != b and (b, c, g) not in self.queued:
                    self.queued.add((b, c, g))
                    heapq.heappush(self.heaps[b, c], (cost[c] - cost[b], key, g))
        return rows, {g for _, _, g in steps}


def shortest_path(weights: np.ndarray, sources: np.ndarray, sinks: np.ndarray) -> list[int] | None:
    """Classes on a least-weight path from a source to a sink; no cycle is negative (whole numbers below 2**53)."""
    n = len(weights)
    dist = np.where(sources, 0.0, np.inf)
    parent = np.full(n, -1)
    for _ in range(n):
        via = dist[:, None] + weights
        best = via.argmin(axis=0)
        short = via[best, np.arange(n)]
        better = short < dist
        if not better.any():
            break
        dist[better], parent[better] = short[better], best[better]
    if not np.isfinite(np.where(sinks, dist, np.inf)).any():
        return None
    at = int(np.where(sinks, dist, np.inf).argmin())
    path = [at]
    while parent[at] >= 0:
        at = int(parent[at])
        path.append(at)
    return path[::-1]


def capacity_assignment(df: DataFrame, sample: str, probs: str, targets: DataFrame, n_classes: int) -> DataFrame:
    """`sample, probs, _cost, assigned`: the classes of least total -log p under the capacities `targets` (cls, n_target).

    Rows of equal costs are one group, and all that follows goes by groups and their numbers of rows. Rows first take the
    class of least cost at prices that nearly balance demand; that is optimal for the class sizes it gives. Excess rows
    then move along shortest paths in the graph of classes, whose edge is the cheapest move of a group's rows: each move
    keeps the assignment optimal for its sizes, so it is the optimum once sizes are the capacities. A pass lists the
    cheapest groups of every pair of classes (at most `LISTED` in all, whatever the number of rows, kept per task before
    they are shuffled), and all moves that the list decides are made before the next pass. There is no cap on passes.

    Capacities must sum to the number of rows; a class without a row in `targets` has none. Groups of equal change go by
    their least `sample`; a group that is divided gives its classes, in order, its rows by `sample`.
    """
    want = np.zeros(n_classes, np.int64)
    for r in targets.collect():  # one row per class
        want[r["cls"]] = r["n_target"]
    base = cut_lineage(df.select(sample, probs, transport_costs(probs).alias("_cost")))
    groups = base.groupBy("_cost").agg(F.count("*").alias("_n"), F.min(sample).alias("_id"))
    groups = cut_lineage(groups.withColumn("_group", F.monotonically_increasing_id()))
    count, n = groups.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    if n != want.sum():
        raise ValueError(f"capacities sum to {want.sum()}, but there are {n} rows")
    depth = max(16, LISTED // max(n_classes * n_classes, 1))
    price = balancing_prices(groups, want, depth)
    start = _cheapest("_cost", price)
    d = cut_lineage(groups.withColumn("_first", start).withColumn("_at", F.array(*[F.when(F.col("_first") == c, F.col("_n")).otherwise(0) for c in range(n_classes)])).drop("_first"))
    while True:
        got = np.array([x or 0 for x in d.agg(*[F.sum(F.col("_at")[c]) for c in range(n_classes)]).first()], dtype=np.int64)
        if (got == want).all():
            break
        each = d.select("_group", "_id", "_cost", "_at", F.posexplode("_at").alias("_from", "_rows")).filter("_rows > 0")
        each = each.select("*", F.posexplode("_cost").alias("_to", "_c")).filter("_to <> _from").withColumn("_change", F.col("_c") - F.col("_cost")[F.col("_from")])
        near = W.partitionBy("_from", "_to").orderBy("_change", "_id", "_group")
        listed = each.withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= depth)
        moves = _Moves(n_classes, depth, [(r["_from"], r["_to"], r["_change"], _null_first(r["_id"]), r["_group"], r["_at"], tuple(r["_cost"])) for r in listed.collect()])
        moved: set[int] = set()
        try:
            while (got != want).any():
                path = shortest_path(moves.weights(), got > want, got < want)
                rows, touched = moves.along(path, int(min(got[path[0]] - want[path[0]], want[path[-1]] - got[path[-1]])))
                moved |= touched
                got[path[0]] -= rows
                got[path[-1]] += rows
        except LookupError:
            pass  # an unlisted group may be next: list again
        new = d.sparkSession.createDataFrame([(g, moves.at[g]) for g in moved], "_group long, _new array<long>")
        d = cut_lineage(d.join(F.broadcast(new), "_group", "left").withColumn("_at", F.coalesce("_new", "_at")).drop("_new"))
    return _dealt(base, d, count, sample, n_classes)


def _null_first(x) -> tuple:
    return (x is not None, x)


def _dealt(base: DataFrame, groups: DataFrame, count: int, sample: str, n_classes: int) -> DataFrame:
    """Every row with the class that its group has for it."""
    side = bounded_broadcast(groups.select("_cost", "_group", "_at"), count, 64 + 32 * n_classes)
    rows = base.join(side, "_cost").withColumn("_parts", F.size(F.filter("_at", lambda x: x > 0)))
    names = [*base.columns, "assigned"]
    one = rows.filter("_parts = 1").withColumn("assigned", F.array_position(F.transform("_at", lambda x: x > 0), True).cast("int") - 1).select(*names)
    if groups.filter(F.size(F.filter("_at", lambda x: x > 0)) > 1).isEmpty():
        return one
    many = ranked(rows.filter("_parts > 1").withColumn("_zero", F.lit(0)), ["_group"], "_zero", [sample], "_rank")
    upto = [P.sum_columns([F.col("_at")[k] for k in range(c + 1)]) for c in range(n_classes)]
    return one.unionByName(many.withColumn("assigned", P.sum_columns([(F.col("_rank") > u).cast("int") for u in upto])).select(*names))


def transport_certificate(assigned: DataFrame, targets: DataFrame, n_classes: int) -> DataFrame:
    """`measure, n` of an assignment: rows, rows off the capacities, total cost, remaining negative cycles (0 or 1), and the
    gap between the total cost and the bound that the classes' potentials prove (0 only for an optimum)."""
    best = assigned.select("assigned", "_cost", F.posexplode("_cost").alias("_to", "_c")).groupBy("assigned", "_to").agg(F.min(F.col("_c") - F.col("_cost")[F.col("assigned")]).alias("w"))
    weights = np.full((n_classes, n_classes), np.inf)
    for r in best.collect():
        weights[r["assigned"], r["_to"]] = r["w"]
    reach = np.zeros(n_classes)
    for _ in range(n_classes):
        reach = np.minimum(reach, (reach[:, None] + weights).min(axis=0))
    cycles = int((np.minimum(reach, (reach[:, None] + weights).min(axis=0)) < reach).any())
    price = F.array(*[F.lit(int(-x)).cast("long") for x in reach])
    caps = {r["cls"]: int(r["n_target"]) for r in targets.collect()}
    paid = sum(int(-x) * caps.get(c, 0) for c, x in enumerate(reach))
    total = assigned.agg(
        F.count("*").alias("rows"), F.sum(F.col("_cost")[F.col("assigned")]).alias("cost"), F.sum(F.array_min(F.zip_with("_cost", price, lambda a, b: a + b))).alias("bound")
    )
    got = assigned.groupBy(F.col("assigned").alias("cls")).agg(F.count("*").alias("_got"))
    off = targets.join(got, "cls", "full").agg(F.sum(F.abs(F.coalesce("_got", F.lit(0)) - F.coalesce("n_target", F.lit(0)))).alias("off"))
    measures = {"rows": F.col("rows"), "off_capacity": F.col("off"), "negative_cycles": F.lit(cycles), "cost_over_bound": F.col("cost") - F.col("bound") + F.lit(paid)}
    rows = F.array(*[F.struct(F.lit(k).alias("measure"), F.coalesce(x.cast("long"), F.lit(0)).alias("n")) for k, x in measures.items()])
    return total.join(off).select(F.explode(rows).alias("r")).select("r.*")
