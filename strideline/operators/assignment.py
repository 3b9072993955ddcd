"""Assigning distinct classes inside a recording."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strideline.functions import posterior as P


def _min_cost_rows(cost: np.ndarray) -> np.ndarray:
    """Column of each row at least total cost (rows <= columns): shortest augmenting paths with potentials."""
    rows, cols = cost.shape
    row_price, col_price = np.zeros(rows), np.zeros(cols)
    owner = np.full(cols, -1)
    for r in range(rows):
        reach = cost[r] - row_price[r] - col_price
        parent = np.full(cols, r)
        done = np.zeros(cols, dtype=bool)
        while True:
            j = int(np.where(done, np.inf, reach).argmin())
            done[j] = True
            if owner[j] < 0:
                break
            i = owner[j]
            via = reach[j] + cost[i] - row_price[i] - col_price
            better = ~done & (via < reach)
            reach[better], parent[better] = via[better], i
        short = reach[j]
        settled = done.copy()
        settled[j] = False
        row_price[r] += short
        for c in np.flatnonzero(settled):
            row_price[owner[c]] += short - reach[c]
            col_price[c] -= short - reach[c]
        while True:  # flip the path back to row r
            i = parent[j]
            previous = np.flatnonzero(owner == i)
            owner[j] = i
            if i == r:
                break
            j = int(previous[previous != j][0])
    out = np.full(rows, -1)
    for c in np.flatnonzero(owner >= 0):
        out[owner[c]] = c
    return out


def group_distinct_assignment(df: DataFrame, group: str, sample: str, probs: str, n_classes: int, eps: float = 1e-9, digits: int | None = None) -> DataFrame:
    """Clips of a recording get different classes at least total -log p; with more clips than classes, every class goes
    to one clip and the others keep their arg-max. A recording of one clip keeps its arg-max.

    A least-cost choice for C classes needs only each class's C cheapest clips, so at most C x C clips of a group
    are ever together. `solved` marks the clips whose class the choice has set.
    """
    size = df.groupBy(group).agg(F.count("*").alias("_n")).filter("_n > 1")
    cost = F.transform(probs, lambda p: F.round(-F.log(p + eps), 12))
    each = df.join(size, group).select(group, sample, F.posexplode(cost).alias("_c", "_cost"))
    near = W.partitionBy(group, "_c").orderBy("_cost", sample)
    kept = each.withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= n_classes).select(group, sample).distinct()
    packed = df.join(kept, [group, sample], "left_semi").groupBy(group).agg(F.sort_array(F.collect_list(F.struct(sample, probs))).alias("rows"))
    packed = packed.select(group, F.transform("rows", lambda r: r[sample]).alias("ids"), F.flatten(F.transform("rows", lambda r: r[probs])).alias("flat"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            picks = []
            for f in pdf["flat"]:
                table = -np.log(np.asarray(f).reshape(-1, n_classes) + eps)
                if len(table) <= n_classes:
                    picks.append(_min_cost_rows(table).tolist())
                else:
                    pick = np.full(len(table), -1)
                    pick[_min_cost_rows(table.T)] = np.arange(n_classes)
                    picks.append(pick.tolist())
            yield pd.DataFrame({group: pdf[group], "ids": pdf["ids"], "picks": picks})

    kinds = dict(df.dtypes)
    solved = packed.mapInPandas(solve, f"{group} {kinds[group]}, ids array<{kinds[sample]}>, picks array<int>")
    solved = solved.select(group, F.explode(F.arrays_zip("ids", "picks")).alias("_z")).select(group, F.col("_z.ids").alias(sample), F.col("_z.picks").alias("_pick")).filter("_pick >= 0")
    d = df.select(group, sample, probs).join(solved, [group, sample], "left")
    return d.select(group, sample, probs, F.coalesce("_pick", P.argmax(probs, digits)).alias("assigned"), F.col("_pick").isNotNull().alias("solved"))
