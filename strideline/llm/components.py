"""Connected components of a link table, by rounds of star joins until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import dropped, stored


def label_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Stored `node, label` for every row of `nodes` (node): the least node reachable over `links` (a, b).

    Each round every node hooks on to the least label in its neighbourhood and labels are then followed twice, so a
    path of n nodes takes about log n rounds. Rounds end when no label moves; each is cut by a stored table, and the
    one before is dropped. Hot nodes are pre-aggregated map-side.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).toDF("node", "other").distinct(), "both")
    moved = stored(both.select("node").distinct().select("node", F.col("node").alias("label"), F.col("node").alias("_new")), "labels")
    while True:
        linked = moved.select("node", F.col("_new").alias("label"))
        seen = both.join(linked.select(F.col("node").alias("other"), F.col("label").alias("_l")), "other")
        least = seen.groupBy("node").agg(F.min("_l").alias("_m"))
        hooked = linked.join(least, "node").select("node", "label", F.least("label", "_m").alias("_n"))
        # the root of a tree takes the least label that any of its members met
        roots = hooked.groupBy("label").agg(F.min("_n").alias("_root")).withColumnRenamed("label", "_at")
        up = hooked.join(roots, F.col("label") == F.col("_at")).select("node", "label", F.least("_n", "_root").alias("_n"))
        jump = up.select(F.col("node").alias("_n"), F.col("_n").alias("_far"))
        before, moved = moved, stored(up.join(jump, "_n").select("node", "label", F.least("_n", "_far").alias("_new")), "labels")
        dropped(before)
        if moved.filter("label <> _new").isEmpty():
            break
    linked = moved.select("node", F.col("_new").alias("label"))
    out = stored(nodes.join(linked, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
    dropped(both, moved)
    return out
