"""Ward clustering of groups by rounds of reciprocal nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.functions import vectors as V
from strideline.operators.learn import centroids
from strideline.session import cut_lineage


def ward_merges(points: DataFrame, key: str, vec: str, weight: str | None = None) -> DataFrame:
    """`a, b, height, round`: the merges of Ward's clustering of `points` (key, vec), a cluster named by its least key.

    `height` is the rise of the within-cluster sum of squares, twice over. Each round every cluster finds its nearest one
    (ties by name), pairs that are each other's nearest merge at once, and distances follow by the Lance-Williams update:
    as merging never brings clusters nearer to others, that is the tree of one merge at a time. The table of pairs is
    quadratic in the number of points, as the method is; it is shuffled by cluster and never gathered. Keys are distinct
    longs; a single point gives no merge.
    """
    p = points.select(F.col(key).cast("long").alias("a"), F.col(vec).alias("_v"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_n"))
    q = p.toDF("b", "_w", "_m")
    gap = V.distance("_v", "_w")
    pairs = p.join(q, F.col("a") != F.col("b")).select("a", "b", F.col("_n").alias("na"), F.col("_m").alias("nb"), (2 * F.col("_n") * F.col("_m") / (F.col("_n") + F.col("_m")) * gap * gap).alias("d"))
    pairs, found = cut_lineage(pairs), []
    while not pairs.isEmpty():
        near = pairs.groupBy("a").agg(F.min(F.struct("d", "b")).alias("_x")).select("a", F.col("_x.b").alias("b"), F.col("_x.d").alias("d"))
        back = near.select(F.col("a").alias("b"), F.col("b").alias("a"))
        merges = cut_lineage(near.join(back, ["a", "b"]).filter("a < b").select("a", "b", F.col("d").alias("height")))
        found.append(merges.withColumn("round", F.lit(len(found) + 1)))
        both = merges.select("a", "b", "height").unionByName(merges.select(F.col("b").alias("a"), F.col("a").alias("b"), "height"))
        side = both.select("a", F.least("a", "b").alias("_new"), F.col("height").alias("_h"))

        def merged(d: DataFrame) -> DataFrame:
            """Rows of clusters that merge put together; each row's `a` is the side that merges here."""
            j = d.join(side, "a", "left").select(F.coalesce("_new", "a").alias("a"), "b", "na", "nb", "d", F.coalesce("_h", F.lit(0.0)).alias("_h"))
            g = j.groupBy("a", "b").agg(F.sum("na").alias("na"), F.max("nb").alias("nb"), F.sum((F.col("na") + F.col("nb")) * F.col("d")).alias("_s"), F.max("_h").alias("_h"))
            return g.select("a", "b", "na", "nb", ((F.col("_s") - F.col("nb") * F.col("_h")) / (F.col("na") + F.col("nb"))).alias("d"))

        inside = both.select("a", "b").withColumn("_own", F.lit(True))
        apart = pairs.join(inside, ["a", "b"], "left_anti")
        once = merged(apart)
        flip = once.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("nb").alias("na"), F.col("na").alias("nb"), "d")
        pairs = cut_lineage(merged(flip))
    if not found:
        return p.select("a", F.col("a").alias("b"), F.lit(0.0).alias("height"), F.lit(0).alias("round")).limit(0)
    out = found[0]
    for m in found[1:]:
        out = out.unionByName(m)
    return out


def ward_clusters(points: DataFrame, key: str, vec: str, k: int, weight: str | None = None) -> DataFrame:
    """`key, cluster`: the cut of Ward's tree into `k` clusters, named by their least key: all but the k - 1 highest merges."""
    from strideline.operators.evaluate import connected_components
    from strideline.operators.scan import ranked

    merges = cut_lineage(ward_merges(points, key, vec, weight))
    low = ranked(merges, [], "height", ["a"], "_r", descending=True).filter(F.col("_r") > k - 1)
    found = connected_components(low, "a", "b").select(F.col("node").alias("_node"), "component")
    d = points.select(F.col(key).cast("long").alias(key)).join(found, F.col(key) == F.col("_node"), "left")
    return d.select(key, F.coalesce("component", key).alias("cluster"))


def ward_group_clusters(df: DataFrame, group: str, vec: str, dim: int, k: int) -> DataFrame:
    """Ward clusters of the groups' mean vectors: (group, cluster)."""
    return ward_clusters(centroids(df, group, vec, dim), group, "centroid", k)
