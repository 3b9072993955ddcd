"""Grouped reports and digests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.functions import vectors as V
from strideline.operators.scan import ordered_scan, quantiles


def label_crosstab(df: DataFrame, row: str, col: str, values: Sequence) -> DataFrame:
    """Counts per row key and column value, with the smallest cell of the row."""
    wide = df.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1))).na.fill(0)
    return wide.withColumn("min_cell", F.least(*[F.col(f"`{v}`") for v in values]))


def coverage(df: DataFrame, key: str, value: str, approximate: bool = False) -> DataFrame:
    """Rows and distinct values per key (a sketch at scale, exact by default)."""
    n = F.approx_count_distinct(value, 0.02) if approximate else F.count_distinct(value)
    return df.groupBy(key).agg(F.count("*").alias("n"), n.alias("n_distinct"))


def dominant_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """The commonest value per key, the smallest on ties: two map-side-combined aggregates."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_c"))
    best = F.max(F.struct(F.col("_c"), (-F.col(value).cast("double")).alias("_neg"), F.col(value).alias("v"))).alias("_b")
    return counts.groupBy(key).agg(best).select(key, F.col("_b.v").alias("dominant"), F.col("_b._c").alias("n"))


def vector_soup(df: DataFrame, key: str, source: str, vec: str, dim: int, other: str) -> DataFrame:
    """Element-wise mean of a key's vectors over sources; a non-float entry comes from the first source,
    with a flag where the sources differ."""
    mean = F.array(*[F.avg(F.col(vec)[i]) for i in range(dim)])
    return df.groupBy(key).agg(
        mean.alias("soup"), F.min(F.struct(source, other))[other].alias(other), (F.min(other) != F.max(other)).alias("differs"), F.count("*").alias("n_sources")
    )


def best_box_per_frame(boxes: DataFrame, clip: str, frame: str, conf: str, ties: Sequence[str], corners: Sequence[str]) -> DataFrame:
    """The most confident box of each frame, by grouped maximum; ties go to the smallest tie columns."""
    order = F.struct(F.col(conf), *[(-F.col(t)).alias(f"_{t}") for t in ties], *corners)
    return boxes.groupBy(clip, frame).agg(F.max(order).alias("_b"), F.count("*").alias("n_boxes")).select(clip, frame, "n_boxes", *[F.col("_b")[c].alias(c) for c in corners])


def union_window(best: DataFrame, clip: str, corners: Sequence[str], width: int, height: int, margin: float, min_fraction: float) -> DataFrame:
    """Square window around the union of a clip's picked boxes."""
    x0, y0, x1, y1 = corners
    u = best.groupBy(clip).agg(F.min(x0).alias(x0), F.min(y0).alias(y0), F.max(x1).alias(x1), F.max(y1).alias(y1))
    return u.select(clip, *[c.alias(n) for n, c in V.square_window(x0, y0, x1, y1, F.lit(width), F.lit(height), margin, F.lit(min_fraction * max(width, height))).items()])


def box_drift(best: DataFrame, clip: str, frame: str, corners: Sequence[str], seg: str | None = None) -> DataFrame:
    """Per clip: overlap of consecutive picks, union area over median area, frames with several boxes."""
    x0, y0, x1, y1 = corners
    area = (F.col(x1) - F.col(x0)) * (F.col(y1) - F.col(y0))
    d = ordered_scan(best, [clip], [frame], seg, prev=corners).withColumn("_area", area)
    o = V.iou([f"prev_{c}" for c in corners], list(corners))
    g = d.groupBy(clip).agg(
        F.coalesce(F.min(F.when(F.col(f"prev_{x0}").isNotNull(), o)), F.lit(1.0)).alias("min_iou"), F.coalesce(F.avg(F.when(F.col(f"prev_{x0}").isNotNull(), o)), F.lit(1.0)).alias("mean_iou"),
        ((F.max(x1) - F.min(x0)) * (F.max(y1) - F.min(y0))).alias("_union"), F.avg((F.col("n_boxes") > 1).cast("double")).alias("multi_share"),
    )
    m = quantiles(d, [clip], "_area", {"_median": 0.5})
    return g.join(m, clip).withColumn("inflation", F.col("_union") / F.greatest("_median", F.lit(1e-9))).drop("_union", "_median")


def class_confidence(det: DataFrame, clip: str, cls: str, conf: str, classes: Sequence[str]) -> DataFrame:
    """Largest confidence per class in a clip, 0 where the class was not seen."""
    return det.groupBy(clip).pivot(cls, list(classes)).agg(F.max(conf)).na.fill(0.0)


def grouping_report(scored: DataFrame, levels: Sequence[Sequence[str]], pred="pred", label="label") -> DataFrame:
    """Accuracy at every level in one pass of grouping sets: (level, key, n, acc)."""
    keys = list(dict.fromkeys(k for lv in levels for k in lv))
    sets = [[F.col(k) for k in lv] for lv in levels]
    g = scored.groupingSets(sets, *[F.col(k) for k in keys]).agg(F.count("*").alias("n"), F.avg((F.col(pred) == F.col(label)).cast("double")).alias("acc"), F.grouping_id().alias("_gid"))
    ids = {tuple(lv): sum((0 if k in lv else 1) << (len(keys) - 1 - i) for i, k in enumerate(keys)) for lv in levels}
    name = reduce(lambda acc, kv: acc.when(F.col("_gid") == kv[1], F.lit("+".join(kv[0]) or "all")), ids.items(), F.when(F.lit(False), F.lit("")))
    return g.select(name.alias("level"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"), "n", "acc")


def collisions(df: DataFrame, group: str, preds: Sequence[str]) -> DataFrame:
    """Repeats of a predicted label inside groups of two or more, summed, per prediction column."""
    long = df.select(group, F.explode(F.array(*[F.struct(F.lit(p).alias("which"), F.col(p).cast("int").alias("pred")) for p in preds])).alias("_x")).select(group, "_x.*")
    cells = long.groupBy(group, "which", "pred").agg(F.count("*").alias("_c"))  # map-side: at most C rows a group
    per = cells.groupBy(group, "which").agg(F.sum("_c").alias("_n"), F.count("*").alias("_d"))
    return per.filter("_n >= 2").groupBy("which").agg(F.sum(F.col("_n") - F.col("_d")).alias("collisions"))


def list_digest(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """sha1 of the sorted names joined by newlines, for the file list of one clip; sha1('') when empty."""
    present = F.array_compact(F.collect_list(name))
    return df.groupBy(*keys).agg(F.sha1(F.array_join(F.sort_array(present), "\n")).alias("digest"))


def content_digest(df: DataFrame, keys: Sequence[str], name: str, widths: Sequence[int] = (6, 3)) -> DataFrame:
    """Order-free digest of any number of names per key, as a tree: names are hashed to leaves by hash
    prefix, each level hashes the sorted digests below it. Copies of a name count once with their
    number, so neither a hot key nor a hot name is ever gathered."""
    d = df.groupBy(*keys, name).agg(F.count("*").alias("_n"))
    leaf = F.sha2(F.concat_ws(":", F.col(name).cast("string"), F.col("_n").cast("string")), 256)
    d = d.select(*keys, leaf.alias("_h"), F.substring(leaf, 1, widths[0]).alias("_p"))
    for w in [*widths[1:], 0]:
        d = d.groupBy(*keys, "_p").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("_h")), "\n"), 256).alias("_h"))
        d = d.select(*keys, "_h", F.substring("_p", 1, w).alias("_p"))
    return d.groupBy(*keys).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("_h")), "\n"), 256).alias("digest"))
