"""Mixing sources to target weights by systematic sampling.

Every source gets a share of all words by weight, capped at `cap` times its own words (the excess goes to
the other sources by weight). Within a source each document then has `target / source_size` expected copies.
Documents are laid out by size class and a seeded hash, expected copies are prefix-summed along that layout,
one random offset per source is added, and a document is emitted once per integer boundary its stretch crosses.
Laying out by size makes the taken words, not only the taken documents, come near the target.

The prefix sum is split: rows are ranked inside (source, size class, hash digit), and one count per such
segment is prefix-summed per source, so that a source with a third of all rows never meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def source_targets(sized: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """One row per source: `source, source_rank, source_size, target` (words).

    `sized` has `source` and `size`. Sources rank by code point, NULL last, and take the weights in turn.
    Working from the smallest cap per weight up, a source is capped when its cap lies below its share of what is left.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())  # one row per source
    t = totals.withColumn("source_rank", F.row_number().over(by_name))
    t = t.withColumn("_w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("source_rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
    t = t.withColumn("_cap", F.col("source_size") * cap)
    whole = W.partitionBy(F.lit(0))
    by_cap = whole.orderBy(F.col("_cap") / F.col("_w"), "source_rank")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(0, W.unboundedFollowing)
    t = t.withColumn("_left", F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
    t = t.withColumn("_capped", F.col("_cap") * F.sum("_w").over(onward) <= F.col("_left") * F.col("_w"))
    capped = F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(0)).over(whole)
    free = F.sum(F.when(F.col("_capped"), 0).otherwise(F.col("_w"))).over(whole)
    rest = F.sum("source_size").over(whole) - capped
    share = F.col("_w").cast("double") * rest.cast("double") / free.cast("double")
    t = t.withColumn("target", F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(share))
    return t.select("source", "source_rank", "source_size", "target")


def systematic_copies(sized: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """`sized` (doc_id, source, size, ...) with `source_size`, `target` and `copies`, the times each row is taken.

    Equal rows may be laid out in either order; they get the same set of copies. Reruns agree.
    """
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    d = sized.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    d = d.withColumns({"_h": hashed, "_class": F.floor(F.sqrt(F.col("size")) * 4)})
    d = d.withColumn("_seg", F.col("_class") * 16 + F.conv(F.substring("_h", 1, 1), 16, 10).cast("long"))
    counts = d.groupBy("source_rank", "_seg").agg(F.count("*").alias("_n"))
    before = W.partitionBy("source_rank").orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("source_rank", "_seg", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("source_rank", "_seg").orderBy("_h", "doc_id", "size")
    d = d.join(counts, ["source_rank", "_seg"]).withColumn("_i", F.col("_before") + F.row_number().over(inside))
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"offset:{seed}:"), F.col("source_rank").cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    d = d.withColumns({"_u": start, "_f": rate})
    crossed = F.floor(F.col("_i") * F.col("_f") + F.col("_u")) - F.floor((F.col("_i") - 1) * F.col("_f") + F.col("_u"))
    return d.withColumn("copies", crossed.cast("long")).drop("_h", "_class", "_seg", "_before", "_i", "_u", "_f", "source_rank")


def word_count(text):
    """Number of runs of characters other than ASCII white space; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: int = 0) -> DataFrame:
    """Sizes, targets and taken words of every document.

    Takes `doc_id, text, source` and ignores other columns. A NULL text has size 0, a NULL source is a source
    of its own, a NULL doc_id is laid out by the hash of "null", repeated rows are sampled one by one, an empty
    table gives no rows. A size-0 document may be emitted but takes no words.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    out = systematic_copies(sized, source_targets(sized, weights, cap), seed)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: int = 0) -> DataFrame:
    """The mix itself: each row of `docs`, with its own columns, as many times as it is taken."""
    names = docs.columns
    d = docs.select(F.struct(*names).alias("_row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    targets = source_targets(docs.select("source", word_count(F.col("text")).alias("size")), weights, cap)
    out = systematic_copies(d, targets, seed).filter("copies > 0")
    out = out.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
    return out.select([F.col("_row")[n].alias(n) for n in names])


SQL = r"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents),
t as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as rk from d group by source),
w as (select *, cast(1 + (rk - 1) % 3 as bigint) as w, 3 * source_size as cap from t),
l as (select *, sum(source_size) over () - coalesce(sum(cap) over (order by cap::double / w, rk rows between unbounded preceding and 1 preceding), 0) as lft,
  sum(w) over (order by cap::double / w, rk rows between current row and unbounded following) as ws from w),
c as (select *, cap * ws <= lft * w as capped from l),
s as (select source, source_size, rk, case when capped then cap::double
    else w::double * (sum(source_size) over () - sum(case when capped then cap else 0 end) over ())::double / (sum(case when capped then 0 else w end) over ())::double end as target from c),
r as (select d.doc_id, d.size, s.source_size, s.target, s.rk, md5('0:' || coalesce(cast(d.doc_id as varchar), 'null')) as h
  from d join s on d.source is not distinct from s.source),
i as (select *, row_number() over (partition by rk order by cast(floor(sqrt(size) * 4) as bigint), h, doc_id, size) as i,
  case when source_size > 0 then target / source_size::double else 0 end as f,
  ('0x' || substr(md5('offset:0:' || cast(rk as varchar)), 1, 8))::bigint / 4294967296.0::double as u from r)
select doc_id, size, source_size, target, cast(floor(i * f + u) - floor((i - 1) * f + u) as bigint) * size as taken from i
"""
