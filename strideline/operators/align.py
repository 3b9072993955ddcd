"""Joining members, metadata and id sets, with the checks that keep rows from being lost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.operators.scan import bounded_broadcast


class AlignmentError(ValueError):
    """Two tables that must hold the same ids do not."""


def id_issues(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(id, issue): `missing` on the right, `extra` on the right, `duplicate` on either side.

    One shuffle of (id, side counts); duplicates are counted map-side first.
    """
    n = lambda d, name: d.groupBy(key).agg(F.count("*").alias(name))
    both = n(left, "_l").join(n(right, "_r"), key, "full_outer").na.fill(0, ["_l", "_r"])
    kinds = F.array_compact(
        F.array(
            F.when(F.col("_r") == 0, F.lit("missing")), F.when(F.col("_l") == 0, F.lit("extra")),
            F.when((F.col("_l") > 1) | (F.col("_r") > 1), F.lit("duplicate")),
        )
    )
    return both.select(key, F.explode(kinds).alias("issue"))


def align_strict(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join by id, after checking that both sides hold exactly the same ids once."""
    found = {r["issue"]: r["count"] for r in id_issues(left, right, key).groupBy("issue").count().collect()}  # three rows at most
    if found:
        raise AlignmentError(", ".join(f"{n} {kind}" for kind, n in sorted(found.items())))
    return left.join(right, key)


def align_zero_fill(reference: DataFrame, member: DataFrame, key: str, probs: str, n_classes: int) -> DataFrame:
    """Every reference id; the zero vector where the member has none."""
    zero = F.array_repeat(F.lit(0.0), n_classes)
    return reference.join(member.select(key, probs), key, "left").withColumn(probs, F.coalesce(probs, zero))


def align_intersection(post: DataFrame, key: str, members: int) -> DataFrame:
    """Rows of the ids that every member holds."""
    common = post.groupBy(key).agg(F.count_distinct("member").alias("_n")).filter(F.col("_n") == members)
    return post.join(common.select(key), key, "left_semi")


def concat_first(tables: Sequence[DataFrame], key: str, last: bool = False) -> DataFrame:
    """Union of fold tables; the row of the first (or last) table wins for a repeated id.

    A grouped min of (table number, row) instead of a window, so repeats shrink map-side.
    """
    cols = tables[0].columns
    rest = [c for c in cols if c != key]
    tagged = [t.select(key, F.struct(F.lit(i).alias("_i"), *rest).alias("_row")) for i, t in enumerate(tables)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t)
    pick = F.max("_row") if last else F.min("_row")
    return union.groupBy(key).agg(pick.alias("_row")).select(key, *[F.col("_row")[c].alias(c) for c in rest])


def attach_checked(post: DataFrame, meta: DataFrame, key: str, label: str, meta_label: str) -> DataFrame:
    """Metadata joined on, with a flag where the two labels differ."""
    return post.join(meta, key).withColumn("label_differs", F.col(label) != F.col(meta_label))


def fingerprint_status(cache: DataFrame, index: DataFrame, key: str, fp: str) -> DataFrame:
    """Per indexed or cached id: `accepted` (same content), `rejected` (other or no content), `live` (not cached)."""
    c = cache.select(key, F.col(fp).alias("_cached"))
    i = index.select(key, F.col(fp).alias("_now"))
    status = (
        F.when(F.col("_cached").isNull(), F.lit("live")).when(F.col("_cached") == F.col("_now"), F.lit("accepted")).otherwise(F.lit("rejected"))
    )
    return c.join(i, key, "full_outer").select(key, status.alias("status"))


def semi_by_subject(rows: DataFrame, users: DataFrame, key: str, exclude: bool = True) -> DataFrame:
    return rows.join(users.select(key), key, "left_anti" if exclude else "left_semi")


def score_prototypes(rows: DataFrame, prototypes: DataFrame, cls: str, n_classes: int, dim: int, score) -> DataFrame:
    """Every row against every class prototype: classes exploded, then an equi-join on the class.

    The prototype side has one row per class, so its size is known before it is broadcast.
    `score(row vector column, prototype column)` gives the score column.
    """
    wide = rows.withColumn("proto_cls", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))))
    side = bounded_broadcast(prototypes.select(F.col(cls).cast("int").alias("proto_cls"), F.col("proto")), n_classes, 8 * dim)
    return wide.join(side, "proto_cls").withColumn("score", score(F.col("vec"), F.col("proto"))).drop("proto")


def partition_violations(folds: DataFrame, sample: str, subject: str, fold: str, label: str, n_classes: int) -> DataFrame:
    """(rule, n): samples or subjects in several folds, folds whose training side misses a class."""
    multi = lambda key, rule: (
        folds.groupBy(key).agg(F.count_distinct(fold).alias("_n")).filter("_n > 1").agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    )
    # per (fold, class) counts are at most folds x classes rows
    cells = folds.groupBy(fold, label).agg(F.count("*").alias("c"))
    total = cells.groupBy(label).agg(F.sum("c").alias("all_c"))
    grid = cells.select(fold).distinct().withColumn(label, F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))))
    left = grid.join(cells, [fold, label], "left").join(total, label, "left").na.fill(0, ["c", "all_c"])
    uncovered = left.filter(F.col("all_c") - F.col("c") <= 0).agg(F.count("*").alias("n")).select(F.lit("class_missing_in_training").alias("rule"), "n")
    return multi(sample, "sample_in_several_folds").unionByName(multi(subject, "subject_in_several_folds")).unionByName(uncovered)


def ranked_subsets(spark, n: int, size: int, parts: int | None = None) -> DataFrame:
    """`subset, members`: all subsets of `size` of the numbers 0 to n - 1, by their number in the combinatorial number system.

    A task turns its own range of numbers into subsets, so that nothing but the range is handed out: member j (from the
    largest) is the greatest c with C(c, j) not above what is left of the number.
    """
    from math import comb

    total = comb(n, size)
    if total >= 1 << 62:
        raise ValueError(f"{total} subsets cannot be numbered by a long")
    table = F.array(*[F.array(*[F.lit(comb(c, j)).cast("long") for c in range(n + 1)]) for j in range(size + 1)])
    d = spark.range(0, total, 1, parts or max(1, min(spark.sparkContext.defaultParallelism * 4, total // 1000 + 1))).withColumnRenamed("id", "subset")
    begin = F.struct(F.col("subset").alias("left"), F.array().cast("array<int>").alias("members"))

    def member(a, j):
        row = F.get(table, j)
        c = F.size(F.filter(row, lambda x: x <= a["left"])) - 1  # binomials rise with c, from 0 below j
        return F.struct((a["left"] - F.get(row, c)).alias("left"), F.concat(a["members"], F.array(c)).alias("members"))

    return d.withColumn("members", F.aggregate(F.array(*[F.lit(j) for j in range(size, 0, -1)]), begin, member)["members"])


def subset_quantiles(hits: DataFrame, subject: str, hit: str, n: str, size: int, probs: dict[str, float], groups: Column | None = None,
                     per_group: dict | None = None) -> DataFrame:
    """Pooled accuracy over all subsets of `size` subjects, from per-subject (hits, n) totals.

    Subjects are numbered in their order; subsets are unranked by tasks (see `ranked_subsets`) and meet the subjects'
    totals in a join on the number. The number of subsets itself is what the report asks for.
    """
    from strideline.operators.scan import quantiles, ranked

    item = hits.select(F.col(subject).alias("_sub"), F.col(hit).alias("_h"), F.col(n).alias("_n"), (groups if groups is not None else F.lit(0)).alias("_g"))
    numbered = ranked(item, [], "_sub", ["_sub"], "_i").select((F.col("_i") - 1).cast("int").alias("_i"), "_h", "_n", "_g")
    each = ranked_subsets(hits.sparkSession, hits.count(), size).select("subset", F.explode("members").alias("_i"))
    sums = each.join(numbered, "_i").groupBy("subset").agg(F.sum("_h").alias("h"), F.sum("_n").alias("n"), F.sum("_g").alias("in_g"))
    acc = sums.select((F.col("h") / F.col("n")).alias("acc"), "in_g")
    kinds = [F.lit("all")]
    if per_group:
        kinds += [F.when(F.col("in_g") == want, F.lit(name)) for name, want in per_group.items()]
    long = acc.withColumn("kind", F.explode(F.array_compact(F.array(*kinds))))
    stats = long.groupBy("kind").agg(F.count("*").alias("n_subsets"), F.avg("acc").alias("mean"), F.min("acc").alias("min"))
    return stats.join(quantiles(long, ["kind"], "acc", probs), "kind")
