"""Quality rules: count limits, and robust multivariate outliers by the minimum covariance determinant.

Per language and source, transformed statistics of the documents get a centre and a covariance from the share
`CORE` of the group that lies closest: concentration steps repeat "distances, closest share, new moments", from two
deterministic starts, until no determinant falls any more; the start with the smaller determinant wins. All documents
together get such an estimate, too, and a group's centre and covariance are drawn towards it by n / (n + `PRIOR_ROWS`),
so that a group of any size is judged by one rule. Documents far from the centre by Mahalanobis distance are rejected.
Each statistic has a tolerance, whose square is added to the variance, as most groups have no variance at all in a
statistic such as symbols.

All of it is DataFrame aggregation: sums of integers (statistics in thousandths), so that results do not depend on
the order of rows, exact percentiles over a bounded number of rounded values, and a Cholesky factor in columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import stored
from strideline.llm.textstats import with_stats
from strideline.session import cut_lineage

CORE = 0.75
PRIOR_ROWS = 30
UNIT = 1000
ALL = "*"
BROADCAST_ROWS = 100_000
SALTS = 16


def _rate(count: str, of: str) -> Column:
    return F.log1p(F.col(count) * 1000.0 / F.greatest(F.col(of), F.lit(1)))


def _share(count: str, of: str) -> Column:
    return F.col(count) / F.greatest(F.col(of), F.lit(1))


# statistic: (its transformed value, its tolerance). Tolerances leave room: from a centre at 0 each statistic can pass
# the cut alone, duplicate lines at a share of 0.51 and repeated words at 0.46, and the two together at 0.34
STATISTICS = {
    "word_length": (lambda: F.log1p(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))), 0.12),
    "symbols": (lambda: _rate("n_symbols", "n_words"), 0.8),
    "dup_lines": (lambda: _share("n_dup_lines", "n_lines"), 0.1),
    "repeats": (lambda: _share("n_repeat_words", "n_words"), 0.09),
    "upper": (lambda: F.log1p(10.0 * F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))), 0.25),
}
P = len(STATISTICS)
XS = [f"_x{j}" for j in range(P)]


def gamma_share(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series."""
    term = total = 1.0 / a
    for k in range(1, 500):
        term *= x / (a + k)
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi_square_limit(p: int, share: float) -> float:
    lo, hi = 0.0, 400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gamma_share(p / 2, mid / 2) < share else (lo, mid)
    return hi


CUTOFF = chi_square_limit(P, 0.9999)
CONSISTENCY = CORE / gamma_share(P / 2 + 1, chi_square_limit(P, CORE) / 2)


def _factor(t: DataFrame, scale: float) -> DataFrame:
    """Cholesky factor `_l<i>_<j>` and log-determinant `_det` of the covariances `_s<i>_<j>` times `scale`, tolerances added."""
    for i in range(P):
        for j in range(i + 1):
            floor = (list(STATISTICS.values())[i][1] * UNIT) ** 2 if i == j else 0.0
            rest = F.col(f"_s{i}_{j}") * scale + floor
            for k in range(j):
                rest = rest - F.col(f"_l{i}_{k}") * F.col(f"_l{j}_{k}")
            t = t.withColumn(f"_l{i}_{j}", F.sqrt(rest) if i == j else rest / F.col(f"_l{j}_{j}"))
    det = sum((F.log(F.col(f"_l{i}_{i}")) for i in range(1, P)), F.log(F.col("_l0_0")))
    return t.withColumn("_det", det)


def _distance() -> Column:
    """Squared Mahalanobis distance of `_x` from `_m`, by forward substitution with `_l`."""
    ys: list[Column] = []
    for i in range(P):
        rest = F.col(XS[i]) - F.col(f"_m{i}")
        for k in range(i):
            rest = rest - F.col(f"_l{i}_{k}") * F.col(f"_y{k}")
        ys.append(rest / F.col(f"_l{i}_{i}"))
    return ys


PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _attached(d: DataFrame, per_group: DataFrame, keys: list[str]) -> DataFrame:
    """`d` with the one row per key of `per_group`: broadcast up to `BROADCAST_ROWS` rows, else joined on salted keys, as
    one language and source may hold most rows."""
    if per_group.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return d.join(F.broadcast(per_group), keys)
    salted = per_group.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return d.withColumn("_salt", F.pmod(F.xxhash64(*XS), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"]).drop("_salt")


def _measured(d: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    d = _attached(d, models, keys)
    for i, y in enumerate(_distance()):
        d = d.withColumn(f"_y{i}", y)
    return d.withColumn("_d2", sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(1, P)), F.col("_y0") * F.col("_y0")))


def _moments(d: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, means `_m` and covariances `_s` per key, from sums of integers."""
    sums = d.groupBy(*keys).agg(
        F.count("*").alias("_n"), *[F.sum(x).alias(f"_t{i}") for i, x in enumerate(XS)], *[F.sum(F.col(XS[i]) * F.col(XS[j])).alias(f"_q{i}_{j}") for i, j in PAIRS]
    )
    n = F.col("_n").cast("double")
    t = sums.withColumns({f"_m{i}": F.col(f"_t{i}") / n for i in range(P)})
    t = t.withColumns({f"_s{i}_{j}": F.col(f"_q{i}_{j}") / n - F.col(f"_m{i}") * F.col(f"_m{j}") for i, j in PAIRS})
    return t.select(*keys, *MOMENTS)


MOMENTS = [f"_m{i}" for i in range(P)] + [f"_s{i}_{j}" for i, j in PAIRS]


def _median_start(d: DataFrame) -> DataFrame:
    """Second start: coordinate-wise medians, and the tolerances as a diagonal covariance."""
    t = d.groupBy("_grp").agg(*[F.percentile(x, F.lit(0.5)).alias(f"_m{i}") for i, x in enumerate(XS)])
    return t.withColumns({f"_s{i}_{j}": F.lit(0.0) for i, j in PAIRS})


def robust_moments(d: DataFrame) -> DataFrame:
    """One row per `_grp` of `d` (_grp, statistics), and one for all rows as group `ALL`, with the mean and covariance of
    the closest share of its rows. A step is taken where the determinant falls; groups that have come to rest leave the
    loop, which ends when none is left: each step lowers a determinant that the tolerances bound from below."""
    d = d.select("_grp", *XS).unionByName(d.select(F.lit(ALL).alias("_grp"), *XS))
    keys = ["_grp", "_start"]
    starts = _moments(d, ["_grp"]).withColumn("_start", F.lit(0)).unionByName(_median_start(d).withColumn("_start", F.lit(1)))
    models = cut_lineage(_factor(starts, 1.0).withColumn("_live", F.lit(True)))
    both = d.withColumn("_start", F.explode(F.array(F.lit(0), F.lit(1))))
    first = True
    while True:
        live = models.filter("_live").select(*keys, *[f"_m{i}" for i in range(P)], *[f"_l{i}_{j}" for i, j in PAIRS])
        near = _measured(both, live, keys).withColumn("_r", F.floor(F.log1p("_d2") * UNIT)).select(*keys, *XS, "_r")
        cut = cut_lineage(near.groupBy(*keys).agg(F.percentile("_r", F.lit(CORE)).alias("_cut")))
        moved = _factor(_moments(_attached(near, cut, keys).filter("_r <= _cut"), keys), 1.0)
        # the first step leaves the starts behind, whose determinants are of other sets of rows
        falls = F.lit(first) | (F.col("_new._det") < F.col("_det") - 1e-9)
        d2 = models.join(moved.select(*keys, F.struct("_det", *MOMENTS, *[f"_l{i}_{j}" for i, j in PAIRS]).alias("_new")), keys, "left")
        step = F.coalesce(F.col("_live") & falls, F.lit(False))
        models = cut_lineage(d2.select(*keys, step.alias("_live"), *[F.when(step, F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in models.columns if c not in (*keys, "_live")]))
        first = False
        if models.filter("_live").isEmpty():
            break
    best = models.groupBy("_grp").agg(F.min_by("_start", F.struct("_det", "_start")).alias("_start"))
    return models.join(best, keys).select("_grp", *MOMENTS)


def group_models(d: DataFrame) -> DataFrame:
    """One row per `_grp` with the centre and Cholesky factor that judge its rows: its own estimate drawn towards that of all rows."""
    found = robust_moments(d)
    every = found.filter(F.col("_grp") == ALL).select(F.struct(*MOMENTS).alias("_all"))
    sizes = d.groupBy("_grp").agg(F.count("*").alias("_rows"))
    t = found.join(sizes, "_grp").crossJoin(F.broadcast(every))  # one row
    own = F.col("_rows") / (F.col("_rows") + F.lit(PRIOR_ROWS))
    t = t.select("_grp", *[(own * F.col(c) + (1 - own) * F.col("_all")[c]).alias(c) for c in MOMENTS])
    return cut_lineage(_factor(t, CONSISTENCY).select("_grp", *[f"_m{i}" for i in range(P)], *[f"_l{i}_{j}" for i, j in PAIRS]))


def quality_verdicts(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Counts and verdict of every row of `docs` (doc_id, text, lang, source; other columns are ignored):
    `doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept`.

    NULL text has no words and fails. NULL languages and sources form groups of their own. Repeated rows are judged one
    by one; an empty table gives no rows.
    """
    d = with_stats(docs.select("doc_id", "text", "lang", "source")).drop("text")
    for x, (value, _) in zip(XS, STATISTICS.values()):
        d = d.withColumn(x, F.round(value() * UNIT).cast("long"))
    d = stored(d.withColumn("_grp", F.to_json(F.struct("lang", "source"))), "stats")
    rows = _measured(d, group_models(d.select("_grp", *XS)), ["_grp"])
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    rows = rows.withColumns({"base_failed": failed, "distance": F.sqrt("_d2")})
    kept = ~F.col("base_failed") & (F.col("_d2") <= CUTOFF)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))
