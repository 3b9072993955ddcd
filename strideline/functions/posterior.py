"""Column functions over one posterior: an `array<double>` of class probabilities.

Given the number of classes `n`, an expression is spelled out per class, so it compiles into the
stage's generated code; without it a higher-order function does the same for any length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_FLOOR = 1e-12


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def items(p, n: int) -> list[Column]:
    """The n entries of an array column; a list of columns is taken as it is, which keeps trees small."""
    if isinstance(p, list):
        return p
    p = _col(p)
    return [p[i] for i in range(n)]


def log_items(p, n: int, floor: float = LOG_FLOOR) -> list[Column]:
    return [F.log(F.greatest(x, F.lit(floor))) for x in items(p, n)]


def normalise_items(xs: list[Column]) -> list[Column]:
    s = sum_columns(xs)
    return [x / s for x in xs]


def softmax_items(xs: list[Column]) -> list[Column]:
    top = F.greatest(*xs)
    return normalise_items([F.exp(x - top) for x in xs])


def total(p, n: int | None = None) -> Column:
    if n:
        return sum_columns(items(p, n))
    return F.aggregate(_col(p), F.lit(0.0), lambda acc, x: acc + x)


def violation(p, n_classes: int) -> Column:
    """Why a row is not a posterior, or NULL: wrong length, not finite, negative, zero sum."""
    p = _col(p)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return (
        F.when(p.isNull() | (F.size(p) != n_classes), F.lit("length"))
        .when(F.exists(p, bad), F.lit("not_finite"))
        .when(F.exists(p, lambda x: x < 0), F.lit("negative"))
        .when(total(p) <= 0, F.lit("zero_sum"))
    )


def normalise(p, n: int | None = None) -> Column:
    if n:
        return F.array(*normalise_items(items(p, n)))
    p = _col(p)
    s = total(p)
    return F.transform(p, lambda x: x / s)


def validated(p, n_classes: int) -> Column:
    """The posterior divided by its sum, NULL where `violation` names a reason."""
    return F.when(violation(p, n_classes).isNull(), normalise(p))


def laplace(p, s: float, n_classes: int) -> Column:
    return F.array(*[(x + F.lit(s)) / F.lit(1.0 + n_classes * s) for x in items(p, n_classes)])


def safe_log(p, floor: float = LOG_FLOOR, n: int | None = None) -> Column:
    if n:
        return F.array(*log_items(p, n, floor))
    return F.transform(_col(p), lambda x: F.log(F.greatest(x, F.lit(floor))))


def softmax(z, n: int | None = None) -> Column:
    """exp(z - max z), divided by its sum."""
    if n:
        return F.array(*softmax_items(items(z, n)))
    z = _col(z)
    top = F.array_max(z)
    e = F.transform(z, lambda x: F.exp(x - top))
    return normalise(e)


def argmax(p, digits: int | None = None, n: int | None = None) -> Column:
    """Index of the largest entry, the first one on ties (after rounding, if asked)."""
    if n:
        xs = items(p, n) if digits is None else [F.rint(x * F.lit(10.0**digits)) for x in items(p, n)]
        top = F.greatest(*xs)
        out = F.when(xs[0] == top, 0)
        for i in range(1, n):
            out = out.when(xs[i] == top, i)
        return out
    p = _col(p)
    if digits is not None:
        p = F.transform(p, lambda x: F.round(x, digits))
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def ranked_classes(p) -> Column:
    """Class ids by probability descending, class id ascending."""
    pairs = F.transform(_col(p), lambda x, i: F.struct((-x).alias("neg"), i.alias("cls")))
    return F.transform(F.sort_array(pairs), lambda s: s["cls"].cast("int"))


def top_k(p, k: int) -> Column:
    return F.slice(ranked_classes(p), 1, k)


def top2_margin(p) -> Column:
    ordered = F.sort_array(_col(p), asc=False)
    return ordered[0] - ordered[1]


def confidence(p, n: int | None = None) -> Column:
    if n:
        return F.greatest(*items(p, n))
    return F.array_max(_col(p))


def entropy(p, floor: float = LOG_FLOOR, n: int | None = None) -> Column:
    if n:
        return -sum_columns([x * F.log(F.greatest(x, F.lit(floor))) for x in items(p, n)])
    return F.aggregate(_col(p), F.lit(0.0), lambda acc, x: acc - x * F.log(F.greatest(x, F.lit(floor))))


def temper(p, temperature, n: int | None = None) -> Column:
    """Soften (T > 1) or sharpen (T < 1): softmax of log p / T."""
    t = F.lit(temperature) if isinstance(temperature, (int, float)) else _col(temperature)
    if n:
        return F.array(*softmax_items([x / t for x in log_items(p, n)]))
    return softmax(F.transform(safe_log(p), lambda x: x / t))


def divide_prior(p, prior, n: int | None = None) -> Column:
    """Move a train-prior posterior to uniform-prior space and re-normalise."""
    if n:
        return F.array(*normalise_items([x / q for x, q in zip(items(p, n), items(prior, n))]))
    return normalise(F.zip_with(_col(p), _col(prior), lambda x, q: x / q))


def geometric_blend(a, b, weight, n: int | None = None) -> Column:
    """softmax((1-w) log a + w log b)."""
    w = F.lit(weight) if isinstance(weight, (int, float)) else _col(weight)
    if n:
        return F.array(*softmax_items([(F.lit(1.0) - w) * x + w * y for x, y in zip(log_items(a, n), log_items(b, n))]))
    return softmax(F.zip_with(safe_log(a), safe_log(b), lambda x, y: (F.lit(1.0) - w) * x + w * y))


def linear_blend(a, b, weight, n: int | None = None) -> Column:
    w = F.lit(weight) if isinstance(weight, (int, float)) else _col(weight)
    if n:
        return F.array(*[(F.lit(1.0) - w) * x + w * y for x, y in zip(items(a, n), items(b, n))])
    return F.zip_with(_col(a), _col(b), lambda x, y: (F.lit(1.0) - w) * x + w * y)


def power_pool(a, b, class_weights: list[float], power: float, floor: float = 1e-8) -> Column:
    """Power mean with one weight per class; power 0 is the geometric mean, 1 the arithmetic one."""
    n = len(class_weights)
    if power == 0:
        logs = zip(log_items(a, n), log_items(b, n), class_weights)
        return F.array(*softmax_items([F.lit(1.0 - w) * x + F.lit(float(w)) * y for x, y, w in logs]))

    def scaled(p):
        top = F.greatest(confidence(p, n), F.lit(LOG_FLOOR))
        return [F.greatest(x / top, F.lit(floor)) for x in items(p, n)]

    mix = lambda x, y, w: F.lit(1.0 - w) * F.pow(x, F.lit(power)) + F.lit(float(w)) * F.pow(y, F.lit(power))
    mixed = [F.pow(F.greatest(mix(x, y, w), F.lit(LOG_FLOOR)), F.lit(1.0 / power)) for x, y, w in zip(scaled(a), scaled(b), class_weights)]
    return F.array(*normalise_items(mixed))


def restrict(p, classes: list[int]) -> Column:
    """Zero every class outside the set and re-normalise what is left."""
    kept = F.transform(_col(p), lambda x, i: F.when(i.isin(classes), x).otherwise(F.lit(0.0)))
    s = F.greatest(total(kept), F.lit(LOG_FLOOR))
    return F.transform(kept, lambda x: x / s)


def by_class(p, n: int) -> Column:
    """posexplode of a posterior, entry by entry. Given a mere column, Spark adds a filter on its size and pushes it below
    the projections, where the whole expression is spelled out and evaluated once more for every use."""
    return F.posexplode(F.array(*items(p, n)))


def place_of(xs: list[Column], own: Column, label) -> Column:
    """1-based place of a class by probability descending, class id ascending, among the entries `xs`; `own` is the
    class's own entry, and NULL where there is no such class."""
    ahead = [F.when((x > own) | ((x == own) & (F.lit(i) < _col(label))), 1).otherwise(0) for i, x in enumerate(xs)]
    return F.when(own.isNotNull(), sum_columns(ahead) + 1)


def sum_columns(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def vector_agg(agg, p, n: int) -> Column:
    """Element-wise aggregate of fixed-width vectors: `n` plain aggregates, so Spark combines
    them map-side and no list of rows is ever collected."""
    p = _col(p)
    return F.array(*[agg(p[i]) for i in range(n)])
