"""Column functions over vectors, inertial channels and windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalise(a, floor: float = 1e-9) -> Column:
    n = F.greatest(norm(a), F.lit(floor))
    return F.transform(_col(a), lambda x: x.cast("double") / n)


def cosine(a, b) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def distance(a, b) -> Column:
    return F.sqrt(
        F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)
    )


def magnitude(x, y, z) -> Column:
    x, y, z = _col(x), _col(y), _col(z)
    return F.sqrt(x * x + y * y + z * z)


def _cross(a, b):
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def rotate_to_world(q, v) -> list[Column]:
    """Three columns: v turned by the unit quaternion of q = (w, x, y, z); 0 where q has no length."""
    q, v = [_col(c) for c in q], [_col(c) for c in v]
    n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    size = F.when(n > 1e-8, n).otherwise(F.lit(1.0))
    w, axis = q[0] / size, [c / size for c in q[1:]]
    once = _cross(axis, v)
    twice = _cross(axis, once)
    return [F.when(n > 1e-8, v[i] + 2.0 * w * once[i] + 2.0 * twice[i]).otherwise(F.lit(0.0)) for i in range(3)]


def world_channels(acc, gyr, q, gravity: float = 1.0, gyro_scale: float = 500.0) -> dict[str, Column]:
    """Eight channels in world axes: dynamic acceleration, scaled turn rate, both magnitudes."""
    a = rotate_to_world(q, acc)
    a[2] = a[2] - F.lit(gravity)
    g = [c / F.lit(gyro_scale) for c in rotate_to_world(q, gyr)]
    clean = lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    out = dict(zip(("ax", "ay", "az"), a)) | dict(zip(("gx", "gy", "gz"), g))
    out |= {"a_mag": magnitude(*a), "g_mag": magnitude(*g)}
    return {k: clean(c) for k, c in out.items()}


def invariant_channels(acc, gyr, q, present) -> dict[str, Column]:
    """Thirteen channels that do not depend on mounting angle: the quaternion has w >= 0."""
    sign = F.when(_col(q[0]) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    out = {f"a{i}": _col(c) for i, c in enumerate(acc)} | {"a_mag": magnitude(*acc)}
    out |= {f"g{i}": _col(c) for i, c in enumerate(gyr)} | {"g_mag": magnitude(*gyr)}
    out |= {f"q{i}": _col(c) * sign for i, c in enumerate(q)}
    return out | {"present": _col(present).cast("double")}


# fixed divisors per channel group: degrees per second, degrees, magnetometer units
UNIT_SCALE = {"acc": 1.0, "gyr": 500.0, "ang": 180.0, "mag": 100.0, "quat": 1.0}


def unit_scaled(value, group) -> Column:
    divisor = F.create_map(*[F.lit(x) for kv in UNIT_SCALE.items() for x in kv])
    return _col(value) / divisor[_col(group)]


def quantise(a, bits: int) -> dict[str, Column]:
    """Symmetric codes of one row: scale = max|w| / (2^(bits-1) - 1), round half to even, clip."""
    top = 2 ** (bits - 1) - 1
    a = F.transform(_col(a), lambda x: x.cast("double"))
    scale = F.greatest(F.array_max(F.transform(a, F.abs)), F.lit(1e-12)) / F.lit(float(top))
    codes = F.transform(
        a, lambda x: F.greatest(F.least(F.rint(x / scale), F.lit(float(top))), F.lit(float(-top - 1))).cast("int")
    )
    return {"scale": scale, "codes": codes, "restored": F.transform(codes, lambda c: c * scale)}


def duration_feature(seconds, cap: float = 10.0) -> Column:
    s = F.greatest(F.least(_col(seconds), F.lit(cap)), F.lit(0.0))
    return F.log1p(s) / F.log(F.lit(cap + 1.0))


def phase_features(step, steps: int) -> dict[str, Column]:
    turn = F.lit(2.0) * F.pi() * _col(step) / F.lit(float(steps - 1))
    return {"phase_sin": F.sin(turn), "phase_cos": F.cos(turn)}


def ratio_gate(count, reference, low: float, high: float) -> Column:
    """True where a modality keeps its frames: no reference to compare with, or ratio in band."""
    c, r = _col(count), _col(reference)
    return F.when((c > 0) & (r > 0), (c / r).between(low, high)).otherwise(c > 0)


def square_window(x0, y0, x1, y1, width, height, margin: float, min_side, round_half_even: bool = True) -> dict[str, Column]:
    """Square crop around a box: widened by `margin`, at least `min_side`, kept inside the frame."""
    x0, y0, x1, y1, w, h = (_col(c) for c in (x0, y0, x1, y1, width, height))
    side = F.greatest(F.greatest(x1 - x0, y1 - y0) * F.lit(margin), _col(min_side))
    half = F.least(side, F.least(w, h).cast("double")) / 2.0
    cx = F.greatest(F.least((x0 + x1) / 2.0, w - half), half)
    cy = F.greatest(F.least((y0 + y1) / 2.0, h - half), half)
    r = (lambda c: F.bround(c, 0).cast("int")) if round_half_even else (lambda c: F.round(c, 0).cast("int"))
    return {"wx0": r(cx - half), "wy0": r(cy - half), "wx1": r(cx + half), "wy1": r(cy + half)}


def iou(a, b) -> Column:
    a, b = [_col(c) for c in a], [_col(c) for c in b]
    zero = F.lit(0.0)
    inter = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), zero) * F.greatest(
        F.least(a[3], b[3]) - F.greatest(a[1], b[1]), zero
    )
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.when(union > 0, inter / union).otherwise(zero)


def midpoint_indices(n, k: int) -> Column:
    """k segment centres of n items; empty input gives k zeros."""
    n = _col(n)
    steps = F.sequence(F.lit(0), F.lit(k - 1))
    centre = lambda i: F.floor((i + F.lit(0.5)) * (n - F.lit(1e-6)) / F.lit(float(k)))
    return F.transform(steps, lambda i: F.when(n <= 0, F.lit(0)).otherwise(F.least(F.greatest(centre(i), F.lit(0)), n - 1)).cast("int"))


def endpoint_indices(n, k: int) -> Column:
    """k indices from the first to the last item inclusive, rounded half to even."""
    n = _col(n)
    steps = F.sequence(F.lit(0), F.lit(k - 1))
    return F.transform(steps, lambda i: F.bround(i * (n - 1) / F.lit(float(max(k - 1, 1))), 0).cast("int"))
