"""Integer vectors from columns of floating-point arrays, inside Python workers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 64
LARGEST = float(1 << 52)


def vector_of(name: str) -> Column:
    return F.col(name).cast("array<double>")


def is_finite(v: Column) -> Column:
    """Whether a vector is there, has entries, and none of them is NULL, infinite or not a number."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)), F.lit(False))


def floors(arrays: pa.Array, dims: int, largest: float = LARGEST) -> np.ndarray:
    """floor(64 * x) of a batch's vectors (all of `dims` entries) as an integer matrix; entries beyond `largest` raise."""
    flat = arrays.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.floor(flat * SCALE)
    if len(out) and np.abs(out).max() > largest:
        raise ValueError(f"a vector's entry is beyond {largest:.0f} in units of 1/{SCALE}: results would not fit a long")
    return out.astype(np.int64).reshape(-1, dims)


def usual_length(vectors: DataFrame, name: str) -> int:
    """The most frequent length of the finite vectors, the smaller one on ties; 0 without any."""
    v = vector_of(name)
    sizes = vectors.select(v.alias("_v")).filter(is_finite(F.col("_v"))).groupBy(F.size("_v").alias("_n")).agg(F.count("*").alias("_c"))
    best = sizes.agg(F.max_by("_n", F.struct("_c", -F.col("_n")))).first()[0]
    return best or 0
