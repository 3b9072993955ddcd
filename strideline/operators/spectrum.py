"""Real spectra of centred series, whatever their length.

Series short enough for one array go through a vectorised transform on Arrow batches. A longer
one is never gathered: its transform is written as a chirp convolution whose power-of-two
transforms are each split into many transforms of about the square root of the length, with a
shuffle between the two halves.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.operators.scan import ordered_scan

DIRECT_LENGTH = 65536
_FEATURES = T.StructType([T.StructField("low_share", T.DoubleType()), T.StructField("peak_bin", T.LongType())])
QUIET = 1e-9


def _share_and_peak(x: np.ndarray) -> tuple[float, int]:
    n = len(x)
    if n <= 3:
        return 0.0, 0
    amp = np.abs(np.fft.rfft(x - x.mean()))
    low = float(amp[: max(1, len(amp) // 4)].sum() / (amp.sum() + QUIET))
    return low, int(np.argmax(np.round(amp[1:], 6))) + 1


@F.pandas_udf(_FEATURES)
def _direct(series: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_share_and_peak(np.asarray(s, dtype=np.float64)) for s in series], columns=["low_share", "peak_bin"])


def array_features(series):
    """(low_share, peak_bin) of a series that is one array column."""
    return _direct(series)


def spectrum_features(df: DataFrame, keys: list[str], order: list[str], value: str, seg: str | None = None,
                      direct: int = DIRECT_LENGTH) -> DataFrame:
    """Low-quarter share of the amplitude spectrum and its peak bin (the mean removed)."""
    size = df.groupBy(*keys).agg(F.count("*").alias("n_samples"), F.avg(value).alias("_mu"))
    rows = df.join(size, keys)
    short = (
        rows.filter(F.col("n_samples") <= direct)
        .groupBy(*keys)
        .agg(F.max("n_samples").alias("n_samples"), F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_x")))).alias("_s"))
        .withColumn("_f", _direct(F.transform("_s", lambda s: s["_x"])))
    )
    out = short.select(*keys, "n_samples", "_f.low_share", "_f.peak_bin")
    longest = size.agg(F.max("n_samples")).first()[0] or 0
    if longest <= direct:
        return out
    long_rows = rows.filter(F.col("n_samples") > direct)
    return out.unionByName(_long_features(long_rows, keys, order, value, seg, longest))


def _long_features(rows, keys, order, value, seg, longest) -> DataFrame:
    indexed = ordered_scan(rows, keys, order, seg, row="_row").select(
        *keys, "n_samples", (F.col("_row") - 1).alias("i"), (F.col(value) - F.col("_mu")).alias("re"), F.lit(0.0).alias("im")
    )
    amp = long_spectrum(indexed, keys, longest)
    bins = F.floor(F.col("n_samples") / 2) + 1
    kept = amp.filter(F.col("_bin") < bins)
    low = F.sum(F.when(F.col("_bin") < F.greatest(F.lit(1), F.floor(bins / 4)), F.col("amp")).otherwise(0.0))
    peak = F.max(F.when(F.col("_bin") > 0, F.struct(F.round("amp", 6).alias("a"), (-F.col("_bin")).alias("b"))))["b"]
    return kept.groupBy(*keys, "n_samples").agg((low / (F.sum("amp") + QUIET)).alias("low_share"), (-peak).cast("long").alias("peak_bin"))


def long_spectrum(indexed: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """(keys, n_samples, _bin, amp) of series given as (keys, n_samples, i, re, im)."""
    m = 1 << math.ceil(math.log2(2 * longest - 1))
    n, i = F.col("n_samples"), F.col("i")
    # chirp angle pi * i^2 / n, reduced exactly before it becomes a double
    angle = lambda j: F.pi() * ((j.cast("decimal(19,0)") * j.cast("decimal(19,0)")) % (n * 2)).cast("double") / n
    c, s = F.cos(angle(i)), F.sin(angle(i))
    a = indexed.select(*keys, "n_samples", "i", (F.col("re") * c + F.col("im") * s).alias("re"), (F.col("im") * c - F.col("re") * s).alias("im"))
    mirrored = F.when(i == 0, F.array(i)).otherwise(F.array(i, F.lit(m) - i))
    b = indexed.select(*keys, "n_samples", F.explode(mirrored).alias("i"), c.alias("re"), s.alias("im"))
    fa = _split_fft(a, keys, m).withColumnsRenamed({"re": "ar", "im": "ai"})
    fb = _split_fft(b, keys, m).withColumnsRenamed({"re": "br", "im": "bi"})
    on = [*keys, "n_samples", "i"]
    prod = fa.join(fb, on).select(
        *on, (F.col("ar") * F.col("br") - F.col("ai") * F.col("bi")).alias("re"),
        (-(F.col("ar") * F.col("bi") + F.col("ai") * F.col("br"))).alias("im"),
    )
    conv = _split_fft(prod, keys, m)  # conjugated input: the inverse up to conjugation and 1/m
    return conv.select(*keys, "n_samples", i.alias("_bin"), (F.sqrt(F.col("re") ** 2 + F.col("im") ** 2) / float(m)).alias("amp"))


def _split_fft(df: DataFrame, keys: list[str], m: int) -> DataFrame:
    """Transform of length m = m1 * m2 of sparse rows (keys, n_samples, i, re, im), by columns then rows."""
    m1 = 1 << (int(math.log2(m)) // 2)
    m2 = m // m1
    names = [*keys, "n_samples"]
    head = [f for f in df.schema.fields if f.name in names]
    schema = T.StructType([*head, T.StructField("i", T.LongType()), T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])

    def half(size, place, spread):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            z = np.zeros(size, dtype=np.complex128)
            slot, rest = place(pdf["i"].to_numpy())
            z[slot] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
            index, y = spread(np.fft.fft(z), rest[0])
            out = pd.DataFrame({c: [pdf[c].iloc[0]] * size for c in names})
            return out.assign(i=index, re=y.real, im=y.imag)

        return run

    # i = i1 + m1 * i2: transform over i2 for each i1, twiddle, then over i1 for each k2
    def first(y, i1):
        k2 = np.arange(m2)
        return i1 + m1 * k2, y * np.exp(-2j * np.pi * ((i1 * k2) % m) / m)

    def second(y, k2):
        return k2 + m2 * np.arange(m1), y

    columns = df.groupBy(*names, (F.col("i") % m1).alias("_g")).applyInPandas(half(m2, lambda i: (i // m1, i % m1), first), schema)
    return columns.groupBy(*names, F.floor(F.col("i") / m1).alias("_g")).applyInPandas(half(m1, lambda i: (i % m1, i // m1), second), schema)
