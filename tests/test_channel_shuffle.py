"""Statistics of series that fit one array take one shuffle of the rows, and equal those of the segmented scan."""

import re

from pyspark.sql import functions as F

from strideline.operators import timeseries as ts


def test_short_series_meet_once(spark):
    rows = [(None if k == 5 else k, float(t), 100 * k + t, None if (k, t) == (2, 3) else float((t * t + k) % 7), t // 3) for k in range(6) for t in range(1 + 2 * k)]
    d = spark.createDataFrame(rows, "k long, t double, id long, x double, seg int")
    whole = ts.channel_statistics(d, ["k"], "t", "id", "x", "seg")
    assert not re.search("Join", whole._jdf.queryExecution().optimizedPlan().toString())
    cut = ts.channel_statistics(d.unionByName(spark.range(50).select(F.lit(99).cast("long").alias("k"), F.col("id").cast("double").alias("t"), "id", F.col("id").cast("double").alias("x"), F.floor(F.col("id") / 9).cast("int").alias("seg"))), ["k"], "t", "id", "x", "seg", direct=40)
    near = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    got, want = ({r.k: near(r) for r in d.collect()} for d in (whole, cut.filter("k is null or k <> 99")))
    assert len(got) == 6 and got == want
