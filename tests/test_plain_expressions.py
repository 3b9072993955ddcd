"""Costly expressions are evaluated once per row: neither copied below the scan's filter nor repeated for every splitter."""

from pyspark.sql import functions as F

from strideline.functions import posterior as P
from strideline.operators import fusion, sampling, scan


def plan(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def test_exploding_a_posterior_adds_no_filter(spark):
    d = spark.range(4).select("id", F.array(*[F.exp(F.col("id") * (k + 1)) for k in range(3)]).alias("p"))
    b = fusion.conditioned_blend(d.withColumn("q", F.col("p")), "p", "q", [1], 0.5, 0.25, 3).select("id", P.by_class("blended", 3))
    assert "Filter" not in plan(b)
    assert b.count() == 12


def test_the_value_is_bound_before_the_splitters(spark):
    d = spark.createDataFrame([(i, float(i % 50)) for i in range(400)], "id long, x double").withColumn("x", F.round(F.exp(F.col("x") / 9), 6))
    cut = scan.value_segments(d, [], "x", "seg", parts=16)
    assert plan(cut).lower().count("exp(") == 1
    assert [r[0] for r in scan.ranked(d, [], "x", ["id"], "r").orderBy("x", "id").select("r").collect()] == list(range(1, 401))


def test_masked_pool_ranks_only_what_it_keeps(spark):
    rows = [("a", i, float(i * 7 % 11)) for i in range(11)] + [("b", 0, 3.0), ("c", 1, -1.0), (None, 2, 5.0)]
    d = spark.createDataFrame(rows, "k string, id long, x double")
    out = fusion.masked_pool(d, ["k"], F.col("x") >= 0, "x", ["id"], 2)
    assert "WindowGroupLimit" in plan(out) and "percentile_approx" not in plan(out)
    got = {r.k: (r["max"], r.top_k_mean) for r in out.collect()}
    assert got == {"a": (10.0, 9.5), "b": (3.0, 3.0), "c": (0.0, 0.0), None: (5.0, 5.0)}


def test_places_without_sorting(spark):
    d = spark.createDataFrame([(1, 0, [0.2, 0.2, 0.6], 1), (1, 1, [0.5, 0.3, 0.2], 1), (2, 0, [0.1, 0.8, 0.1], 2), (2, 1, [1.0, 0.0, 0.0], 9)], "id long, member int, probs array<double>, label int")
    out = sampling.top_k_accuracy(d, "id", "label", [1, 2, 3], 3)
    assert "sort_array" not in plan(out)
    got = {r.member: (r.top_1, r.top_2, r.top_3) for r in out.collect()}
    assert got == {"0": (0.0, 0.0, 1.0), "1": (0.0, 1.0, 1.0), "any": (0.0, 0.5, 1.0)}
