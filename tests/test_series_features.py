import numpy as np
from pyspark.sql import functions as F

from strideline.operators import timeseries as ts


def _series(spark, lengths):
    rng = np.random.default_rng(3)
    rows = [(c, d, float(i), i, float(x)) for c, d, n in lengths for i, x in enumerate(rng.normal(size=n))]
    return rows, spark.createDataFrame(rows, "clip long, device string, t double, id long, x double").withColumn("seg", F.floor(F.col("t") / 7))


def test_index_grid_interpolates_and_broadcasts_no_series(spark):
    lengths = [(1, "a", 1), (1, "b", 2), (2, "a", 5), (2, "b", 32), (3, "a", 100), (4, "a", 33)]
    rows, d = _series(spark, lengths)
    g = ts.index_grid(d, ["clip", "device"], ["t", "id"], "seg", "x", 32)
    assert "BroadcastExchange" not in g._jdf.queryExecution().executedPlan().toString()
    got = {(r.clip, r.device, r.step): r.x for r in g.collect()}
    assert len(got) == 32 * len(lengths)
    for c, dev, n in lengths:
        x = [r[4] for r in rows if r[:2] == (c, dev)]
        want = np.interp(np.arange(32) * (n - 1) / 31, np.arange(n), x) if n > 1 else np.zeros(32)
        assert np.allclose([got[c, dev, s] for s in range(32)], want, atol=1e-12)


def test_statistics_of_short_and_long_series_agree_without_broadcast(spark):
    _, d = _series(spark, [(1, "a", 1), (1, "b", 3), (2, "a", 37), (3, "a", 50)])
    whole = ts.channel_statistics(d, ["clip", "device"], "t", "id", "x", "seg")
    assert "BroadcastExchange" not in whole._jdf.queryExecution().executedPlan().toString()
    split = ts.channel_statistics(d, ["clip", "device"], "t", "id", "x", "seg", direct=10)
    a, b = ([tuple(r) for r in x.orderBy("clip", "device").collect()] for x in (whole, split))
    assert [r[:2] for r in a] == [r[:2] for r in b] and np.allclose([r[2:] for r in a], [r[2:] for r in b], atol=1e-9)


def test_short_clips_derive_as_their_sql_does(spark, tmp_path):
    import duckdb

    from strideline.plans import load_all
    from strideline.plans.registry import REGISTRY

    load_all()
    vec = "transform(sequence(1, 64), k -> cast(sin(k * 3 + id * 7) as float)) as embedding"
    spark.range(8).filter("id < 3 or id > 4").selectExpr("id as vec_id", vec, "cast(id % 10 as int) as label").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    spark.range(10, 12).selectExpr("id as vec_id", vec, "cast(id % 10 as int) as label").write.mode("append").parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(15, 16).selectExpr("id as vec_id", vec, "cast(id % 10 as int) as label").write.mode("append").parquet(f"{tmp_path}/embeddings.parquet")
    for name, col in (("w17_physical_derivatives", "vel"), ("w17_acceleration", "acc")):
        got = sorted((r.clip, r.frame, r[col]) for r in REGISTRY[name].run(spark, str(tmp_path)).collect())
        want = sorted(con.execute(f"select clip, frame, {col} from ({REGISTRY[name].sql})").fetchall())
        assert len(got) == 9 and got == want
