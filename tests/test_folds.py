from pyspark.sql import functions as F

from strideline.operators import folds as FO


def test_balanced_folds_of_many_rows(spark):
    d = spark.range(200_000).select(F.when(F.col("id") % 4 < 2, F.col("id") % 4).otherwise(F.col("id") % 4 + 7).alias("user"), F.lit(0).alias("label"))
    got = {r.user: r.fold for r in FO.balanced_folds(d, "user", "label", 1, 2).collect()}
    assert sorted(got) == [0, 1, 9, 10] and got[0] != got[1] and got[9] != got[10]
