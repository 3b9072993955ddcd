"""Cells of a line are cut once and in one walk, and a row's values are cast once, however many columns and conditions use them."""

from pyspark.sql import functions as F

from strideline.sources import ingest as I

LINES = ["", "a", "a,b,,", '"a,b",c', '"a ""x"", b",c,"', 'a",b,"c",d', ' "a,b" ,c', '""', '"",x', ',",",', "a ,b"]


def test_cells_equal_a_look_ahead_over_quotes(spark):
    d = spark.createDataFrame([(x,) for x in LINES], "value string")
    cells = F.split("value", r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    want = F.transform(cells, lambda c: F.when(c.rlike(r'^\s*".*"\s*$'), F.regexp_replace(F.regexp_replace(c, r'^\s*"|"\s*$', ""), '""', '"')).otherwise(c))
    for r in d.select("value", I.split_cells(F.col("value")).alias("got"), want.alias("want")).collect():
        assert r.got == r.want, r.value


def test_a_line_is_cut_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text('time,device,"b(u,v)",a\n2024-01-01 00:00:00.5,"WTC(x,y)",1.5, 2\n2024-01-01 00:00:01,WTC,x,2\n2024-01-01 00:00:02,WTC,3\n')
    (tmp_path / "b.csv").write_text("time,device,a\n2024-01-01 00:00:00,WTC,1\n")
    d = I.read_sensor_csv(spark, str(tmp_path), {"a": ["a"], "b": ["b("]})
    assert [(r.device, r.a, r.b) for r in d.collect()] == [("WTC", 2.0, 1.5)]
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(value") == 1 and plan.count("try_cast") <= 2
