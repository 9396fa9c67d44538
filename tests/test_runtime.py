from conftest import rows

from thesaurion import runtime
from thesaurion.runtime import Scratch, blank, keyed_join, trim_ws
from pyspark.sql import functions as F


def test_hot_keys_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(runtime, "HOT_ROWS", 50)
    left = spark.range(1000).selectExpr("case when id % 10 = 9 then null when id % 2 = 0 then 0 else id end k", "id v")
    side = spark.range(800).selectExpr("id k", "cast(id as string) name")
    for how in ("inner", "left"):
        want, got = left.join(side, ["k"], how), keyed_join(left, side, ["k"], how)
        assert got.columns == want.columns
        assert rows(got.na.fill("-").na.fill(-1)) == rows(want.na.fill("-").na.fill(-1))
    assert "BroadcastHashJoin" in keyed_join(left, side, ["k"])._jdf.queryExecution().toString()
    assert keyed_join(left.limit(0), side, ["k"]).count() == 0


def test_scratch_writes_once_and_drops(spark):
    from pathlib import Path

    s = Scratch(spark, "t")
    df = s.cut(spark.range(5).withColumn("r", F.rand()))
    assert rows(df) == rows(df) and df.count() == 5
    s.drop(df, None, spark.range(1))
    assert not Path(df._scratch_path.removeprefix("file://")).exists()


def test_white_space(spark):
    df = spark.createDataFrame([("\t a b \n",), (" ​",), ("",), (None,)], "s string")
    assert [tuple(r) for r in df.select(trim_ws(F.col("s")), blank(F.col("s"))).collect()] == [("a b", False), ("", True), ("", True), (None, True)]
