from datetime import datetime

from conftest import rows

from thesaurion.operators.orphans import orphan_references
from thesaurion.plans.problems import gene_key
from pyspark.sql import functions as F

REFS = "kind string, ref_table string, key string, feed_seq long, received_at timestamp, yyyymm int, reason string, deleted string, period int"
PARENTS = "kind string, key string, deleted boolean, first_at timestamp"


def t(day, month=1):
    return datetime(2020, month, day)


def found(spark, scratch, refs, parents):
    r = spark.createDataFrame([("k", "t", key, i, at, None if at is None else at.year * 100 + at.month, "x", "y", 5) for i, (key, at) in enumerate(refs)], REFS)
    return rows(orphan_references(r, spark.createDataFrame([("k", *p) for p in parents], PARENTS), scratch).select("feed_seq", "reason"))


def test_reasons(spark, scratch):
    parents = [("there", False, t(5)), ("gone", True, t(1)), ("soon", False, t(20)), ("next", False, t(1, 3))]
    refs = [("there", t(6)), ("there", t(4)), ("gone", t(9)), ("never", t(9)), ("soon", t(21)), ("soon", t(19)), ("next", t(1)), ("next", t(2, 3)), (None, t(1)), ("never", t(9)), ("there", t(1, 4)), ("never", None), ("there", None)]
    assert found(spark, scratch, refs, parents) == [(1, "late"), (2, "deleted"), (3, "missing"), (5, "late"), (6, "late"), (9, "missing"), (11, "missing")]


def test_empty_sides(spark, scratch):
    assert found(spark, scratch, [], [("a", False, t(1))]) == []
    assert found(spark, scratch, [("a", t(1))], []) == [(0, "missing")]


def test_many_keys(spark, scratch):
    n = 70_000  # more than two key ranges
    refs = spark.range(n).selectExpr("'k' kind", "'t' ref_table", "cast(if(id % 3 = 0, 0, id) as string) key", "id feed_seq", "timestamp'2020-02-02' received_at", "202002 yyyymm")
    parents = spark.range(n).where("id % 2 = 0").selectExpr("'k' kind", "cast(id as string) key", "false deleted", "timestamp'2020-01-01' first_at")
    out = orphan_references(refs, parents, scratch)
    assert out.count() == refs.where("cast(key as int) % 2 = 1").count()
    assert out.where("reason <> 'missing'").count() == 0


def test_gene_key(spark):
    df = spark.createDataFrame([(" r-hsx-12.3\t",), ("R-HSX-12",), (" ",), (None,)], "g string")
    assert [r[0] for r in df.select(gene_key(F.col("g"))).collect()] == ["R-HSX-12", "R-HSX-12", None, None]
