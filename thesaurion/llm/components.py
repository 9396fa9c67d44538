"""Problem 5: pairwise matches consolidated into groups by alternating large-star and small-star rewrites.

Each rewrite keeps every group connected and links records to smaller ones; when neither changes the edges, every
record is linked to the least identifier of its group. Identifiers are integers in the order of the record keys, so
the least integer is the least key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thesaurion.runtime import Scratch, keyed_join


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every neighbour greater than a record is linked to the record's least neighbour (or the record itself)."""
    both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return keyed_join(both.where("v > u"), least, ["u"], total=n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame, n: int) -> DataFrame:
    """Every neighbour not greater than a record, and the record, are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = keyed_join(down, least, ["u"], total=n).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def groups(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(rec_key, group_key) for every record named by a link (a, b: strings); group_key is the group's least key.

    Repeated links and both directions count once; a link of a record with itself makes a group of one. A null end
    names nothing, its other end still counts as a record. No links give no rows. Other columns are ignored.
    A record that stands in a large share of all links is joined apart (see keyed_join); `min` combines before the shuffle."""
    ends = links.select(F.col("a").alias("k")).union(links.select(F.col("b"))).where(F.col("k").isNotNull()).distinct()
    ids = scratch.cut(ends.orderBy("k").withColumn("i", F.monotonically_increasing_id()))
    whole = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b").distinct()
    n = whole.count()
    edges = keyed_join(whole, ids.select(F.col("k").alias("a"), F.col("i").alias("u")), ["a"], total=n)
    edges = scratch.cut(keyed_join(edges, ids.select(F.col("k").alias("b"), F.col("i").alias("v")), ["b"], total=n).select("u", "v"))
    mark = _signature(edges)
    while True:
        wide = scratch.cut(large_star(edges, mark[0]))
        new = scratch.cut(small_star(wide, mark[0]))
        scratch.drop(edges, wide)
        edges, mark, before = new, _signature(new), mark
        if mark == before:
            break
    root = edges.select(F.col("u").alias("i"), F.col("v").alias("r"))
    member = ids.join(root, "i", "left").select("k", F.coalesce("r", "i").alias("i"))
    return keyed_join(member, ids.select("i", F.col("k").alias("group_key")), ["i"]).select(F.col("k").alias("rec_key"), "group_key")
