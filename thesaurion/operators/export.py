"""Graph exports and walks for model training outside (Z-01 to Z-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from thesaurion.runtime import Scratch


def dense_ids(rows: DataFrame, order: list[str], name: str, scratch: Scratch) -> DataFrame:
    """O-08: rows with 0-based dense numbers in order. Sorted by ranges; a part's offset is the size of the parts before it,
    so no task sees more than its range."""
    parts = scratch.cut(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offset = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_o"))  # one row per part
    return parts.join(F.broadcast(offset), "_part").withColumn(name, F.col("_at") + F.col("_o")).drop("_part", "_at", "_o")


def export_nodes(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Z-01: (nid, prefix, concept_id) of all nodes with a link other than similar_to, sorted."""
    e = edges.where("rel_type <> 'similar_to'")
    ends = e.select(F.col("prefix_from").alias("prefix"), F.col("id_from").alias("concept_id")).union(e.select("prefix_to", "id_to")).distinct()
    return dense_ids(ends, ["prefix", "concept_id"], "nid", scratch).select("nid", "prefix", "concept_id")


def export_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Z-02: distinct (src, rel, dst); rel is the kind of link, or each key of an ohdsi_relationship."""
    keys = F.when((F.col("rel_type") == "ohdsi_relationship") & (F.size(F.coalesce("keys", F.array().cast("array<string>"))) > 0), F.col("keys")).otherwise(F.array("rel_type"))
    rows = edges.where("rel_type <> 'similar_to'").withColumn("rel", F.explode(keys))
    a = nodes.select(F.col("nid").alias("src"), F.col("prefix").alias("prefix_from"), F.col("concept_id").alias("id_from"))
    b = nodes.select(F.col("nid").alias("dst"), F.col("prefix").alias("prefix_to"), F.col("concept_id").alias("id_to"))
    return rows.join(a, ["prefix_from", "id_from"]).join(b, ["prefix_to", "id_to"]).select("src", "rel", "dst").distinct()


def relation_ids(exported: DataFrame) -> DataFrame:
    """Numbers of the relation names, in order of name; a small table."""
    return exported.select("rel").distinct().withColumn("rel_id", F.row_number().over(W.orderBy("rel")) - 1)


def with_embedding(nodes: DataFrame, exported: DataFrame, vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Z-03, Z-05: nodes that have a vector and a link between such nodes, numbered anew, and those links."""
    have = nodes.join(vectors.select("prefix", "concept_id").distinct(), ["prefix", "concept_id"], "left_semi")
    ids = have.select("nid")
    left = exported.join(ids.withColumnRenamed("nid", "src"), "src", "left_semi").join(ids.withColumnRenamed("nid", "dst"), "dst", "left_semi")
    linked = left.select(F.col("src").alias("nid")).union(left.select("dst")).distinct()
    kept = dense_ids(have.join(linked, "nid", "left_semi").withColumnRenamed("nid", "old"), ["prefix", "concept_id"], "nid", scratch)
    a, b = kept.select(F.col("old").alias("src"), F.col("nid").alias("s2")), kept.select(F.col("old").alias("dst"), F.col("nid").alias("d2"))
    return kept.select("nid", "prefix", "concept_id"), left.join(a, "src").join(b, "dst").select(F.col("s2").alias("src"), "rel", F.col("d2").alias("dst"))


def csr(exported: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Z-07: (nid, degree, start) over the links and their inverses; start is the running sum of degrees before the node.
    The running sum is made per range of nodes and shifted by the ranges before, so that it is no single task."""
    both = exported.select(F.col("src").alias("nid")).union(exported.select("dst"))
    deg = nodes.select("nid").join(both.groupBy("nid").agg(F.count(F.lit(1)).alias("degree")), "nid", "left").select("nid", F.coalesce("degree", F.lit(0)).alias("degree"))
    rows = scratch.cut(deg.withColumn("r", F.shiftright("nid", 16)))
    before = rows.groupBy("r").agg(F.sum("degree").alias("d"))
    before = before.select("r", (F.sum("d").over(W.orderBy("r")) - F.col("d")).alias("o"))  # one row per 65536 nodes
    here = F.sum("degree").over(W.partitionBy("r").orderBy("nid")) - F.col("degree")
    return rows.withColumn("here", here).join(before, "r").select("nid", "degree", (F.col("here") + F.col("o")).alias("start"))


def random_walks(exported: DataFrame, scratch: Scratch, steps: int, walks: int = 1, seed: int = 0) -> DataFrame:
    """Z-08: (start, walk, tokens): node and relation tokens in turn, links walked both ways, a walk at a dead end starts
    again at its start. Each step picks among a node's links by a hash of walk and step, so that a run can be repeated."""
    out = exported.select(F.col("src").alias("n"), F.col("rel").alias("r"), F.col("dst").alias("m")).union(exported.select("dst", F.concat("rel", F.lit("^-1")), "src"))
    number = F.row_number().over(W.partitionBy("n").orderBy("r", "m")) - 1
    out = scratch.cut(out.distinct().withColumn("k", number))
    deg = out.groupBy("n").agg(F.count(F.lit(1)).alias("deg"))
    front = out.select(F.col("n").alias("start")).distinct().withColumn("walk", F.explode(F.sequence(F.lit(1), F.lit(walks))))
    front = front.withColumn("n", F.col("start")).withColumn("tokens", F.array(F.col("start").cast("string")))
    for i in range(steps):
        turn = front.join(deg, "n").withColumn("k", F.pmod(F.xxhash64("start", "walk", F.lit(i), F.lit(seed)), F.col("deg")).cast("int"))
        front = scratch.cut(turn.join(out, ["n", "k"]).select("start", "walk", F.col("m").alias("n"), F.concat("tokens", F.array(F.col("r"), F.col("m").cast("string"))).alias("tokens")))
    return front.select("start", "walk", "tokens")


def skip_grams(sequences: DataFrame, key: str, tokens: str, window: int) -> DataFrame:
    """Z-08b: (key, centre, context): pairs of tokens at most window places apart; no join, the pairs are made in the row."""
    t = F.col(tokens)
    rows = sequences.select(key, t.alias("t"), F.posexplode(t).alias("i", "centre"))
    near = F.concat(F.slice("t", F.greatest(F.col("i") - window, F.lit(0)) + 1, F.least(F.lit(window), F.col("i"))), F.slice("t", F.col("i") + 2, F.lit(window)))
    return rows.select(key, "centre", F.explode(near).alias("context"))


def subtree_types(reached: DataFrame, roots: DataFrame, nodes: DataFrame, rest: str = "structural") -> DataFrame:
    """Z-10: (prefix, concept_id, type): the type of the last listed root above a node (or itself), else `rest`.

    reached: as from graph.reach; roots: prefix, concept_id, type, priority (greater is later)."""
    own = roots.select("prefix", "concept_id", "type", "priority")
    down = reached.join(own.select(F.col("prefix").alias("root_prefix"), F.col("concept_id").alias("root_id"), "type", "priority"), ["root_prefix", "root_id"]).select("prefix", "concept_id", "type", "priority")
    best = own.union(down).groupBy("prefix", "concept_id").agg(F.max_by("type", F.struct("priority", "type")).alias("type"))
    return nodes.select("prefix", "concept_id").distinct().join(best, ["prefix", "concept_id"], "left").select("prefix", "concept_id", F.coalesce("type", F.lit(rest)).alias("type"))


def merge_node_maps(maps: DataFrame, scratch: Scratch) -> DataFrame:
    """Z-11: maps (prefix, concept_id, value, place): of repeated nodes the last, with dense numbers in key order."""
    last = maps.groupBy("prefix", "concept_id").agg(F.max_by("value", "place").alias("value"))
    return dense_ids(last, ["prefix", "concept_id"], "nid", scratch)


def equivalence_cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Z-06: (kind, n, mean_cosine) of pairs (kind, prefix_1, id_1, prefix_2, id_2) whose ends both have vectors."""
    from thesaurion.operators.retrieval import cosine

    v = vectors.select("prefix", "concept_id", "vector")
    both = pairs.join(v.toDF("prefix_1", "id_1", "v1"), ["prefix_1", "id_1"]).join(v.toDF("prefix_2", "id_2", "v2"), ["prefix_2", "id_2"])
    return both.withColumn("c", cosine("v1", "v2")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("mean_cosine"))
