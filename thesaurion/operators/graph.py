"""Hierarchy operators over edges (G-01 to G-07, P-08 to P-17).

Edges are the canonical table; roots and other requests are tables, so that a request may hold any number of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thesaurion.runtime import Scratch
from thesaurion.schema import HIERARCHY


def _steps(edges: DataFrame, rel: tuple[str, ...], up: bool) -> DataFrame:
    """Distinct hops (p, i, p2, i2) in the direction of travel."""
    a, b = ("from", "to") if up else ("to", "from")
    hop = edges.where(F.col("rel_type").isin(*rel))
    return hop.select(F.col(f"prefix_{a}").alias("p"), F.col(f"id_{a}").alias("i"), F.col(f"prefix_{b}").alias("p2"), F.col(f"id_{b}").alias("i2")).distinct()


def reach(edges: DataFrame, roots: DataFrame, scratch: Scratch, up: bool = False, depth: int | None = None, rel: tuple[str, ...] = HIERARCHY) -> DataFrame:
    """(root_prefix, root_id, prefix, concept_id, level): every node met from a root within depth hops, once, at its least level.

    roots: prefix, concept_id. Breadth first with an anti-join on what was met, so loops and many paths do no harm. A
    round handles the frontier only; the frontier is written, what was met before is read from the written rounds."""
    steps = scratch.cut(_steps(edges, rel, up))
    start = roots.select(F.col("prefix").alias("rp"), F.col("concept_id").alias("ri")).distinct()
    front = scratch.cut(start.select("rp", "ri", F.col("rp").alias("p"), F.col("ri").alias("i"), F.lit(0).alias("level")))
    met, level = front, 0
    while depth is None or level < depth:
        level += 1
        nxt = front.join(steps, ["p", "i"])
        nxt = nxt.select("rp", "ri", F.col("p2").alias("p"), F.col("i2").alias("i")).distinct().join(met, ["rp", "ri", "p", "i"], "left_anti")
        front = scratch.cut(nxt.withColumn("level", F.lit(level)))
        if front.limit(1).count() == 0:
            break
        met = met.union(front.select(*met.columns))
    return met.where("level > 0").select(F.col("rp").alias("root_prefix"), F.col("ri").alias("root_id"), F.col("p").alias("prefix"), F.col("i").alias("concept_id"), "level")


def related(edges: DataFrame, roots: DataFrame, scratch: Scratch, up: bool = False, depth: int | None = None, limit: int | None = None, both_ways: bool = False) -> DataFrame:
    """G-01, G-02: (concept_id, related) with related a sorted list of distinct ids, of at most limit.

    Without depth a known root without relations has an empty list; with depth it has no row. Unknown roots have none.
    both_ways: bounded ancestor tracing that also walks is_a down, as the source system does."""
    if both_ways and depth is not None and up:
        turned = edges.where("rel_type = 'is_a'").select(F.col("prefix_to").alias("prefix_from"), F.col("id_to").alias("id_from"), F.col("prefix_from").alias("prefix_to"), F.col("id_from").alias("id_to"), "rel_type", "keys", "props")
        edges = edges.unionByName(turned)
    pairs = reach(edges, roots, scratch, up, depth).groupBy("root_prefix", "root_id").agg(F.array_sort(F.collect_set("concept_id")).alias("r"))
    if depth is None:
        known = edges.select("prefix_from", "id_from").union(edges.select("prefix_to", "id_to")).toDF("root_prefix", "root_id").distinct()
        asked = roots.select(F.col("prefix").alias("root_prefix"), F.col("concept_id").alias("root_id")).distinct().join(known, ["root_prefix", "root_id"], "left_semi")
        pairs = asked.join(pairs, ["root_prefix", "root_id"], "left")
    out = F.coalesce("r", F.array().cast("array<string>"))
    return pairs.select(F.col("root_prefix").alias("prefix"), F.col("root_id").alias("concept_id"), (F.slice(out, 1, limit) if limit else out).alias("related"))


def one_hop(edges: DataFrame, asked: DataFrame, rel: str, out: bool, types: DataFrame | None = None, from_type: str | None = None, to_type: str | None = None, keep_empty: bool = True) -> DataFrame:
    """G-03, G-04, P-08 to P-17: (prefix, concept_id, related_id) by one link of one kind; related_id null for an id of
    the graph without any. With types (prefix, concept_id, concept_types) both ends are tested for theirs. A repeated
    request counts once; an unknown id gives no row."""
    hop = _steps(edges, (rel,), out).select(F.col("p").alias("prefix"), F.col("i").alias("concept_id"), F.col("p2").alias("related_prefix"), F.col("i2").alias("related_id"))
    ask = asked.select("prefix", "concept_id").distinct()
    if types is not None:
        of = lambda t: types.where(F.array_contains("concept_types", t))
        if from_type:
            ask = ask.join(of(from_type).select("prefix", "concept_id"), ["prefix", "concept_id"], "left_semi")
        if to_type:
            hop = hop.join(of(to_type).select(F.col("prefix").alias("related_prefix"), F.col("concept_id").alias("related_id")), ["related_prefix", "related_id"], "left_semi")
    if keep_empty and types is None:
        known = edges.select("prefix_from", "id_from").union(edges.select("prefix_to", "id_to")).toDF("prefix", "concept_id").distinct()
        ask = ask.join(known, ["prefix", "concept_id"], "left_semi")
    return ask.join(hop, ["prefix", "concept_id"], "left" if keep_empty else "inner").select("prefix", "concept_id", "related_id")


# The typed hops: (kind, along the link?, type asked, type found).
HOPS = {
    "sub_pathways": ("part_of", False, "pathway", "pathway"),
    "super_pathways": ("part_of", True, "pathway", "pathway"),
    "reactions_in_pathway": ("part_of", False, "pathway", "reaction"),
    "pathways_of_reaction": ("part_of", True, "reaction", "pathway"),
    "preceding_reactions": ("preceded_by", True, "reaction", "reaction"),
    "subsequent_reactions": ("preceded_by", False, "reaction", "reaction"),
    "reaction_inputs": ("has_input", True, "reaction", "gene"),
    "reaction_outputs": ("has_output", True, "reaction", "gene"),
    "consumed_in": ("has_input", False, "gene", "reaction"),
    "produced_in": ("has_output", False, "gene", "reaction"),
}


def typed_hop(name: str, edges: DataFrame, concepts: DataFrame, asked: DataFrame) -> DataFrame:
    rel, out, a, b = HOPS[name]
    return one_hop(edges, asked, rel, out, concepts.select("prefix", "concept_id", "concept_types"), a, b)


def replaced(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """G-03: what was replaced by the asked concept."""
    return one_hop(edges, asked, "replaced_by", False)


def replacing(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """G-04: what replaces the asked concept."""
    return one_hop(edges, asked, "replaced_by", True)


def count_edges(edges: DataFrame) -> DataFrame:
    """G-05, G-06, Q-10: links of each ordered pair of vocabularies; equal ones are internal relationships."""
    return edges.groupBy("prefix_from", "prefix_to").agg(F.count(F.lit(1)).alias("n"))


def count_scores(similarities: DataFrame, keys: DataFrame) -> DataFrame:
    """G-07, Q-11: scores of each configured key, keys without any kept with 0, in key order."""
    n = similarities.groupBy("score_key").agg(F.count(F.lit(1)).alias("n"))
    return keys.select("score_key").distinct().join(n, "score_key", "left").select("score_key", F.coalesce("n", F.lit(0)).alias("n")).orderBy("score_key")


def merge_edges(edges: DataFrame) -> DataFrame:
    """R-11: one row per source, kind and target with the distinct keys of all; of the props the last by their JSON text."""
    return edges.groupBy("prefix_from", "id_from", "prefix_to", "id_to", "rel_type").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("keys", F.array().cast("array<string>")))))).alias("keys"),
        F.max_by("props", F.to_json("props")).alias("props"),
    )
