"""Lookups, auto-complete, sampling, versions and upserts over concepts (Q-01 to Q-12, T-01, T-02, R-10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from thesaurion.functions.text import label_length, ngrams, position_score, query_needle, query_words, search_text


def get_by_ids(concepts: DataFrame, requests: DataFrame) -> DataFrame:
    """Q-01, O-07, L-01: requests (pos, prefix, concept_id) in their order with the concept's columns, null where there is none."""
    return requests.select("pos", "prefix", "concept_id").join(concepts, ["prefix", "concept_id"], "left")


def count_terms(concepts: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Q-02: concepts per vocabulary; with edges also the nodes that are named by links only."""
    ids = concepts.select("prefix", "concept_id")
    if edges is not None:
        ids = ids.union(edges.select("prefix_from", "id_from")).union(edges.select("prefix_to", "id_to"))
    return ids.distinct().groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))


def ngram_index(concepts: DataFrame) -> DataFrame:
    """D14: (prefix, concept_id, ngram), the inverted index of auto-complete."""
    return concepts.select("prefix", "concept_id", F.explode(ngrams("concept_id", "label", "synonyms")).alias("ngram"))


def auto_complete(concepts: DataFrame, queries: DataFrame, limit: int | None = 20, index: DataFrame | None = None) -> DataFrame:
    """Q-03 to Q-06: (query_id, rank, prefix, concept_id, score) for queries (query_id, prefix, query).

    All words of the query longer than two characters must be n-grams of the concept; a query without such a word
    matches nothing. Ranked by the place of the query in the search text (absent last), label length, id. The division
    by the query's words is a join on n-grams and a count, so that an index that is kept serves any number of queries."""
    ask = queries.select("query_id", "prefix", query_needle("query").alias("needle"), query_words("query").alias("ws")).where(F.size("ws") > 0)
    grams = ngram_index(concepts) if index is None else index
    wanted = ask.select("query_id", "prefix", F.size("ws").alias("n"), F.explode("ws").alias("ngram"))
    hits = wanted.join(grams, ["prefix", "ngram"]).groupBy("query_id", "prefix", "concept_id", "n").agg(F.count_distinct("ngram").alias("k")).where("k = n")
    # one concept row per id: a repeated record must not repeat the answer
    text = concepts.groupBy("prefix", "concept_id").agg(F.min(F.struct(label_length("label").alias("len"), search_text("concept_id", "label", "synonyms").alias("text"))).alias("t"))
    rows = hits.join(ask.select("query_id", "needle"), "query_id").join(text, ["prefix", "concept_id"])
    rows = rows.withColumn("score", position_score(F.col("t.text"), F.col("needle")))
    w = W.partitionBy("query_id").orderBy("score", "t.len", "concept_id")
    ranked = rows.withColumn("rank", F.row_number().over(w))
    if limit:
        ranked = ranked.where(F.col("rank") <= limit)
    return ranked.select("query_id", "rank", "prefix", "concept_id", "score")


def random_ids(concepts: DataFrame, count: int, seed: int | None = None) -> DataFrame:
    """Q-07: count concepts at random."""
    return concepts.select("prefix", "concept_id").distinct().orderBy(F.rand(seed) if seed is not None else F.rand()).limit(count)


def concept_info(concepts: DataFrame, edges: DataFrame, asked: DataFrame) -> DataFrame:
    """Q-08: the concept with the sorted ids of its direct parents and children; no row for unknown ones."""
    hop = edges.where("rel_type in ('is_a', 'part_of')")
    parents = hop.groupBy(F.col("prefix_from").alias("prefix"), F.col("id_from").alias("concept_id")).agg(F.array_sort(F.collect_set("id_to")).alias("parents"))
    children = hop.groupBy(F.col("prefix_to").alias("prefix"), F.col("id_to").alias("concept_id")).agg(F.array_sort(F.collect_set("id_from")).alias("children"))
    none = F.array().cast("array<string>")
    out = concepts.join(asked.select("prefix", "concept_id").distinct(), ["prefix", "concept_id"], "left_semi")
    out = out.join(parents, ["prefix", "concept_id"], "left").join(children, ["prefix", "concept_id"], "left")
    return out.withColumn("parents", F.coalesce("parents", none)).withColumn("children", F.coalesce("children", none))


def vocabulary_status(concepts: DataFrame, edges: DataFrame, vectors: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Q-09, T-02: per vocabulary the concepts, internal relationships and vectors, and whether it is loaded."""
    c = concepts.groupBy("prefix").agg(F.count(F.lit(1)).alias("concepts"))
    e = edges.where("prefix_from = prefix_to").groupBy(F.col("prefix_from").alias("prefix")).agg(F.count(F.lit(1)).alias("relationships"))
    v = vectors.groupBy("prefix").agg(F.count(F.lit(1)).alias("vectors"))
    out = prefixes.select("prefix").distinct().join(c, "prefix", "left").join(e, "prefix", "left").join(v, "prefix", "left").na.fill(0)
    return out.withColumn("loaded", F.col("concepts") > 0)


def latest_rows(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """T-01: the row of each key that is greatest in the order columns."""
    w = W.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in order])
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """R-10: new rows set the fields they have, others stay; unknown keys are inserted. new holds each key once."""
    fields = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*fields).alias("o"))
    n = new.select(*keys, F.struct(*[F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in fields]).alias("n"))
    both = o.join(n, keys, "full")
    return both.select(*keys, *[F.coalesce(F.col("n")[c], F.col("o")[c]).alias(c) for c in fields])


def set_vector_ids(concepts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Q-12: vector ids of (prefix, concept_id, vector_id) put into the concepts that have one there."""
    m = mapping.select("prefix", "concept_id", F.col("vector_id").alias("_v"))
    return concepts.join(m, ["prefix", "concept_id"], "left").withColumn("vector_id", F.coalesce("_v", "vector_id")).drop("_v")


def delete_vocabulary(concepts: DataFrame, edges: DataFrame, vectors: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """R-13: the tables without a vocabulary, and without links that touch it."""
    p = F.lit(prefix)
    return concepts.where(F.col("prefix") != p), edges.where((F.col("prefix_from") != p) & (F.col("prefix_to") != p)), vectors.where(F.col("prefix") != p)


def delete_annotations(edges: DataFrame, prefix_1: str, prefix_2: str) -> DataFrame:
    """R-14: without the links from the first to the second vocabulary."""
    return edges.where(~((F.col("prefix_from") == prefix_1) & (F.col("prefix_to") == prefix_2)))


def vocabulary_graph(edges: DataFrame, prefix: str, with_similar: bool = True) -> DataFrame:
    """R-15: distinct internal links."""
    own = edges.where((F.col("prefix_from") == prefix) & (F.col("prefix_to") == prefix))
    return (own if with_similar else own.where("rel_type <> 'similar_to'")).select("id_from", "id_to", "rel_type").distinct()


def annotation_graph(edges: DataFrame, prefix_1: str, prefix_2: str) -> DataFrame:
    """R-16: links between two vocabularies either way, turned to lead from the first to the second."""
    a = edges.where((F.col("prefix_from") == prefix_1) & (F.col("prefix_to") == prefix_2)).select(F.col("id_from").alias("a"), F.col("id_to").alias("b"), F.to_json("props").alias("props"))
    b = edges.where((F.col("prefix_from") == prefix_2) & (F.col("prefix_to") == prefix_1)).select(F.col("id_to").alias("a"), F.col("id_from").alias("b"), F.to_json("props").alias("props"))
    return a.union(b).groupBy("a", "b").agg(F.max("props").alias("props")).select(F.concat(F.lit(prefix_1 + ":"), "a").alias("node_1"), F.concat(F.lit(prefix_2 + ":"), "b").alias("node_2"), "props")
