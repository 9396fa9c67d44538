"""Similar concepts and translation over stored scores (S-01 to S-08), and vector search (V-01 to V-09)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _both_ways(similarities: DataFrame) -> DataFrame:
    """Scores seen from either end: (p, i, p2, i2, score_key, score)."""
    a = similarities.select(F.col("prefix_from").alias("p"), F.col("id_from").alias("i"), F.col("prefix_to").alias("p2"), F.col("id_to").alias("i2"), "score_key", "score")
    return a.union(a.select("p2", "i2", "p", "i", "score_key", "score"))


def similar_best(similarities: DataFrame, queries: DataFrame) -> DataFrame:
    """S-01: (prefix, concept_id, threshold, neighbour_id, best, rank) within the vocabulary: per neighbour the greatest
    score of at least the query's threshold. queries: prefix, concept_id, threshold; each (concept, threshold) apart."""
    ask = queries.select(F.col("prefix").alias("p"), F.col("concept_id").alias("i"), "threshold").distinct()
    rows = _both_ways(similarities).where("p = p2").join(ask, ["p", "i"]).where("score >= threshold")
    best = rows.groupBy("p", "i", "threshold", "i2").agg(F.max("score").alias("best"))
    w = W.partitionBy("p", "i", "threshold").orderBy(F.desc("best"), "i2")
    return best.select(F.col("p").alias("prefix"), F.col("i").alias("concept_id"), "threshold", F.col("i2").alias("neighbour_id"), "best", F.row_number().over(w).alias("rank"))


def key_filter(method: str | None, corpus: str | None, key: str = "score_key") -> Column:
    """X-17: a key is `method` or `method:corpus`; what is not asked for is not tested."""
    k = F.col(key)
    out = F.lit(True)
    if method:
        out = out & ((k == method) | k.startswith(method + ":"))
    if corpus:
        out = out & k.endswith(":" + corpus)
    return out


def similar_full(similarities: DataFrame, asked: DataFrame, threshold: float = 1.0, same_prefix: bool = True, corpus: str | None = None, method: str | None = None, limit: int | None = None) -> DataFrame:
    """S-02: (prefix, concept_id, neighbour_prefix, neighbour_id, score_key, score, rank): all valid scores of the `limit`
    best neighbours of each concept. A score is valid if it reaches the threshold and its key fits method and corpus.
    rank is over the concept's neighbours of all vocabularies, by greatest valid score, then vocabulary and id."""
    rows = _both_ways(similarities).where((F.col("score") >= threshold) & key_filter(method, corpus))
    if same_prefix:
        rows = rows.where("p = p2")
    rows = rows.join(asked.select(F.col("prefix").alias("p"), F.col("concept_id").alias("i")).distinct(), ["p", "i"], "left_semi")
    per = rows.groupBy("p", "i", "p2", "i2", "score_key").agg(F.max("score").alias("score"))
    best = per.groupBy("p", "i", "p2", "i2").agg(F.max("score").alias("best"), F.collect_list(F.struct("score_key", "score")).alias("all"))
    w = W.partitionBy("p", "i").orderBy(F.desc("best"), "p2", "i2")
    best = best.withColumn("rank", F.row_number().over(w))
    if limit:
        best = best.where(F.col("rank") <= limit)
    out = best.select("p", "i", "p2", "i2", "rank", F.inline("all"))
    return out.select(F.col("p").alias("prefix"), F.col("i").alias("concept_id"), F.col("p2").alias("neighbour_prefix"), F.col("i2").alias("neighbour_id"), "score_key", "score", "rank")


def similar_groups(full: DataFrame) -> DataFrame:
    """S-08: similar_full as nested groups: per concept and neighbour vocabulary a list of (id, map of scores), best first."""
    one = full.groupBy("prefix", "concept_id", "neighbour_prefix", "neighbour_id", "rank").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("score_key", "score")))).alias("scores"))
    many = one.groupBy("prefix", "concept_id", "neighbour_prefix").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour_id", F.map_entries("scores").alias("s")))).alias("l"))
    return many.select("prefix", "concept_id", "neighbour_prefix", F.transform("l", lambda x: F.struct(x["neighbour_id"].alias("concept_id"), F.map_from_entries(x["s"]).alias("scores"))).alias("similar"))


def translate(similarities: DataFrame, asked: DataFrame, constraints: DataFrame, threshold: float = 1.0, limit: int | None = None) -> DataFrame:
    """S-03: (prefix, concept_id, target_prefix, target_id, score, rank): neighbours among the constraints (prefix,
    concept_id), by greatest score of at least the threshold, then vocabulary and id."""
    rows = _both_ways(similarities).where(F.col("score") >= threshold)
    rows = rows.join(asked.select(F.col("prefix").alias("p"), F.col("concept_id").alias("i")).distinct(), ["p", "i"], "left_semi")
    rows = rows.join(constraints.select(F.col("prefix").alias("p2"), F.col("concept_id").alias("i2")).distinct(), ["p2", "i2"], "left_semi")
    best = rows.groupBy("p", "i", "p2", "i2").agg(F.max("score").alias("score"))
    w = W.partitionBy("p", "i").orderBy(F.desc("score"), "p2", "i2")
    best = best.withColumn("rank", F.row_number().over(w))
    if limit:
        best = best.where(F.col("rank") <= limit)
    return best.select(F.col("p").alias("prefix"), F.col("i").alias("concept_id"), F.col("p2").alias("target_prefix"), F.col("i2").alias("target_id"), "score", "rank")


def cosine(a: Column | str, b: Column | str) -> Column:
    """V-09 as an expression in double precision; 0 for a zero vector, null if the lengths differ."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, u: s + u)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm))


#: Query vectors that a task compares with its rows at once.
QUERY_BLOCK = 2_000


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """V-01, O-05: (query_id, rank, concept_id, cosine): exact nearest vectors; ties by id.

    vectors: concept_id, vector; queries: query_id, vector, a stated query set that is taken in blocks of QUERY_BLOCK.
    Each block is one pass: every task compares its rows by one matrix product, keeps its own k best per query, and the
    partial lists are ranked. Vectors that are null, of another length or not finite take no part; a zero one has cosine 0."""
    out: DataFrame | None = None
    block: list = []
    rows = queries.where("query_id is not null and vector is not null").select("query_id", "vector")
    for r in [*rows.toLocalIterator(), None]:
        if block and (r is None or len(block) == QUERY_BLOCK):
            part = _block_top(vectors, block, k)
            out = part if out is None else out.union(part)
            block = []
        if r is not None:
            block.append((r["query_id"], np.array(r["vector"], np.float64)))
    q, c = (queries.schema["query_id"].dataType.simpleString(), vectors.schema["concept_id"].dataType.simpleString())
    if out is None:
        return vectors.sparkSession.createDataFrame([], f"query_id {q}, rank int, concept_id {c}, cosine double")
    w = W.partitionBy("query_id").orderBy(F.desc("cosine"), "concept_id")
    ranked = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("query_id").cast(q), "rank", "concept_id", "cosine")


def _block_top(vectors: DataFrame, block: list, k: int) -> DataFrame:
    dims = sorted({len(v) for _, v in block})
    kind = vectors.schema["concept_id"].dataType.simpleString()

    def unit(x: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = np.array([len(v) for v in b["vector"]])
            for dim in dims:
                ids = [q for q, v in block if len(v) == dim]
                m = unit(np.stack([v for _, v in block if len(v) == dim]))
                at = np.flatnonzero(size == dim)
                if not len(at):
                    continue
                x = np.stack([np.asarray(b["vector"].iloc[i], np.float64) for i in at])
                good = np.isfinite(x).all(1)
                at, x = at[good], x[good]
                s = m @ unit(x).T
                if s.shape[1] > k:
                    # all that reach the k-th value, so that ties at the edge are settled by id later
                    edge = np.partition(s, s.shape[1] - k, 1)[:, s.shape[1] - k]
                    row, col = np.nonzero(s >= edge[:, None] - 1e-12)
                else:
                    row, col = np.nonzero(np.ones_like(s, bool))
                if not len(row):
                    continue
                yield pd.DataFrame({"query_id": [str(ids[i]) for i in row], "concept_id": b["concept_id"].to_numpy()[at[col]], "cosine": s[row, col]})

    return vectors.where("concept_id is not null and vector is not null").select("concept_id", "vector").mapInPandas(run, f"query_id string, concept_id {kind}, cosine double")


def hashed_embedding(texts: DataFrame, text: str, dim: int = 64) -> DataFrame:
    """V-03 without a trained model: signed hashed word counts, L2-normalised, as array<float> column `vector`; wordless
    texts give zeros. Deterministic, within the JVM."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)
    at = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(dim)).cast("int").alias("i"), F.when(F.pmod(F.hash(w), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter(at, lambda x: x["i"] == i), F.lit(0.0), lambda a, x: a + x["s"]))
    norm = F.sqrt(F.aggregate(F.col("_raw"), F.lit(0.0), lambda a, x: a + x * x))
    out = texts.withColumn("_raw", raw).withColumn("_norm", norm)
    return out.withColumn("vector", F.transform("_raw", lambda x: F.when(F.col("_norm") > 0, x / F.col("_norm")).otherwise(0.0).cast("float"))).drop("_raw", "_norm")


def search(vectors: DataFrame, queries: DataFrame, concepts: DataFrame, k: int) -> DataFrame:
    """V-02: (query_id, rank, cosine, and the concept's columns): the k concepts nearest to each query vector, best first.
    vectors: concept_id, vector; queries: query_id, vector. Vectors without a concept take their rank but give no row."""
    ranked = vector_top_k(vectors, queries, k).withColumn("concept_id", F.col("concept_id").cast("string"))
    return ranked.select("query_id", "rank", "cosine", "concept_id").join(concepts, "concept_id")
