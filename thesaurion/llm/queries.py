"""Queries p2, p4, p5, p8, p9 and p10 over the delivered tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thesaurion.llm.components import groups
from thesaurion.llm.containers import pack, sizes
from thesaurion.llm.leaks import LEAST, MATCH, leaks
from thesaurion.llm.subjects import SHARE, subject_shares
from thesaurion.llm.topn import top_n
from thesaurion.llm.vectors import similar, usable
from thesaurion.runtime import Scratch, blank, table, trim_ws


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "similar_snomed_concept").select("from_id", "to_id", "score")
    rows = rows.where("score between 0 and 1 and to_id <> from_id").where(~blank(F.col("to_id")))
    top = top_n(rows, "from_id", "to_id", "score", 10, F.expr("try_cast(i as decimal(38, 0))"), Scratch(spark, "p2"))
    return top.select("from_id", "rnk", "to_id")


def _record(prefix: Column, raw: Column) -> Column:
    """prefix:id in lower case; null for ids without a digit from 1 to 9."""
    bare = F.regexp_replace(F.lower(trim_ws(raw)), r"^(omim|ordo|orpha|orphanet|snomed|mondo)\s*[:_]\s*", "")
    return F.when(bare.rlike("[1-9]"), F.concat(prefix, F.lit(":"), bare))


def match_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = table(spark, sf_dir, "graph_concept")
    parts = []
    for own, field, other in (("mondo", "annotated_omim", "omim"), ("mondo", "annotated_ordo", "ordo"), ("ordo", "annotated_snomed", "snomed")):
        rows = rec.where(F.col("prefix") == own).select("concept_id", F.explode(field).alias("o"))
        parts.append(rows.select(_record(F.lit(own), F.col("concept_id")).alias("a"), _record(F.lit(other), F.col("o")).alias("b")))
    return parts[0].union(parts[1]).union(parts[2]).where("a is not null and b is not null").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(match_links(spark, sf_dir), Scratch(spark, "p5"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embedding_record"), "concept_id", "vector", 64)
    near = similar(vectors, 5, 64, Scratch(spark, "p4"), floor=0.9, beam=24, probes=3, gap=0.12)
    return near.select(F.least("a", "b").alias("concept_id_a"), F.greatest("a", "b").alias("concept_id_b")).distinct()


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar other concepts of every concept."""
    vectors = usable(table(spark, sf_dir, "embedding_record"), "concept_id", "vector", 64)
    return similar(vectors, 5, 64, Scratch(spark, "p4")).select(F.col("a").alias("concept_id"), "rnk", F.col("b").alias("neighbour_id"), F.round("sim", 6).alias("cosine"))


TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CAPACITY = 4096


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    packed = pack(sizes(docs, "doc_id", "text", TOKENIZER), CAPACITY, Scratch(spark, "p8"))
    return packed.withColumn("doc_id", F.col("doc_id").cast("long"))


def _leaks(spark: SparkSession, sf_dir: str, edited: bool = False) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"), Scratch(spark, "p9"), edited)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose alignment scores LEAST matches or more; of these the exact check keeps those with LEAST in a row."""
    found = _leaks(spark, sf_dir).where(F.col("score") >= MATCH * LEAST)
    return found.where(F.col("longest") >= LEAST).select("doc_id", "item_id")


def p9_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also edited and paraphrased copies: any alignment over ten words or more that reaches 0.8 of the full score, or a
    run of ten equal words; score and span are those of the best alignment."""
    return _leaks(spark, sf_dir, edited=True).where("close").select("doc_id", "item_id", "score", "span", "longest")


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = sorted(r[0] for r in table(spark, sf_dir, "subject_area").select("subject").collect())  # a fixed table of ten
    docs, labels, items = (table(spark, sf_dir, t) for t in ("documents", "subject_label", "eval_item"))
    return subject_shares(docs, labels, areas, Scratch(spark, "p10"), items)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).where(F.col("share") >= SHARE - 1e-9).select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by subject: documents that have it, and their sentences' share."""
    found = _subjects(spark, sf_dir).where(F.col("share") >= SHARE - 1e-9)
    return found.groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("share"), 4).alias("mean_share"))


QUERIES = {
    "p10_found": p10_found,
    "p10_composition": p10_composition,
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p4_neighbours": p4_neighbours,
    "p5_found": p5_found,
    "p8_containers": p8_containers,
    "p9_found": p9_found,
    "p9_similar": p9_similar,
}

ORACLES = {
    "p2_found": """with b as (select from_id, to_id, max(score) s from similar_snomed_concept
 where score between 0 and 1 and to_id is not null and trim(to_id) <> '' and to_id <> from_id group by 1, 2)
 select from_id, cast(k as integer) rnk, to_id from (select *, row_number() over (partition by from_id order by s desc, cast(to_id as hugeint), to_id) k from b) where k <= 10""",
    "p5_found": """with recursive r as (
 select 'mondo' p, concept_id i, 'omim' q, unnest(annotated_omim) o from graph_concept where prefix = 'mondo' union all
 select 'mondo', concept_id, 'ordo', unnest(annotated_ordo) from graph_concept where prefix = 'mondo' union all
 select 'ordo', concept_id, 'snomed', unnest(annotated_snomed) from graph_concept where prefix = 'ordo'),
 c as (select p || ':' || lower(trim(i)) a, q || ':' || regexp_replace(lower(trim(o)), '^(omim|ordo|orpha|orphanet|snomed)\\s*[:_]\\s*', '') b
       from r where regexp_matches(i, '[1-9]') and regexp_matches(o, '[1-9]')),
 l as (select a, b from c union select b, a from c),
 g(k, m) using key (k) as (select a, min(least(a, b)) from l group by a
   union select l.b, min(g.m) from g join l on l.a = g.k join recurring.g h on h.k = l.b where g.m < h.m group by l.b)
 select k rec_key, m group_key from g""",
}
