"""Canonical tables: concepts, edges, similarities, vectors, n-grams; and the fixed vocabulary of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Vocabularies, kinds of links, statuses and similarity methods.
PREFIXES = ("ctv3", "ensembl", "hgnc", "gene", "hpo", "mondo", "ncit", "ohdsi", "omim", "ordo", "reactome", "snomed")
HIERARCHY = ("is_a", "part_of")
MAPPING = ("annotated_with", "has_symbol", "exact", "broad", "narrow", "related")
INTERNAL = ("is_a", "part_of", "replaced_by", "preceded_by", "has_input", "has_output", "ohdsi_relationship", "annotated_with", "consider")
ANNOTATION = ("exact", "broad", "narrow", "related", "has_symbol", "alias_symbol", "previous_symbol", "annotated_with")
STATUSES = ("active", "deprecated")
CONCEPT_TYPES = ("pathway", "reaction", "gene", "transcript", "exon", "protein")
METHODS = ("co-annotation", "relevance", "weighed-relevance")

_STRENGTH = "struct<ingredient_id:string,amount_value:double,amount_unit:string,numerator_value:double,numerator_unit:string,denominator_value:double,denominator_unit:string>"

CONCEPTS_DDL = (
    "prefix string, concept_id string, concept_types array<string>, label string, synonyms array<string>, definition string, "
    "comment string, status string, vector_id string, bio_type string, start bigint, end bigint, sequence string, location string, "
    f"drug_strengths array<{_STRENGTH}>, inferred boolean, fully_defined boolean"
)
EDGES_DDL = "prefix_from string, id_from string, prefix_to string, id_to string, rel_type string, keys array<string>, props map<string,string>"
SIMILARITIES_DDL = "prefix_from string, id_from string, prefix_to string, id_to string, score_key string, score double"
VECTORS_DDL = "prefix string, concept_id string, vector_id string, vector array<float>"
NGRAMS_DDL = "prefix string, concept_id string, ngram string"


def _fields(ddl: str) -> list[tuple[str, str]]:
    out, depth, word = [], 0, ""
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = word.strip().split(" ", 1)
            out.append((name, kind))
            word = ""
        else:
            word += c
    return out


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of a canonical table in order: missing ones null, others dropped."""
    return df.select(*[(F.col(f"`{n}`") if n in df.columns else F.lit(None)).cast(k).alias(n) for n, k in _fields(ddl)])


def concepts(df: DataFrame, prefix: str | None = None) -> DataFrame:
    return conform(df if prefix is None else df.withColumn("prefix", F.lit(prefix)), CONCEPTS_DDL)


def edges(df: DataFrame, prefix_from: str | None = None, prefix_to: str | None = None) -> DataFrame:
    for name, value in (("prefix_from", prefix_from), ("prefix_to", prefix_to)):
        if value is not None:
            df = df.withColumn(name, F.lit(value))
    return conform(df, EDGES_DDL)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once: the check that replaces a unique index."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def outside(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Rows whose value is not one of the allowed ones; null is allowed."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))
