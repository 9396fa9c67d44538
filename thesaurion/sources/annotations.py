"""Cross-vocabulary files to canonical edges (N-01 to N-19)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thesaurion.functions.text import last_part
from thesaurion.operators.documents import latest_rows
from thesaurion.schema import edges as edge_rows
from thesaurion.sources.readers import csv, delimited

# Frequency terms of the phenotype ontology and their codes.
FREQUENCIES = {"0040285": "E", "0040284": "VR", "0040283": "OC", "0040282": "F", "0040281": "VF", "0040280": "O"}


def _edges(rows: DataFrame, a: str, b: str, rel: str = "annotated_with") -> DataFrame:
    return edge_rows(rows.where("id_from is not null and id_to is not null").withColumn("rel_type", F.lit(rel)), a, b)


def gene_hpo(spark: SparkSession, path: str) -> DataFrame:
    """N-01: frequency in props, UN where it is not stated or unknown."""
    code = F.create_map(*[F.lit(x) for kv in FREQUENCIES.items() for x in kv])
    raw = delimited(spark, path).where("gene_symbol <> '-'")
    return _edges(raw.select(F.col("gene_symbol").alias("id_from"), last_part("hpo_id", ":").alias("id_to"), F.create_map(F.lit("frequency"), F.coalesce(F.try_element_at(code, last_part("frequency", ":")), F.lit("UN"))).alias("props")), "gene", "hpo")


def ncit_gene(spark: SparkSession, path: str) -> DataFrame:
    """N-02."""
    raw = delimited(spark, path, columns=["ncit_id", "hgnc_id"])
    return _edges(raw.select(F.col("ncit_id").alias("id_from"), last_part("hgnc_id", ":").alias("id_to")), "ncit", "gene")


def omim_gene(spark: SparkSession, path: str) -> DataFrame:
    """N-03."""
    raw = csv(spark, path).where("`Gene Symbol` is not null")
    return _edges(raw.select(last_part("`Class ID`", "/").alias("id_from"), F.explode(F.split("Gene Symbol", r"\|")).alias("id_to")), "omim", "gene")


def ordo_gene(spark: SparkSession, path: str) -> DataFrame:
    """N-04."""
    schema = "OrphaCode string, DisorderGeneAssociationList struct<DisorderGeneAssociation:array<struct<Gene:struct<Symbol:string>>>>"
    raw = spark.read.option("rowTag", "Disorder").schema(schema).xml(path)
    return _edges(raw.select(F.col("OrphaCode").alias("id_from"), F.explode("DisorderGeneAssociationList.DisorderGeneAssociation").alias("g")).select("id_from", F.col("g.Gene.Symbol").alias("id_to")).distinct(), "ordo", "gene")


def ordo_hpo(classes: DataFrame) -> DataFrame:
    """N-05: from class names of the form Orpha:X_HP:Y_Freq:Z (classes: name)."""
    shape = r"^Orpha:([^_]+)_HP:([^_]+)_Freq:(.+)$"
    raw = classes.where(F.col("name").rlike(shape))
    part = lambda i: F.regexp_extract("name", shape, i)
    return _edges(raw.select(part(1).alias("id_from"), part(2).alias("id_to"), F.create_map(F.lit("frequency"), part(3)).alias("props")), "ordo", "hpo")


def ordo_omim(spark: SparkSession, path: str) -> DataFrame:
    """N-06: lists whose count is 0 are skipped."""
    ref = "struct<count:string,ExternalReference:array<struct<Source:string,Reference:string>>>"
    schema = f"JDBOR array<struct<DisorderList:array<struct<Disorder:array<struct<OrphaCode:string,ExternalReferenceList:array<{ref}>>>>>>>"
    raw = spark.read.option("multiLine", True).schema(schema).json(path)
    d = raw.select(F.explode("JDBOR").alias("j")).select(F.explode("j.DisorderList").alias("l")).select(F.explode("l.Disorder").alias("d")).select("d.OrphaCode", F.explode("d.ExternalReferenceList").alias("r"))
    x = d.where("r.count <> '0'").select(F.col("OrphaCode").alias("id_from"), F.explode("r.ExternalReference").alias("x")).where("x.Source = 'OMIM'")
    return _edges(x.select("id_from", F.col("x.Reference").alias("id_to")), "ordo", "omim")


def snomed_ordo(spark: SparkSession, path: str) -> DataFrame:
    """N-07: the latest row of each map entry, active ones only."""
    raw = latest_rows(delimited(spark, path), "id", "effectiveTime").where("active = '1'")
    return _edges(raw.select(F.col("referencedComponentId").alias("id_from"), F.col("mapTarget").alias("id_to")), "snomed", "ordo")


def snomed_ctv3(spark: SparkSession, path: str) -> DataFrame:
    """N-08: inactive entries are kept."""
    raw = latest_rows(delimited(spark, path), "id", "effectiveTime")
    return _edges(raw.select(F.col("referencedComponentId").alias("id_from"), F.col("mapTarget").alias("id_to")), "snomed", "ctv3")


def view(edges: DataFrame, prefix_1: str, prefix_2: str) -> DataFrame:
    """N-09 to N-16: annotations that come with a vocabulary, as a view of all edges, either way."""
    a = (F.col("prefix_from") == prefix_1) & (F.col("prefix_to") == prefix_2)
    b = (F.col("prefix_from") == prefix_2) & (F.col("prefix_to") == prefix_1)
    return edges.where(a | b)


_LOADERS: dict[frozenset, Callable] = {
    frozenset(("gene", "hpo")): gene_hpo,
    frozenset(("ncit", "gene")): ncit_gene,
    frozenset(("omim", "gene")): omim_gene,
    frozenset(("ordo", "gene")): ordo_gene,
    frozenset(("ordo", "hpo")): ordo_hpo,
    frozenset(("ordo", "omim")): ordo_omim,
    frozenset(("snomed", "ordo")): snomed_ordo,
    frozenset(("snomed", "ctv3")): snomed_ctv3,
}
#: Pairs that are loaded with one of their vocabularies.
VIEWS = [frozenset(x) for x in (("hgnc", "mondo"), ("hpo", "mondo"), ("mondo", "ncit"), ("mondo", "omim"), ("mondo", "ordo"), ("mondo", "snomed"), ("ncit", "ohdsi"), ("ohdsi", "snomed"))]


def loader(prefix_1: str, prefix_2: str) -> Callable:
    """N-18: the loader of a pair, named in either order."""
    pair = frozenset((prefix_1, prefix_2))
    if pair in VIEWS:
        return view
    if pair not in _LOADERS:
        raise KeyError(f"no annotation between {prefix_1} and {prefix_2}")
    return _LOADERS[pair]


def ready(concepts: DataFrame, edges: DataFrame, prefix_1: str, prefix_2: str) -> str | None:
    """N-17: why annotations of a pair cannot be loaded: a vocabulary is empty, or they are there already; else None."""
    have = {r["prefix"] for r in concepts.where(F.col("prefix").isin(prefix_1, prefix_2)).select("prefix").distinct().collect()}
    for p in (prefix_1, prefix_2):
        if p not in have:
            return f"vocabulary {p} is not loaded"
    return "annotations are loaded already" if view(edges, prefix_1, prefix_2).limit(1).count() else None


def replace(edges: DataFrame, new: DataFrame, prefix_1: str, prefix_2: str) -> DataFrame:
    """N-19: overwrite: the links of a pair are deleted, then the new ones stand; repeated ones once."""
    left = edges.where(~((F.col("prefix_from") == prefix_1) & (F.col("prefix_to") == prefix_2)))
    return left.unionByName(new.dropDuplicates(["id_from", "rel_type", "id_to"]))
