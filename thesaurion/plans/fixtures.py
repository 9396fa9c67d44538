"""The star-schema tables seen as a terminology: one SQL text for both engines.

Braces name the tables; Spark reads them by path, the SQL check by name."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Sparse annotations of parts by suppliers.
ANNOTATED = "select distinct cast(l_partkey as varchar(20)) a, cast(l_suppkey as varchar(20)) b from {lineitem} where l_returnflag = 'R' and l_quantity >= 45"

PART_LINKS = """select cast(k as varchar(20)) child, cast(p as varchar(20)) parent from (
 select p_partkey k, cast(floor(p_partkey / 4) as bigint) p from {part} union select p_partkey, cast(floor(p_partkey / 6) as bigint) from {part}) x where k <> p"""

GEO_LINKS = """select 'nation' p1, cast(n_nationkey as varchar(20)) i1, 'region' p2, cast(n_regionkey as varchar(20)) i2 from {nation}
 union all select 'customer', cast(c_custkey as varchar(20)), 'nation', cast(c_nationkey as varchar(20)) from {customer}
 union all select 'supplier', cast(s_suppkey as varchar(20)), 'nation', cast(s_nationkey as varchar(20)) from {supplier}"""

EDGES = f"""select p1 prefix_from, i1 id_from, p2 prefix_to, i2 id_to, 'part_of' rel_type from ({GEO_LINKS}) g
 union all select 'part', child, 'part', parent, 'is_a' from ({PART_LINKS}) h
 union all select 'part', cast(p_partkey as varchar(20)), 'part', cast(p_partkey + 1 as varchar(20)), 'replaced_by' from {{part}} where p_size = 1
 union all select 'part', a, 'supplier', b, 'annotated_with' from ({ANNOTATED}) s
 union all select 'supplier', cast(s_suppkey as varchar(20)), 'nation', cast(s_nationkey as varchar(20)), 'broad' from {{supplier}}
 union all select 'customer', cast(c_custkey as varchar(20)), 'nation', cast(c_nationkey as varchar(20)), 'narrow' from {{customer}}"""

CONCEPTS = """select 'region' prefix, cast(r_regionkey as varchar(20)) concept_id, r_name label from {region}
 union all select 'nation', cast(n_nationkey as varchar(20)), n_name from {nation}
 union all select 'customer', cast(c_custkey as varchar(20)), c_name from {customer}
 union all select 'supplier', cast(s_suppkey as varchar(20)), s_name from {supplier}
 union all select 'part', cast(p_partkey as varchar(20)), p_name from {part}"""

#: The reaction network: part_of between pathways, inputs and outputs of reactions, ids trimmed and in upper case.
REACTIONS = """select 'reactome' prefix_from, r id_from, 'reactome' prefix_to, g id_to, case when k = 'output' then 'has_output' else 'has_input' end rel_type from (
  select distinct upper(trim(reaction_id)) r, upper(trim(gene_id)) g, relationship k from {gene_reaction} where reaction_id is not null and trim(gene_id) <> '' and relationship is not null) x
 union all select 'reactome', c, 'reactome', p, 'part_of' from (
  select distinct upper(trim(sub_pathway_st_id)) c, upper(trim(parent_st_id)) p from {pathway_hierarchy} where trim(sub_pathway_st_id) <> '' and trim(parent_st_id) <> '') y"""

SCORES = """select 'snomed' prefix_from, from_id id_from, 'snomed' prefix_to, to_id id_to, score_key, max(score) score from {similar_snomed_concept}
 where score between 0 and 1 and to_id is not null and from_id <> to_id group by from_id, to_id, score_key"""


def oracle(sql: str) -> str:
    """The text for an engine that knows the tables by name."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def read(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The text run over the Parquet files of a folder."""
    return spark.sql(re.sub(r"\{(\w+)\}", rf"parquet.`{sf_dir}/\1.parquet`", sql))


def edges(spark: SparkSession, sf_dir: str, sql: str = EDGES) -> DataFrame:
    from thesaurion.schema import edges as canonical

    return canonical(read(spark, sf_dir, sql))


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thesaurion.schema import concepts as canonical

    return canonical(read(spark, sf_dir, CONCEPTS))
