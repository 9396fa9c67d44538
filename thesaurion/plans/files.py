"""Every loader and interchange file as a query: files are written from the delivered tables, loaded, and compared in SQL.

Rows are (kind, a, b, c): kind `concept` with id, label and status, or a kind of link with both ends and the vocabulary
of the second."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thesaurion.operators import documents as docs
from thesaurion.operators import graph, lookup, retrieval
from thesaurion.operators import similarity as sim
from thesaurion.plans.fixtures import ANNOTATED, CONCEPTS, EDGES, PART_LINKS, SCORES, concepts, edges, oracle, read
from thesaurion.runtime import shared_dir, table
from thesaurion.sources import annotations as ann
from thesaurion.sources import dumps
from thesaurion.sources import vocabularies as voc
from thesaurion.sources.readers import owl_classes

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle(sql)
        return f

    return keep


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """k, n, z, up: key, name, size and parents of the parts."""
    up = read(spark, d, PART_LINKS).groupBy(F.col("child").alias("k")).agg(F.array_sort(F.collect_list("parent")).alias("up"))
    own = read(spark, d, "select cast(p_partkey as string) k, p_name n, p_size z from {part}")
    return own.join(up, "k", "left").withColumn("up", F.coalesce("up", F.array().cast("array<string>")))


def _text(df: DataFrame, line: Column, path: str) -> None:
    df.select(line.alias("value")).write.text(path)


def _xml(df: DataFrame, line: Column, path: str) -> None:
    """Sixteen documents of a root with one element per row."""
    lots = df.select(F.pmod(F.hash("k"), F.lit(16)).alias("file"), line.alias("x")).groupBy("file").agg(F.array_join(F.collect_list("x"), "\n").alias("x"))
    lots.select("file", F.concat(F.lit("<root>\n"), "x", F.lit("\n</root>")).alias("value")).write.partitionBy("file").text(path)


def _tabs(df: DataFrame, path: str, header: bool = True, sep: str = "\t") -> None:
    df.write.option("sep", sep).option("header", header).option("quote", "").option("emptyValue", "").csv(path)


def _rows(loaded: tuple[DataFrame | None, DataFrame]) -> DataFrame:
    c, e = loaded
    links = e.select(F.col("rel_type").alias("kind"), F.col("id_from").alias("a"), F.col("id_to").alias("b"), F.col("prefix_to").alias("c"))
    return links if c is None else c.select(F.lit("concept").alias("kind"), F.col("concept_id").alias("a"), F.col("label").alias("b"), F.col("status").alias("c")).union(links)


_K = "cast(p_partkey as varchar(20))"
_OWN = f"select 'concept' kind, {_K} a, p_name b, case when p_size = 1 then 'deprecated' else 'active' end c from {{part}}"


def _is_a(prefix: str) -> str:
    return f" union all select 'is_a', child, parent, '{prefix}' from ({PART_LINKS}) l"


def _each(rel: str, a: str, b: str, c: str, where: str = "true") -> str:
    return f" union all select '{rel}', {a}, {b}, '{c}' from {{part}} where {where}"


def _class(start: str, p: DataFrame, extra: Column, dead: bool = True) -> Column:
    up = F.array_join(F.transform("up", lambda x: F.concat(F.lit(f'<rdfs:subClassOf rdf:resource="http://x.org/{start}'), x, F.lit('"/>'))), "")
    gone = F.when(F.col("z") == 1, F.lit("<owl:deprecated>true</owl:deprecated>")).otherwise(F.lit("")) if dead else F.lit("")
    return F.concat(F.lit(f'<owl:Class rdf:about="http://x.org/{start}'), "k", F.lit('"><rdfs:label>'), "n", F.lit("</rdfs:label>"), up, gone, extra, F.lit("</owl:Class>"))


@query(_OWN + _is_a("hpo") + _each("replaced_by", f"'9' || {_K}", _K, "hpo", "p_size = 2") + _each("consider", _K, f"'8' || {_K}", "hpo", "p_size = 1"))
def file_hpo(spark, d):
    p, at = _parts(spark, d), _folder(spark)
    alt = F.when(F.col("z") == 2, F.concat(F.lit("<oboInOwl:hasAlternativeId>HP:9"), "k", F.lit("</oboInOwl:hasAlternativeId>"))).otherwise(F.lit(""))
    hint = F.when(F.col("z") == 1, F.concat(F.lit("<oboInOwl:consider>HP:8"), "k", F.lit("</oboInOwl:consider>"))).otherwise(F.lit(""))
    _xml(p, _class("HP_", p, F.concat(alt, hint)), at)
    return _rows(voc.hpo(spark, f"{at}/*"))


@query(_OWN + _is_a("mondo") + _each("exact", _K, _K, "omim", "p_size = 3") + _each("annotated_with", _K, _K, "ordo", "p_size = 4"))
def file_mondo(spark, d):
    p, at = _parts(spark, d), _folder(spark)
    exact = F.when(F.col("z") == 3, F.concat(F.lit('<skos:exactMatch rdf:resource="https://omim.org/entry/'), "k", F.lit('"/>'))).otherwise(F.lit(""))
    ref = F.when(F.col("z") == 4, F.concat(F.lit("<oboInOwl:hasDbXref>Orphanet:"), "k", F.lit("</oboInOwl:hasDbXref>"))).otherwise(F.lit(""))
    _xml(p, _class("MONDO_", p, F.concat(exact, ref)), at)
    return _rows(voc.mondo(spark, f"{at}/*"))


def _restriction(prop: str, target: Column) -> Column:
    return F.concat(F.lit(f'<rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="http://x.org/{prop}"/><owl:someValuesFrom rdf:resource="http://x.org/Orphanet_'), target, F.lit('"/></owl:Restriction></rdfs:subClassOf>'))


@query(_OWN + _is_a("ordo") + _each("replaced_by", _K, f"'7' || {_K}", "ordo", "p_size = 1") + _each("part_of", _K, f"'6' || {_K}", "ordo", "p_size = 2"))
def file_ordo(spark, d):
    p, at = _parts(spark, d), _folder(spark)
    moved = F.when(F.col("z") == 1, _restriction("Orphanet_C056", F.concat(F.lit("7"), "k"))).otherwise(F.lit(""))
    part = F.when(F.col("z") == 2, _restriction("BFO_0000050", F.concat(F.lit("6"), "k"))).otherwise(F.lit(""))
    _xml(p, _class("Orphanet_", p, F.concat(moved, part), dead=False), at)
    return _rows(voc.ordo(spark, f"{at}/*"))


@query(_OWN + _is_a("ncit"))
def file_ncit(spark, d):
    p, at = _parts(spark, d), _folder(spark)
    cells = ["k", F.lit("iri"), F.array_join("up", "|"), F.concat("n", F.lit("|other "), "n"), F.lit("text"), "n", F.when(F.col("z") == 1, "Obsolete_Concept").otherwise(F.lit("")), F.lit("type"), F.lit("")]
    _text(p, F.concat_ws("\t", *cells), at)
    return _rows(voc.ncit(spark, at))


@query(_OWN + _is_a("omim") + _each("replaced_by", f"'9' || {_K}", _K, "omim", "p_size = 2"))
def file_omim(spark, d):
    p, at = _parts(spark, d), _folder(spark)
    address = lambda c: F.concat(F.lit("http://x.org/OMIM/"), c)
    rows = p.select(address("k").alias("Class ID"), F.col("n").alias("Preferred Label"), F.concat("n", F.lit(", old|new")).alias("Synonyms"), F.when(F.col("z") == 1, "true").otherwise("false").alias("Obsolete"), F.array_join(F.transform("up", address), "|").alias("Parents"), F.when(F.col("z") == 2, address(F.concat(F.lit("9"), "k"))).alias("Moved from"))
    rows.write.option("header", True).option("escape", '"').csv(at)
    return _rows(voc.omim(spark, at))


_GONE = "p_size = 1"


@query(f"select 'concept' kind, {_K} a, 'S' || {_K} b, case when p_size in (1, 2) then 'deprecated' else 'active' end c from {{part}}" + _each("has_symbol", _K, f"'S' || {_K}", "gene", "p_size <> 1") + _each("alias_symbol", _K, f"'A' || {_K}", "gene", "p_size <> 1") + _each("previous_symbol", _K, f"'S' || {_K}", "gene", _GONE) + _each("replaced_by", _K, f"'5' || {_K}", "hgnc", _GONE))
def file_hgnc(spark, d):
    p, at = _parts(spark, d), _folder(spark)
    _symbols(p, at)
    return _rows(voc.hgnc(spark, f"{at}/symbol", f"{at}/withdrawn"))


def _symbols(p: DataFrame, at: str) -> None:
    name = F.concat(F.lit("HGNC:"), "k")
    own = p.where("z <> 1").select(name.alias("hgnc_id"), F.concat(F.lit("S"), "k").alias("symbol"), F.col("n").alias("name"), F.when(F.col("z") == 2, "Entry Reserved").otherwise("Approved").alias("status"), F.concat(F.lit("A"), "k").alias("alias_symbol"), F.lit("other name").alias("alias_name"), F.lit("1p3").alias("location"), F.lit("01p3").alias("location_sortable"))
    _tabs(own, f"{at}/symbol")
    into = F.concat(F.lit("HGNC:5"), "k", F.lit("|S5"), "k", F.lit("|Approved"))
    _tabs(p.where("z = 1").select(name.alias("HGNC_ID"), F.concat(F.lit("S"), "k").alias("WITHDRAWN_SYMBOL"), into.alias("MERGED_INTO_REPORT(S)")), f"{at}/withdrawn")


@query(f"select 'concept' kind, 'S' || {_K} a, 'S' || {_K} b, case when p_size = 1 then 'deprecated' else 'active' end c from {{part}} union all select 'concept', 'A' || {_K}, 'A' || {_K}, 'active' from {{part}} where p_size <> 1")
def file_gene_symbols(spark, d):
    p, at = _parts(spark, d), _folder(spark)
    _symbols(p, at)
    return _rows(voc.gene_symbols(spark, f"{at}/symbol", f"{at}/withdrawn"))


@query(f"select 'concept' kind, t || {_K} a, case when t in ('G', 'T') then t || 'N' || {_K} end b, 'active' c from {{part}}, (select unnest(['G', 'T', 'E', 'P']) t)" + _each("part_of", f"'T' || {_K}", f"'G' || {_K}", "ensembl") + _each("part_of", f"'E' || {_K}", f"'T' || {_K}", "ensembl") + _each("part_of", f"'P' || {_K}", f"'T' || {_K}", "ensembl") + _each("has_symbol", f"'G' || {_K}", f"'GN' || {_K}", "gene"))
def file_ensembl(spark, d):
    p, at = _parts(spark, d), _folder(spark)
    pair = lambda name, start: F.concat(F.lit(f'{name} "{start}'), "k", F.lit('"; '))
    gene, trans = F.concat(pair("gene_id", "G"), pair("gene_name", "GN")), F.concat(pair("gene_id", "G"), pair("transcript_id", "T"), pair("transcript_name", "TN"))
    kinds = {"gene": gene, "transcript": trans, "exon": F.concat(trans, pair("exon_id", "E")), "CDS": F.concat(trans, pair("protein_id", "P"))}
    rows = p.select("k", F.inline(F.array(*[F.struct(F.lit(f).alias("f"), a.alias("a")) for f, a in kinds.items()])))
    _text(rows, F.concat_ws("\t", F.lit("1"), F.lit("x"), "f", F.lit("10"), F.lit("20"), F.lit("."), F.lit("+"), F.lit("."), "a"), at)
    return _rows(voc.ensembl(spark, at))


_ID = "regexp_replace(regexp_replace(upper({}), '^[^A-Z0-9]+', ''), '[^A-Z0-9]+$', '')"
_WAY = f"select distinct c, p from (select {_ID.format('sub_pathway_st_id')} c, {_ID.format('parent_st_id')} p from {{pathway_hierarchy}}) y where c <> '' and p <> ''"
_GR = f"select distinct g, k, r from (select {_ID.format('gene_id')} g, relationship k, {_ID.format('reaction_id')} r from {{gene_reaction}}) y where g <> '' and r <> '' and k is not null"


@query(f"with w as ({_WAY}), g as ({_GR}), u as (select distinct r from g), o as (select distinct g from g) select 'concept' kind, c a, 'pathway ' || c b, 'active' c from (select c from w union select p from w) x union all select 'concept', r, 'reaction ' || r, 'active' from u union all select 'concept', g, 'gene ' || g, 'active' from o union all select 'part_of', c, p, 'reactome' from w union all select distinct case when k = 'output' then 'has_output' else 'has_input' end, r, g, 'reactome' from g union all select 'preceded_by', r, r || 'X', 'reactome' from u union all select 'part_of', r, 'Z', 'reactome' from u union all select 'has_symbol', g, 'S' || g, 'gene' from o")
def file_reactome(spark, d):
    at, way, gr = _folder(spark), read(spark, d, _WAY), read(spark, d, _GR)
    put = lambda df, name: df.write.option("header", True).option("escape", '"').csv(f"{at}/{name}.csv")
    named = lambda ids, kind: ids.distinct().toDF("st_id").select("st_id", F.concat(F.lit(f"{kind} "), "st_id").alias("display_name"), F.lit('["a", "b"]').alias("synonyms"), F.lit("true").alias("inferred"))
    u, o = gr.select("r").distinct(), gr.select("g").distinct()
    put(named(way.select("c").union(way.select("p")), "pathway").select("st_id", "display_name"), "pathway")
    put(named(u, "reaction"), "reaction")
    put(named(o, "gene").drop("inferred"), "gene")
    put(way.select(F.col("p").alias("parent_st_id"), F.col("c").alias("sub_pathway_st_id")), "pathway_hierarchy")
    put(u.select(F.col("r").alias("reaction_id"), F.concat("r", F.lit("X")).alias("preceding_reaction_id")), "reaction_order")
    put(u.select(F.lit("Z").alias("pathway_id"), F.col("r").alias("reaction_id")), "reaction_pathway")
    put(gr.select(F.col("g").alias("gene_id"), F.col("k").alias("relationship"), F.col("r").alias("reaction_id")), "gene_reaction")
    put(o.select(F.col("g").alias("gene_id"), F.concat(F.lit("U"), "g").alias("symbol")), "gene_mapping")
    _tabs(o.select(F.concat(F.lit("S"), "g").alias("symbol"), F.concat(F.lit("U"), "g", F.lit("|V"), "g").alias("uniprot_ids")), f"{at}/symbols")
    return _rows(voc.reactome(spark, at, f"{at}/symbols"))


@query(_OWN + _each("part_of", _K, f"'4' || {_K}", "ohdsi", "p_size <> 2") + _each("ohdsi_relationship", _K, f"'3' || {_K}", "ohdsi") + _is_a("ohdsi") + _each("exact", _K, f"'C' || {_K}", "snomed"))
def file_ohdsi(spark, d):
    p, at = _parts(spark, d), _folder(spark)
    put = lambda df, name: _tabs(df, f"{at}/{name}.csv")
    put(p.select(F.col("k").alias("concept_id"), F.col("n").alias("concept_name"), F.lit("SNOMED").alias("vocabulary_id"), F.concat(F.lit("C"), "k").alias("concept_code"), F.when(F.col("z") == 1, "20200101").otherwise("20991231").alias("valid_end_date")), "CONCEPT")
    put(p.select(F.col("k").alias("concept_id"), F.concat(F.lit("other "), "n").alias("concept_synonym_name")), "CONCEPT_SYNONYM")
    strength = {f"{s}_{x}": F.lit("1") for s in ("amount", "numerator", "denominator") for x in ("value", "unit_concept_id")}
    put(p.select(F.col("k").alias("drug_concept_id"), F.lit("2").alias("ingredient_concept_id"), *[v.alias(x) for x, v in strength.items()]), "DRUG_STRENGTH")
    end = lambda c: F.when(c, "20200101").otherwise("20991231").alias("valid_end_date")
    # both directions of a relation are delivered; they are one link
    rel = p.select(F.col("k").alias("concept_id_1"), F.concat(F.lit("4"), "k").alias("concept_id_2"), F.lit("Part of").alias("relationship_id"), end(F.col("z") == 2))
    back = rel.select("concept_id_2", "concept_id_1", F.lit("Has part of"), "valid_end_date")
    other = p.select("k", F.concat(F.lit("3"), "k"), F.lit("Looks like"), end(F.lit(False)))
    put(rel.union(back).union(other), "CONCEPT_RELATIONSHIP")
    put(spark.createDataFrame([("Part of", "Has part of"), ("Has part of", "Part of"), ("Looks like", "Looked at by"), ("Looked at by", "Looks like")], "relationship_id string, reverse_relationship_id string").coalesce(1), "RELATIONSHIP")
    put(p.select("k", F.explode("up").alias("o")).select(F.col("k").alias("descendant_concept_id"), F.col("o").alias("ancestor_concept_id"), F.lit("1").alias("min_levels_of_separation")), "CONCEPT_ANCESTOR")
    return _rows(voc.ohdsi(spark, at, 20260101))


@query(_OWN + _is_a("snomed") + _each("replaced_by", _K, f"'2' || {_K}", "snomed", "p_size = 1"))
def file_snomed(spark, d):
    p, at = _parts(spark, d), _folder(spark)
    put = lambda df, name: _tabs(df, f"{at}/{name}.txt")
    # two states of each concept; the later one counts
    state = lambda when, active: p.select(F.col("k").alias("id"), F.lit(when).alias("effectiveTime"), active.alias("active"), F.lit(voc.FULLY_DEFINED).alias("definitionStatusId"))
    put(state("20200101", F.when(F.col("z") == 1, "1").otherwise("0")).union(state("20210101", F.when(F.col("z") == 1, "0").otherwise("1"))), "concept")
    term = lambda lead, kind, text: p.select(F.concat(F.lit(lead), "k").alias("id"), F.lit("20210101").alias("effectiveTime"), F.lit("1").alias("active"), F.col("k").alias("conceptId"), F.lit(kind).alias("typeId"), text.alias("term"))
    put(term("1", voc.FULL_NAME, F.col("n")).union(term("2", "900000000000013009", F.concat(F.lit("other "), "n"))), "description")
    put(term("3", "900000000000550004", F.lit("a text")), "definition")
    link = lambda df, lead, kind, to: df.select(F.concat(F.lit(lead), "k", F.lit("0"), to).alias("id"), F.lit("20210101").alias("effectiveTime"), F.lit("1").alias("active"), F.col("k").alias("sourceId"), to.alias("destinationId"), F.lit(kind).alias("typeId"))
    up = link(p.select("k", F.explode("up").alias("o")), "5", voc.IS_A, F.col("o"))
    put(up.union(link(p.where("z = 1"), "6", voc.REPLACED_BY, F.concat(F.lit("2"), "k"))), "relationship")
    return _rows(voc.snomed(spark, at))


@query(f"select 'concept' kind, {_K} a, p_name b, case when p_size = 1 then 'deprecated' else 'active' end c from {{part}}" + _is_a("ctv3") + _each("replaced_by", f"'9' || {_K}", _K, "ctv3", "p_size = 2"))
def file_ctv3(spark, d):
    p, at = _parts(spark, d), _folder(spark)
    put = lambda df, name: _tabs(df, f"{at}/{name}", False, "|")
    put(p.select("k", F.when(F.col("z") == 1, "R").otherwise("C")), "concept.v3")
    put(p.select("k", F.concat(F.lit("t"), "k"), F.lit("P")), "description.v3")
    put(p.select(F.concat(F.lit("t"), "k"), F.lit("C"), F.substring("n", 1, 4), F.lit(""), "n"), "term.v3")
    put(p.select("k", F.explode("up").alias("o")), "hierarchy.v3")
    put(p.where("z = 2").select("k", F.concat(F.lit("9"), "k")), "redundancy.map")
    return _rows(voc.ctv3(spark, at))


_PAIR = f"select '{{}}' kind, a, b, '{{}}' c from ({ANNOTATED}) s"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, ANNOTATED)


@query(_PAIR.replace("'{}' kind", "'annotated_with' kind").replace("'{}' c", "'hpo' c"))
def annotation_gene_hpo(spark, d):
    at = _folder(spark)
    _tabs(_pairs(spark, d).select(F.col("a").alias("gene_symbol"), F.concat(F.lit("HP:"), "b").alias("hpo_id"), F.lit("HP:0040283").alias("frequency")), at)
    return _rows((None, ann.gene_hpo(spark, at)))


@query(_PAIR.replace("'{}' kind", "'annotated_with' kind").replace("'{}' c", "'gene' c"))
def annotation_ncit_gene(spark, d):
    at = _folder(spark)
    _tabs(_pairs(spark, d).select("a", F.concat(F.lit("HGNC:"), "b")), at, False)
    return _rows((None, ann.ncit_gene(spark, at)))


@query(_PAIR.replace("'{}' kind", "'annotated_with' kind").replace("'{}' c", "'gene' c"))
def annotation_omim_gene(spark, d):
    at = _folder(spark)
    rows = _pairs(spark, d).groupBy("a").agg(F.array_join(F.array_sort(F.collect_list("b")), "|").alias("Gene Symbol"))
    rows.select(F.concat(F.lit("http://x.org/OMIM/"), "a").alias("Class ID"), "Gene Symbol").write.option("header", True).csv(at)
    return _rows((None, ann.omim_gene(spark, at)))


@query(_PAIR.replace("'{}' kind", "'annotated_with' kind").replace("'{}' c", "'gene' c"))
def annotation_ordo_gene(spark, d):
    at = _folder(spark)
    one = F.transform("bs", lambda b: F.concat(F.lit("<DisorderGeneAssociation><Gene><Symbol>"), b, F.lit("</Symbol></Gene></DisorderGeneAssociation>")))
    rows = _pairs(spark, d).groupBy("a").agg(F.collect_list("b").alias("bs"))
    _xml(rows.withColumn("k", F.col("a")), F.concat(F.lit("<Disorder><OrphaCode>"), "a", F.lit("</OrphaCode><DisorderGeneAssociationList>"), F.array_join(one, ""), F.lit("</DisorderGeneAssociationList></Disorder>")), at)
    return _rows((None, ann.ordo_gene(spark, f"{at}/*")))


@query(_PAIR.replace("'{}' kind", "'annotated_with' kind").replace("'{}' c", "'hpo' c"))
def annotation_ordo_hpo(spark, d):
    at = _folder(spark)
    _xml(_pairs(spark, d).withColumn("k", F.col("a")), F.concat(F.lit('<owl:Class rdf:about="http://x.org/Orpha:'), "a", F.lit("_HP:"), "b", F.lit('_Freq:F"></owl:Class>')), at)
    return _rows((None, ann.ordo_hpo(owl_classes(spark, f"{at}/*"))))


@query(_PAIR.replace("'{}' kind", "'annotated_with' kind").replace("'{}' c", "'omim' c"))
def annotation_ordo_omim(spark, d):
    at = _folder(spark)
    rows = _pairs(spark, d).groupBy("a").agg(F.collect_list(F.struct(F.lit("OMIM").alias("Source"), F.col("b").alias("Reference"))).alias("x"))
    refs = F.array(F.struct(F.size("x").cast("string").alias("count"), F.col("x").alias("ExternalReference")))
    one = rows.select(F.struct(F.col("a").alias("OrphaCode"), refs.alias("ExternalReferenceList")).alias("o"))
    # the published file is one document, and so is each file here
    whole = one.groupBy(F.pmod(F.hash("o.OrphaCode"), F.lit(16)).alias("file")).agg(F.collect_list("o").alias("o"))
    whole = whole.select("file", F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.col("o").alias("Disorder"))).alias("DisorderList"))).alias("JDBOR"))).alias("value"))
    whole.write.partitionBy("file").text(at)
    return _rows((None, ann.ordo_omim(spark, f"{at}/*")))


def _map_set(spark: SparkSession, d: str, at: str) -> None:
    one = lambda when, active: _pairs(spark, d).select(F.concat_ws("-", "a", "b").alias("id"), F.lit(when).alias("effectiveTime"), F.lit(active).alias("active"), F.col("a").alias("referencedComponentId"), F.col("b").alias("mapTarget"))
    _tabs(one("20200101", "0").union(one("20210101", "1")), at)


@query(_PAIR.replace("'{}' kind", "'annotated_with' kind").replace("'{}' c", "'ordo' c"))
def annotation_snomed_ordo(spark, d):
    at = _folder(spark)
    _map_set(spark, d, at)
    return _rows((None, ann.snomed_ordo(spark, at)))


@query(_PAIR.replace("'{}' kind", "'annotated_with' kind").replace("'{}' c", "'ctv3' c"))
def annotation_snomed_ctv3(spark, d):
    at = _folder(spark)
    _map_set(spark, d, at)
    return _rows((None, ann.snomed_ctv3(spark, at)))


@query(f"select rel_type kind, id_from a, id_to b, prefix_to c from ({EDGES}) e where (prefix_from = 'part' and prefix_to = 'supplier') or (prefix_from = 'supplier' and prefix_to = 'part')")
def annotation_view(spark, d):
    return _rows((None, ann.view(edges(spark, d), "supplier", "part")))


@query(f"select prefix, concept_id, label from ({CONCEPTS}) c where prefix = 'part'")
def dump_documents(spark, d):
    at = _folder(spark)
    dumps.write_documents(concepts(spark, d).where("prefix = 'part'"), at)
    return dumps.read_documents(spark, at, "part").select("prefix", "concept_id", "label")


@query(f"select distinct rel_type kind, id_from a, id_to b, prefix_to c from ({EDGES}) e where prefix_from = 'part' and prefix_to = 'part'")
def dump_graph(spark, d):
    at = _folder(spark) + "/part"
    dumps.write_graph(edges(spark, d).where("prefix_from = 'part' and prefix_to = 'part'"), concepts(spark, d).where("prefix = 'part'"), at)
    return _rows((None, dumps.read_graph(spark, at, "part")))


@query(_PAIR.replace("'{}' kind", "'annotated_with' kind").replace("'{}' c", "'hpo' c"))
def dump_annotations(spark, d):
    at = _folder(spark)
    e = _pairs(spark, d).select(F.lit("gene").alias("prefix_from"), F.col("a").alias("id_from"), F.lit("hpo").alias("prefix_to"), F.col("b").alias("id_to"), F.lit("annotated_with").alias("rel_type"), F.create_map(F.lit("frequency"), F.lit('a "b", c')).alias("props"))
    dumps.write_annotations(e, at)
    return _rows((None, dumps.read_annotations(spark, at, "gene", "hpo").where("props['frequency'] = 'a \"b\", c'")))


@query(f"select id_from, id_to, 'relevance:hpo' score_key, score from ({SCORES}) s where score_key = 'relevance:hpo' and score >= 0.2")
def dump_similarities(spark, d):
    s = read(spark, d, SCORES).where("score_key = 'relevance:hpo'")
    return dumps.read_similarities(spark, dumps.write_similarities(s, _folder(spark), "snomed", "relevance", "hpo")).select("id_from", "id_to", "score_key", "score")


for _name, _rel, _out in (("reactions_in_pathway", "part_of", False), ("pathways_of_reaction", "part_of", True), ("preceding_reactions", "preceded_by", True), ("subsequent_reactions", "preceded_by", False)):

    def _typed(spark, d, name=_name):
        """Suppliers as reactions of the nations, each before the next of its number."""
        e = read(spark, d, "select 'reactome' prefix_from, concat('s', s_suppkey) id_from, 'reactome' prefix_to, concat('n', s_nationkey) id_to, 'part_of' rel_type from {supplier} union all select 'reactome', concat('s', s_suppkey), 'reactome', concat('s', s_suppkey - 1), 'preceded_by' from {supplier} where s_suppkey > 1")
        ids = e.select("id_from").union(e.select("id_to")).distinct().toDF("concept_id")
        c = ids.select(F.lit("reactome").alias("prefix"), "concept_id", F.array(F.when(F.col("concept_id").startswith("s"), "reaction").otherwise("pathway")).alias("concept_types"))
        return graph.typed_hop(name, e, c, c).where("related_id is not null").select("concept_id", "related_id")

    _a, _b = "'s' || cast(s_suppkey as varchar)", "'n' || cast(s_nationkey as varchar)" if _rel == "part_of" else "'s' || cast(s_suppkey - 1 as varchar)"
    QUERIES[f"typed_{_name}"] = _typed
    ORACLES[f"typed_{_name}"] = oracle(f"select {_a if _out else _b} concept_id, {_b if _out else _a} related_id from {{supplier}} where {'true' if _rel == 'part_of' else 's_suppkey > 1'}")


@query(f"select prefix, count(*) n from (select prefix, concept_id from ({CONCEPTS}) c union select prefix_from, id_from from ({EDGES}) e union select prefix_to, id_to from ({EDGES}) f) x group by 1")
def count_terms(spark, d):
    return docs.count_terms(concepts(spark, d), edges(spark, d))


@query(f"""with h as (select distinct prefix_from, id_from, prefix_to, id_to from ({EDGES}) e where rel_type in ('is_a', 'part_of')),
 u as (select prefix_from p, id_from i, string_agg(distinct id_to, ' ' order by id_to) x from h group by 1, 2), w as (select prefix_to p, id_to i, string_agg(distinct id_from, ' ' order by id_from) x from h group by 1, 2)
 select prefix, concept_id, label, coalesce(u.x, '') parents, coalesce(w.x, '') children from ({CONCEPTS}) c left join u on u.p = prefix and u.i = concept_id left join w on w.p = prefix and w.i = concept_id""")
def concept_info(spark, d):
    c = concepts(spark, d)
    out = docs.concept_info(c, edges(spark, d), c)
    return out.select("prefix", "concept_id", "label", F.array_join("parents", " ").alias("parents"), F.array_join("children", " ").alias("children"))


@query(f"select prefix, concept_id, case when prefix = 'part' then 'v' || concept_id end vector_id from ({CONCEPTS}) c")
def set_vector_ids(spark, d):
    c = concepts(spark, d)
    return docs.set_vector_ids(c, c.where("prefix = 'part'").select("prefix", "concept_id", F.concat(F.lit("v"), "concept_id").alias("vector_id"))).select("prefix", "concept_id", "vector_id")


@query(f"select id_from, id_to, score_key, case when score >= 0.5 then 1.0 else score end score from ({SCORES}) s")
def save_scores(spark, d):
    s = read(spark, d, SCORES)
    return sim.save_scores(s, s.where("score >= 0.5").withColumn("score", F.lit(1.0))).select("id_from", "id_to", "score_key", "score")


@query(f"select prefix_from, prefix_to, rel_type, count(*) n from ({EDGES}) e where prefix_from <> 'supplier' and prefix_to <> 'supplier' group by 1, 2, 3 union all select prefix, prefix, 'concept', count(*) from ({CONCEPTS}) c where prefix <> 'supplier' group by 1")
def delete_vocabulary(spark, d):
    c, e, _ = docs.delete_vocabulary(concepts(spark, d), edges(spark, d), spark.createDataFrame([], "prefix string"), "supplier")
    return e.groupBy("prefix_from", "prefix_to", "rel_type").agg(F.count(F.lit(1)).alias("n")).union(c.groupBy("prefix", F.col("prefix").alias("p"), F.lit("concept").alias("k")).agg(F.count(F.lit(1)).alias("n")))


@query(f"select prefix_from, prefix_to, count(*) n from ({EDGES}) e where not (prefix_from = 'part' and prefix_to = 'supplier') group by 1, 2")
def delete_annotations(spark, d):
    return graph.count_edges(docs.delete_annotations(edges(spark, d), "part", "supplier"))


@query(f"select distinct id_from, id_to, rel_type from ({EDGES}) e where prefix_from = 'part' and prefix_to = 'part'")
def vocabulary_graph(spark, d):
    return docs.vocabulary_graph(edges(spark, d), "part")


@query(f"select 'supplier:' || b node_1, 'part:' || a node_2 from ({ANNOTATED}) s")
def annotation_graph(spark, d):
    return docs.annotation_graph(edges(spark, d), "supplier", "part").select("node_1", "node_2")


@query(f"with s as ({SCORES}), b as (select id_from i, id_to i2, score_key, score from s union select id_to, id_from, score_key, score from s) select i concept_id, i2 neighbour_id, score_key, max(score) score from b where score >= 0.8 group by 1, 2, 3")
def similar_groups(spark, d):
    s = read(spark, d, SCORES)
    ask = s.select(F.col("prefix_from").alias("prefix"), F.col("id_from").alias("concept_id")).union(s.select("prefix_to", "id_to")).distinct()
    nested = retrieval.similar_groups(retrieval.similar_full(s, ask, threshold=0.8))
    flat = nested.select("concept_id", F.explode("similar").alias("x")).select("concept_id", F.col("x.concept_id").alias("neighbour_id"), F.explode("x.scores").alias("score_key", "score"))
    return flat


@query(f"select prefix, concept_id, label, 'active' status from ({CONCEPTS}) c where prefix = 'nation' union all select 'nation', 'x' || concept_id, null, 'unknown' from ({CONCEPTS}) c where prefix = 'nation'")
def concept_or_unknown(spark, d):
    c = concepts(spark, d).where("prefix = 'nation'").withColumn("status", F.lit("active"))
    ask = c.select("prefix", "concept_id").union(c.select("prefix", F.concat(F.lit("x"), "concept_id")))
    return lookup.with_unknown(ask, c).select("prefix", "concept_id", "label", "status")


@query(f"select 'http://x.org/' || prefix url, prefix, count(*) as count from ({CONCEPTS}) c group by 2")
def code_systems(spark, d):
    c = concepts(spark, d)
    status = docs.vocabulary_status(c, edges(spark, d), spark.createDataFrame([], "prefix string"), c.select("prefix").distinct())
    return lookup.code_systems(status, "http://x.org/")


@query("""with p as (select q.vec_id query_id, v.vec_id concept_id, list_cosine_similarity(cast(q.embedding as double[]), cast(v.embedding as double[])) c from {embeddings} q, {embeddings} v where q.vec_id % 50 = 0),
 k as (select *, row_number() over (partition by query_id order by c desc, concept_id) r from p)
 select query_id, r as rank, cast(p_partkey as varchar) concept_id, p_name label from k join {part} on p_partkey = concept_id + 1 where r <= 10""")
def search_concepts(spark, d):
    """V-02: the concepts nearest to a query vector, with their rank; vector n belongs to part n + 1. As queries every
    vector whose id is divisible by 50, against all."""
    v = table(spark, d, "embeddings").select((F.col("vec_id") + 1).alias("concept_id"), F.col("embedding").alias("vector"))
    q = v.where("(concept_id - 1) % 50 = 0").select((F.col("concept_id") - 1).alias("query_id"), "vector")
    return retrieval.search(v, q, concepts(spark, d).where("prefix = 'part'"), 10).select("query_id", "rank", "concept_id", "label")
