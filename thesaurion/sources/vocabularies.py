"""Vocabulary files to canonical concepts and edges (F-01 to F-23). Every loader returns (concepts, edges)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thesaurion.functions.curie import OMOP_NAMES, url_curie, vocabulary_prefix
from thesaurion.functions.text import attributes, ctv3_status, json_synonyms, last_part, longest_term
from thesaurion.operators.documents import latest_rows
from thesaurion.operators.lookup import fold_labels, symbol_sets
from thesaurion.schema import concepts as concept_rows
from thesaurion.schema import edges as edge_rows
from thesaurion.sources.readers import csv, delimited, owl_classes

Loaded = tuple[DataFrame, DataFrame]

# Identifiers of the clinical terminology's release format.
FULLY_DEFINED, FULL_NAME, IS_A, REPLACED_BY = "900000000000073002", "900000000000003001", "116680003", "370124000"

# OMOP relationships that mean one of ours, along the link (True) or against it.
OMOP_RELATIONS = {
    "Occurs after": ("preceded_by", True), "After": ("preceded_by", True), "Occurs before": ("preceded_by", False), "Before": ("preceded_by", False),
    "LOINC replaced by": ("replaced_by", True), "Concept replaced by": ("replaced_by", True), "LOINC replaces": ("replaced_by", False), "Concept replaces": ("replaced_by", False),
    "Constitutes": ("part_of", True), "Contained in": ("part_of", True), "Part of": ("part_of", True), "Component of": ("part_of", True),
    "Consists of": ("part_of", False), "Contains": ("part_of", False), "Has part of": ("part_of", False), "Has component": ("part_of", False),
    "Is a": ("is_a", True), "RxNorm is a": ("is_a", True), "Subsumes": ("is_a", False),
}


def _status(dead: Column) -> Column:
    return F.when(F.coalesce(dead, F.lit(False)), "deprecated").otherwise("active")


def _full(c: str) -> Column:
    return F.when(F.length(F.trim(F.col(c))) > 0, F.col(c))


def _split(c: str, sep: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(c), F.lit("")), sep), lambda x: F.length(F.trim(x)) > 0)


def _link(rows: DataFrame, a: str | Column, b: str | Column, rel: str | Column, prefix: str) -> DataFrame:
    col = lambda x: F.col(x) if isinstance(x, str) else x
    out = rows.select(col(a).alias("id_from"), col(b).alias("id_to"), (F.lit(rel) if isinstance(rel, str) else rel).alias("rel_type"))
    return edge_rows(out.where("id_from is not null and id_to is not null").distinct(), prefix, prefix)


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _ontology(classes: DataFrame, start: str) -> DataFrame:
    own = classes.where(F.col("name").startswith(start)).withColumn("concept_id", last_part("name", "_"))
    dead = F.exists("deprecated", lambda x: F.lower(x) == "true")
    return own.select("*", F.try_element_at("labels", F.lit(1)).alias("label"), F.coalesce(F.try_element_at("definitions", F.lit(1)), F.try_element_at("efo_definitions", F.lit(1))).alias("definition"), F.try_element_at("comments", F.lit(1)).alias("comment"), _status(dead).alias("status"))


def hpo(spark: SparkSession, path: str) -> Loaded:
    """F-01."""
    own = _ontology(owl_classes(spark, path), "HP_").withColumn("synonyms", F.array().cast("array<string>"))
    tail = lambda c: F.regexp_extract(c, r"([^_:]*)$", 1)
    up = own.select("concept_id", F.explode("parents").alias("o")).where("o like 'HP\\_%'")
    alt = own.select("concept_id", F.explode("alternative_ids").alias("o"))
    hint = own.select("concept_id", F.explode("consider").alias("o"))
    links = _union(_link(up, "concept_id", tail(F.col("o")), "is_a", "hpo"), _link(alt, tail(F.col("o")), "concept_id", "replaced_by", "hpo"), _link(hint, "concept_id", tail(F.col("o")), "consider", "hpo"))
    return concept_rows(own, "hpo"), links


def _typed(kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("rel"), url_curie(x).alias("curie")))


def mondo(spark: SparkSession, path: str) -> Loaded:
    """F-02: also its annotations: matches by kind, other cross references as annotated_with."""
    own = _ontology(owl_classes(spark, path), "MONDO_").withColumn("synonyms", F.when(F.size("exact_synonyms") > 0, F.col("exact_synonyms")))
    up = own.select("concept_id", F.explode("parents").alias("o")).where("o like 'MONDO\\_%'")
    kinds = F.flatten(F.array(*[_typed(k) for k in ("exact", "broad", "narrow", "related")]))
    match = own.select("concept_id", F.inline(kinds)).where("curie is not null")
    others = own.select("concept_id", F.explode("xrefs").alias("curie")).where("instr(curie, ':') > 0").join(match.select("concept_id", "curie").distinct(), ["concept_id", "curie"], "left_anti").withColumn("rel", F.lit("annotated_with"))
    ann = match.unionByName(others).select(F.lit("mondo").alias("prefix_from"), F.col("concept_id").alias("id_from"), vocabulary_prefix(F.substring_index("curie", ":", 1)).alias("prefix_to"), F.regexp_replace("curie", r"^[^:]*:", "").alias("id_to"), F.col("rel").alias("rel_type")).distinct()
    return concept_rows(own, "mondo"), _union(_link(up, "concept_id", last_part("o", "_"), "is_a", "mondo"), edge_rows(ann))


def ordo(spark: SparkSession, path: str) -> Loaded:
    """F-03: a restriction `moved to` deprecates a concept and replaces it."""
    own = _ontology(owl_classes(spark, path), "Orphanet_")
    rest = own.select("concept_id", F.inline("restrictions"))
    moved = rest.where("property = 'Orphanet_C056'").select("concept_id", last_part("value", "_").alias("o"))
    part = rest.where("property like '%BFO\\_0000050'").select("concept_id", last_part("value", "_").alias("o"))
    up = own.select("concept_id", F.explode("parents").alias("o")).where("o like 'Orphanet\\_%'")
    gone = F.exists("restrictions", lambda r: r["property"] == "Orphanet_C056")
    own = own.withColumn("status", F.when(gone, "deprecated").otherwise(F.col("status"))).withColumn("synonyms", F.when(F.size("alternative_terms") > 0, F.col("alternative_terms")))
    links = _union(_link(up, "concept_id", last_part("o", "_"), "is_a", "ordo"), _link(moved, "concept_id", "o", "replaced_by", "ordo"), _link(part, "concept_id", "o", "part_of", "ordo"))
    return concept_rows(own, "ordo"), links


def ncit(spark: SparkSession, path: str) -> Loaded:
    """F-04."""
    names = ["code", "concept_iri", "parents", "synonyms", "definition", "display_name", "concept_status", "semantic_type", "concept_in_subset"]
    raw = delimited(spark, path, columns=names).where("code is not null")
    syn = _split("synonyms", r"\|")
    own = raw.select(F.col("code").alias("concept_id"), F.try_element_at(syn, F.lit(1)).alias("label"), F.when(F.size(syn) > 1, F.slice(syn, F.lit(2), F.size(syn))).alias("synonyms"), "definition", _status(F.col("concept_status").contains("Obsolete_Concept")).alias("status"))
    return concept_rows(own, "ncit"), _link(raw.select("code", F.explode(_split("parents", r"\|")).alias("o")), "code", "o", "is_a", "ncit")


def omim(spark: SparkSession, path: str) -> Loaded:
    """F-05."""
    raw = csv(spark, path).withColumn("concept_id", last_part("`Class ID`", "/"))
    syn = _split("`Synonyms`", r"\|")
    own = raw.select("concept_id", F.col("`Preferred Label`").alias("label"), F.when(F.size(syn) > 0, syn).alias("synonyms"), _status(F.lower(F.col("`Obsolete`")).isin("true", "1")).alias("status"))
    up = raw.select("concept_id", F.explode(_split("`Parents`", r"\|")).alias("o"))
    old = raw.select("concept_id", F.explode(_split("`Moved from`", r"\|")).alias("o"))
    return concept_rows(own, "omim"), _union(_link(up, "concept_id", last_part("o", "/"), "is_a", "omim"), _link(old, last_part("o", "/"), "concept_id", "replaced_by", "omim"))


def hgnc(spark: SparkSession, symbols: str, withdrawn: str) -> Loaded:
    """F-06: ids are kept without their HGNC: prefix everywhere."""
    local = lambda c: F.regexp_replace(F.col(c), "^(?i)hgnc:", "")
    raw = delimited(spark, symbols).where("status is null or status <> 'Entry Withdrawn'").withColumn("concept_id", local("hgnc_id"))
    syn = F.concat(_split("alias_symbol", r"\|"), _split("alias_name", r"\|"))
    own = raw.select("concept_id", F.col("symbol").alias("label"), F.when(F.size(syn) > 0, syn).alias("synonyms"), F.col("name").alias("definition"), F.coalesce(_full("location_sortable"), _full("location")).alias("location"), _status(F.coalesce(F.col("status") != "Approved", F.lit(True))).alias("status"))
    gone = delimited(spark, withdrawn)
    merged = next(c for c in gone.columns if c.upper().startswith("MERGED_INTO"))
    gone = gone.withColumn("concept_id", local("HGNC_ID")).withColumn("into", _split(f"`{merged}`", ", "))
    dead = gone.select("concept_id", F.col("WITHDRAWN_SYMBOL").alias("label"), F.lit("deprecated").alias("status"))
    to = gone.select("concept_id", F.explode("into").alias("o")).select("concept_id", F.regexp_replace(F.substring_index("o", "|", 1), "^(?i)hgnc:", "").alias("o"))
    ann = _union(
        raw.select("concept_id", F.col("symbol").alias("o"), F.lit("has_symbol").alias("rel_type")),
        raw.select("concept_id", F.explode(_split("alias_symbol", r"\|")).alias("o"), F.lit("alias_symbol").alias("rel_type")),
        gone.select("concept_id", F.col("WITHDRAWN_SYMBOL").alias("o"), F.lit("previous_symbol").alias("rel_type")),
    ).where("o is not null").select(F.lit("hgnc").alias("prefix_from"), F.col("concept_id").alias("id_from"), F.lit("gene").alias("prefix_to"), F.col("o").alias("id_to"), "rel_type")
    return concept_rows(concept_rows(own, "hgnc").unionByName(concept_rows(dead, "hgnc"))), _union(_link(to, "concept_id", "o", "replaced_by", "hgnc"), edge_rows(ann))


def gene_symbols(spark: SparkSession, symbols: str, withdrawn: str) -> Loaded:
    """F-07."""
    raw = delimited(spark, symbols).where("status is null or status <> 'Entry Withdrawn'")
    sets = symbol_sets(raw.select("symbol"), raw.select(F.explode(_split("alias_symbol", r"\|"))), delimited(spark, withdrawn).select("WITHDRAWN_SYMBOL"))
    own = concept_rows(sets.select(F.col("symbol").alias("concept_id"), F.col("symbol").alias("label"), "status"), "gene")
    return own, edge_rows(own.where("false").select("prefix"))


def ensembl(spark: SparkSession, path: str) -> Loaded:
    """F-09: the first row of an id by file order wins."""
    names = ["seqname", "source", "feature", "start", "end", "score", "strand", "frame", "attribute"]
    raw = delimited(spark, path, columns=names, comment="#").withColumn("a", attributes("attribute")).withColumn("_at", F.monotonically_increasing_id())
    at = lambda k: F.try_element_at("a", F.lit(k))
    parts = []
    for feature, key, kind, label, bio in (("gene", "gene_id", "gene", "gene_name", "gene_biotype"), ("transcript", "transcript_id", "transcript", "transcript_name", "transcript_biotype"), ("exon", "exon_id", "exon", None, None), ("CDS", "protein_id", "protein", None, None)):
        rows = raw.where(F.col("feature") == feature).select(at(key).alias("concept_id"), F.array(F.lit(kind)).alias("concept_types"), (at(label) if label else F.lit(None).cast("string")).alias("label"), (at(bio) if bio else F.lit(None).cast("string")).alias("bio_type"), F.expr("try_cast(start as bigint)").alias("start"), F.expr("try_cast(`end` as bigint)").alias("end"), F.col("seqname").alias("sequence"), F.lit("active").alias("status"), "_at")
        rows = rows.where("concept_id is not null")
        cols = [c for c in rows.columns if c not in ("concept_id", "_at")]
        parts.append(concept_rows(rows.groupBy("concept_id").agg(F.min_by(F.struct(*cols), "_at").alias("r")).select("concept_id", "r.*"), "ensembl"))
    of = lambda feature, a, b: _link(raw.where(F.col("feature") == feature), at(a), at(b), "part_of", "ensembl")
    ann = raw.where("feature = 'gene'").select(F.lit("ensembl").alias("prefix_from"), at("gene_id").alias("id_from"), F.lit("gene").alias("prefix_to"), at("gene_name").alias("id_to"), F.lit("has_symbol").alias("rel_type")).where("id_to is not null").distinct()
    return _union(*parts), _union(of("transcript", "transcript_id", "gene_id"), of("exon", "exon_id", "transcript_id"), of("CDS", "protein_id", "transcript_id"), edge_rows(ann))


def uniprot_symbols(symbols: DataFrame) -> DataFrame:
    """F-10b: (accession, symbol); the first symbol by row order. symbols: symbol, uniprot_ids, place."""
    rows = symbols.select("symbol", "place", F.explode(_split("uniprot_ids", r"\|")).alias("accession"))
    return rows.groupBy("accession").agg(F.min_by("symbol", "place").alias("symbol"))


def reactome(spark: SparkSession, folder: str, symbols: str | None = None) -> Loaded:
    """F-10: with the symbol file, genes are linked to symbols by their accessions; unresolved ones have no link."""
    read = lambda n: csv(spark, f"{folder}/{n}.csv")
    parts = []
    for name, kind in (("pathway", "pathway"), ("reaction", "reaction"), ("gene", "gene")):
        raw = read(name)
        has = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")  # noqa: E731, B023
        parts.append(concept_rows(raw.select(F.col("st_id").alias("concept_id"), F.array(F.lit(kind)).alias("concept_types"), F.col("display_name").alias("label"), json_synonyms(has("synonyms"), F.col("display_name")).alias("synonyms"), (F.lower(has("inferred")) == "true").alias("inferred"), F.lit("active").alias("status")), "reactome"))
    gr = read("gene_reaction")
    links = [
        _link(read("pathway_hierarchy"), "sub_pathway_st_id", "parent_st_id", "part_of", "reactome"),
        _link(read("reaction_order"), "reaction_id", "preceding_reaction_id", "preceded_by", "reactome"),
        _link(read("reaction_pathway"), "reaction_id", "pathway_id", "part_of", "reactome"),
        _link(gr.where("relationship = 'output'"), "reaction_id", "gene_id", "has_output", "reactome"),
        _link(gr.where("relationship <> 'output'"), "reaction_id", "gene_id", "has_input", "reactome"),
    ]
    if symbols:
        known = uniprot_symbols(delimited(spark, symbols).withColumn("place", F.monotonically_increasing_id()))
        gm = read("gene_mapping").select("gene_id", F.col("symbol").alias("accession")).join(known, "accession")
        links.append(edge_rows(gm.select(F.col("gene_id").alias("id_from"), F.col("symbol").alias("id_to"), F.lit("has_symbol").alias("rel_type")).distinct(), "reactome", "gene"))
    return _union(*parts), _union(*links)


def ohdsi(spark: SparkSession, folder: str, today: int, strengths: bool = True) -> Loaded:
    """F-11 to F-16. today is a number yyyymmdd."""
    read = lambda n: delimited(spark, f"{folder}/{n}.csv")
    raw = read("CONCEPT").where("concept_id is not null")
    own = raw.select("concept_id", F.col("concept_name").alias("label"), _status(F.expr("try_cast(valid_end_date as int)") < today).alias("status"))
    syn = read("CONCEPT_SYNONYM").where("concept_synonym_name is not null").groupBy("concept_id").agg(F.array_sort(F.collect_set("concept_synonym_name")).alias("synonyms"))
    own = own.join(syn, "concept_id", "left")
    if strengths:
        d = read("DRUG_STRENGTH")
        unit = raw.select(F.col("concept_id").alias("u"), F.col("concept_name").alias("n"))
        for side in ("amount", "numerator", "denominator"):
            d = d.join(unit.toDF(f"{side}_unit_concept_id", f"{side}_unit"), f"{side}_unit_concept_id", "left")
        value = lambda s: F.expr(f"try_cast({s}_value as double)").alias(f"{s}_value")
        one = F.struct(F.col("ingredient_concept_id").alias("ingredient_id"), value("amount"), "amount_unit", value("numerator"), "numerator_unit", value("denominator"), "denominator_unit")
        own = own.join(d.groupBy(F.col("drug_concept_id").alias("concept_id")).agg(F.array_sort(F.collect_list(one)).alias("drug_strengths")), "concept_id", "left")
    rel = read("CONCEPT_RELATIONSHIP").where(F.expr("try_cast(valid_end_date as int)") >= today).where("concept_id_1 <> concept_id_2")
    links = _union(omop_links(rel, read("RELATIONSHIP")), _link(read("CONCEPT_ANCESTOR").where("min_levels_of_separation = '1'"), "descendant_concept_id", "ancestor_concept_id", "is_a", "ohdsi"))
    ann = raw.where("vocabulary_id is not null and concept_code is not null and vocabulary_id <> 'Vocabulary' and concept_code <> concept_id")
    ann = ann.select(F.col("concept_id").alias("id_from"), vocabulary_prefix("vocabulary_id", OMOP_NAMES).alias("prefix_to"), F.col("concept_code").alias("id_to"), F.lit("exact").alias("rel_type"), F.lit("ohdsi").alias("prefix_from")).distinct()
    return concept_rows(own, "ohdsi"), _union(links, edge_rows(ann))


def canonical_relations(relations: DataFrame) -> DataFrame:
    """F-14: (relationship_id, canonical_id, forward): of each pair of a relation and its reverse the one listed first
    is kept. relations: relationship_id, reverse_relationship_id, place; a small table."""
    r = relations.select("relationship_id", "reverse_relationship_id", "place")
    back = r.select(F.col("relationship_id").alias("reverse_relationship_id"), F.col("place").alias("back_place"))
    both = r.join(back, "reverse_relationship_id", "left")
    forward = F.col("back_place").isNull() | (F.col("place") <= F.col("back_place"))
    return both.select("relationship_id", F.when(forward, F.col("relationship_id")).otherwise(F.col("reverse_relationship_id")).alias("canonical_id"), forward.alias("forward"))


def omop_links(rel: DataFrame, relations: DataFrame) -> DataFrame:
    """F-14: canonical direction, then our kinds; others are ohdsi_relationship with the relation as key. An unknown relation
    is an error."""
    known = F.broadcast(canonical_relations(relations.withColumn("place", F.monotonically_increasing_id())))
    rows = rel.join(known, "relationship_id", "left")
    unknown = F.raise_error(F.concat(F.lit("unknown relationship "), F.coalesce("relationship_id", F.lit("null"))))
    rows = rows.withColumn("canonical_id", F.coalesce("canonical_id", unknown.cast("string")))
    a, b = (F.when(F.col("forward"), F.col(x)).otherwise(F.col(y)) for x, y in (("concept_id_1", "concept_id_2"), ("concept_id_2", "concept_id_1")))
    rows = rows.select(a.alias("a"), b.alias("b"), F.col("canonical_id").alias("r"))
    kind = F.create_map(*[F.lit(x) for k, (v, _) in OMOP_RELATIONS.items() for x in (k, v)])
    along = F.create_map(*[F.lit(x) for k, (_, v) in OMOP_RELATIONS.items() for x in (k, v)])
    along = F.coalesce(F.try_element_at(along, F.col("r")), F.lit(True))
    mapped = F.try_element_at(kind, F.col("r"))
    rows = rows.select(F.when(along, F.col("a")).otherwise(F.col("b")).alias("id_from"), F.when(along, F.col("b")).otherwise(F.col("a")).alias("id_to"), F.coalesce(mapped, F.lit("ohdsi_relationship")).alias("rel_type"), F.when(mapped.isNull(), F.array("r")).alias("keys"))
    return edge_rows(rows.distinct(), "ohdsi", "ohdsi")


def _rf2(spark: SparkSession, path: str) -> DataFrame:
    return latest_rows(delimited(spark, path), "id", "effectiveTime")


def snomed(spark: SparkSession, folder: str) -> Loaded:
    """F-17 to F-20: one release. Descriptions of unknown concepts make a concept without status; definitions of unknown
    concepts are left to operators on orphan references."""
    read = lambda n: _rf2(spark, f"{folder}/{n}.txt")
    own = read("concept").select(F.col("id").alias("concept_id"), _status(F.col("active") == "0").alias("status"), (F.col("definitionStatusId") == FULLY_DEFINED).alias("fully_defined"))
    d = read("description").where("active = '1'")
    texts = d.groupBy(F.col("conceptId").alias("concept_id")).agg(
        F.max_by(F.when(F.col("typeId") == FULL_NAME, F.col("term")), F.when(F.col("typeId") == FULL_NAME, F.col("id").cast("decimal(38,0)"))).alias("label"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("typeId") != FULL_NAME, F.struct(F.col("id").cast("decimal(38,0)").alias("i"), "term")))), lambda x: x["term"]).alias("syn"),
    )
    f = read("definition").where("active = '1'").groupBy(F.col("conceptId").alias("concept_id")).agg(F.max_by("term", F.col("id").cast("decimal(38,0)")).alias("definition"))
    own = own.join(texts, "concept_id", "full").join(f, "concept_id", "left").withColumn("synonyms", F.when(F.size("syn") > 0, F.col("syn")))
    r = read("relationship").where("active = '1'")
    kind = F.when(F.col("typeId") == IS_A, "is_a").when(F.col("typeId") == REPLACED_BY, "replaced_by")
    return concept_rows(own, "snomed"), _link(r.where(kind.isNotNull()), "sourceId", "destinationId", kind, "snomed")


def snomed_releases(spark: SparkSession, folders: list[str]) -> Loaded:
    """F-21: later releases overwrite the fields they have; links add up."""
    loaded = [snomed(spark, f) for f in folders]
    ranked = _union(*[c.withColumn("_r", F.lit(i)) for i, (c, _) in enumerate(loaded)])
    fields = [c for c in ranked.columns if c not in ("prefix", "concept_id", "_r")]
    one = ranked.groupBy("prefix", "concept_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_r"))).alias(c) for c in fields])
    return concept_rows(one), _union(*[e for _, e in loaded]).dropDuplicates(["id_from", "id_to", "rel_type"])


def ctv3(spark: SparkSession, folder: str) -> Loaded:
    """F-22, F-23."""
    read = lambda n, cols: delimited(spark, f"{folder}/{n}", "|", cols)
    c = read("concept.v3", ["concept_id", "status"])
    d = read("description.v3", ["concept_id", "term_id", "type"]).withColumn("place", F.monotonically_increasing_id())
    t = read("term.v3", ["term_id", "term_status", "term_30", "term_60", "term_198"]).select("term_id", longest_term("term_198", "term_60", "term_30").alias("term"))
    folded = fold_labels(d.join(t, "term_id").select("concept_id", F.col("type").alias("kind"), "term", "place"))
    own = c.join(folded, "concept_id", "left").select("concept_id", ctv3_status("status").alias("status"), "label", F.when(F.size("synonyms") > 0, F.col("synonyms")).alias("synonyms"))
    up = read("hierarchy.v3", ["child_id", "parent_id"])
    old = read("redundancy.map", ["current_id", "old_id"])
    return concept_rows(own, "ctv3"), _union(_link(up, "child_id", "parent_id", "is_a", "ctv3"), _link(old, "old_id", "current_id", "replaced_by", "ctv3"))


def pathway_export(nodes: DataFrame, links: DataFrame, species: str) -> dict[str, DataFrame]:
    """F-26: the eight tables of a pathway graph for one species. nodes: st_id, display_name, kind, species, synonyms
    array, inferred; links: st_id_from, rel, st_id_to with rel has_sub_pathway, has_reaction, preceding, input, output,
    catalyst or maps_to."""
    own = nodes.where(F.col("species") == species)
    of = lambda k: own.where(F.col("kind") == k)

    def hop(rel: str, a: str, b: str, x: str, y: str) -> DataFrame:
        e = links.where(F.col("rel") == rel)
        e = e.join(of(a).select(F.col("st_id").alias("st_id_from")), "st_id_from", "left_semi").join(of(b).select(F.col("st_id").alias("st_id_to")), "st_id_to", "left_semi")
        return e.select(F.col("st_id_from").alias(x), F.col("st_id_to").alias(y)).distinct()

    genes = None
    for rel in ("input", "output", "catalyst"):
        part = hop(rel, "reaction", "gene", "reaction_id", "gene_id").select("gene_id", F.lit(rel).alias("relationship"), "reaction_id")
        genes = part if genes is None else genes.union(part)
    syn = F.to_json("synonyms").alias("synonyms")
    return {
        "pathway": of("pathway").select("st_id", "display_name").distinct(),
        "pathway_hierarchy": hop("has_sub_pathway", "pathway", "pathway", "parent_st_id", "sub_pathway_st_id"),
        "reaction": of("reaction").select("st_id", "display_name", syn, "inferred").distinct(),
        "reaction_order": hop("preceding", "reaction", "reaction", "reaction_id", "preceding_reaction_id"),
        "reaction_pathway": hop("has_reaction", "pathway", "reaction", "pathway_id", "reaction_id"),
        "gene": of("gene").select("st_id", "display_name", syn).distinct(),
        "gene_reaction": genes,
        "gene_mapping": links.where("rel = 'maps_to'").join(of("gene").select(F.col("st_id").alias("st_id_from")), "st_id_from", "left_semi").select(F.col("st_id_from").alias("gene_id"), F.col("st_id_to").alias("symbol")).distinct(),
    }
