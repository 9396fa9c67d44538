"""Loaders, annotation files and interchange files on tiny inputs."""

import gzip
import io
import json
import tarfile
import uuid
import zipfile

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from thesaurion.operators import documents as docs
from thesaurion.operators import lookup
from thesaurion.schema import concepts as canonical
from thesaurion.schema import duplicates, outside
from thesaurion.sources import annotations as ann
from thesaurion.sources import dumps, readers
from thesaurion.sources import vocabularies as voc


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def links(df, *cols):
    return rows(df.select(*(cols or ("id_from", "rel_type", "id_to"))))


def by_id(df):
    return {r["concept_id"]: r for r in df.collect()}


OWL = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#"
 xmlns:obo="http://purl.obolibrary.org/obo/" xmlns:oboInOwl="http://www.geneontology.org/formats/oboInOwl#" xmlns:skos="http://www.w3.org/2004/02/skos/core#" xmlns:efo="http://www.ebi.ac.uk/efo/">
%s
</rdf:RDF>"""


def test_hpo(spark, tmp_path):
    path = put(tmp_path / "hp.owl", OWL % """<owl:Class rdf:about="http://purl.obolibrary.org/obo/HP_0000002"><rdfs:label>Tall</rdfs:label><obo:IAO_0000115>Being tall</obo:IAO_0000115>
 <rdfs:comment>c</rdfs:comment><rdfs:subClassOf rdf:resource="http://purl.obolibrary.org/obo/HP_0000001"/><oboInOwl:hasAlternativeId>HP:0000009</oboInOwl:hasAlternativeId></owl:Class>
 <owl:Class rdf:about="http://purl.obolibrary.org/obo/HP_0000003"><rdfs:label xml:lang="en">Old</rdfs:label><owl:deprecated rdf:datatype="http://www.w3.org/2001/XMLSchema#boolean">true</owl:deprecated>
 <oboInOwl:consider>HP:0000002</oboInOwl:consider></owl:Class><owl:Class rdf:about="http://x/UBERON_1"><rdfs:label>no</rdfs:label></owl:Class>""")
    c, e = voc.hpo(spark, path)
    got = by_id(c)
    assert set(got) == {"0000002", "0000003"} and got["0000002"]["definition"] == "Being tall" and got["0000002"]["synonyms"] == []
    assert (got["0000002"]["status"], got["0000003"]["status"], got["0000003"]["label"]) == ("active", "deprecated", "Old")
    assert links(e) == [("0000002", "is_a", "0000001"), ("0000003", "consider", "0000002"), ("0000009", "replaced_by", "0000002")]


def test_mondo_and_ordo(spark, tmp_path):
    path = put(tmp_path / "mondo.owl", OWL % """<owl:Class rdf:about="http://purl.obolibrary.org/obo/MONDO_0000004"><rdfs:label>D</rdfs:label><oboInOwl:hasExactSynonym>dd</oboInOwl:hasExactSynonym>
 <rdfs:subClassOf rdf:resource="http://purl.obolibrary.org/obo/MONDO_0000001"/><skos:exactMatch rdf:resource="https://omim.org/entry/600001"/><skos:broadMatch rdf:resource="http://unknown/1"/>
 <oboInOwl:hasDbXref>OMIM:600001</oboInOwl:hasDbXref><oboInOwl:hasDbXref>Orphanet:77</oboInOwl:hasDbXref></owl:Class>""")
    c, e = voc.mondo(spark, path)
    assert by_id(c)["0000004"]["synonyms"] == ["dd"]
    assert links(e, "prefix_to", "rel_type", "id_to") == [("mondo", "is_a", "0000001"), ("omim", "exact", "600001"), ("ordo", "annotated_with", "77")]
    path = put(tmp_path / "ordo.owl", OWL % """<owl:Class rdf:about="http://www.orpha.net/ORDO/Orphanet_10"><rdfs:label>A</rdfs:label><efo:alternative_term>AA</efo:alternative_term>
 <rdfs:subClassOf rdf:resource="http://www.orpha.net/ORDO/Orphanet_1"/><rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="http://www.orpha.net/ORDO/Orphanet_C056"/>
 <owl:someValuesFrom rdf:resource="http://www.orpha.net/ORDO/Orphanet_11"/></owl:Restriction></rdfs:subClassOf><rdfs:subClassOf><owl:Restriction>
 <owl:onProperty rdf:resource="http://purl.obolibrary.org/obo/BFO_0000050"/><owl:someValuesFrom rdf:resource="http://www.orpha.net/ORDO/Orphanet_12"/></owl:Restriction></rdfs:subClassOf></owl:Class>""")
    c, e = voc.ordo(spark, path)
    assert by_id(c)["10"]["status"] == "deprecated"
    assert links(e) == [("10", "is_a", "1"), ("10", "part_of", "12"), ("10", "replaced_by", "11")]


def test_tabular_vocabularies(spark, tmp_path):
    c, e = voc.ncit(spark, put(tmp_path / "n.txt", "C1\tiri\tC0|C9\tName|Other\tdef\tdn\t\tst\ty\nC2\tiri\t\tOld\t\t\tObsolete_Concept\t\t\n"))
    assert (by_id(c)["C1"]["label"], by_id(c)["C1"]["synonyms"], by_id(c)["C2"]["status"]) == ("Name", ["Other"], "deprecated")
    assert links(e) == [("C1", "is_a", "C0"), ("C1", "is_a", "C9")]
    text = 'Class ID,Preferred Label,Synonyms,Obsolete,Parents,Moved from,Gene Symbol\nhttp://x/1,"A, B",s|t,false,http://x/0,http://x/5,G1|G2\nhttp://x/2,C,,true,,,\n'
    path = put(tmp_path / "omim.csv", text)
    c, e = voc.omim(spark, path)
    assert by_id(c)["1"]["label"] == "A, B" and by_id(c)["2"]["status"] == "deprecated"
    assert links(e) == [("1", "is_a", "0"), ("5", "replaced_by", "1")]
    assert links(ann.omim_gene(spark, path)) == [("1", "annotated_with", "G1"), ("1", "annotated_with", "G2")]
    s = put(tmp_path / "s.txt", "hgnc_id\tsymbol\tname\tstatus\talias_symbol\talias_name\tlocation\tlocation_sortable\tuniprot_ids\nHGNC:5\tA1\tn\tApproved\tX|Y\tZ\t1p\t\tP1|P2\nHGNC:6\tB1\tn\tEntry Withdrawn\t\t\t\t\t\n")
    w = put(tmp_path / "w.txt", "HGNC_ID\tSTATUS\tWITHDRAWN_SYMBOL\tMERGED_INTO_REPORT(S) (i.e HGNC_ID|SYMBOL|STATUS)\nHGNC:9\tMerged\tY\tHGNC:5|A1|Approved, HGNC:7|C|Approved\n")
    c, e = voc.hgnc(spark, s, w)
    assert by_id(c)["5"]["synonyms"] == ["X", "Y", "Z"] and by_id(c)["5"]["location"] == "1p" and by_id(c)["9"]["status"] == "deprecated"
    assert links(e) == [("5", "alias_symbol", "X"), ("5", "alias_symbol", "Y"), ("5", "has_symbol", "A1"), ("9", "previous_symbol", "Y"), ("9", "replaced_by", "5"), ("9", "replaced_by", "7")]
    assert rows(voc.gene_symbols(spark, s, w)[0].select("concept_id", "status")) == [("A1", "active"), ("X", "active"), ("Y", "deprecated")]


def test_ensembl(spark, tmp_path):
    line = lambda f, a: "\t".join(["1", "s", f, "10", "20", ".", "+", ".", a]) + "\n"
    c, e = voc.ensembl(spark, put(tmp_path / "g.gtf", "#!x\n" + line("gene", 'gene_id "G1"; gene_name "AB"; gene_biotype "pc";') + line("gene", 'gene_id "G1"; gene_name "ZZ";') + line("transcript", 'gene_id "G1"; transcript_id "T1";') + line("exon", 'transcript_id "T1"; exon_id "E1";') + line("CDS", 'transcript_id "T1"; protein_id "P1";')))
    got = by_id(c)
    assert (got["G1"]["label"], got["G1"]["bio_type"], got["G1"]["start"], got["P1"]["concept_types"]) == ("AB", "pc", 10, ["protein"])
    assert ("T1", "part_of", "G1") in links(e) and ("E1", "part_of", "T1") in links(e) and ("P1", "part_of", "T1") in links(e)


def test_reactome(spark, tmp_path):
    d = tmp_path / "r"
    for name, text in {
        "pathway": "st_id,display_name\nP1,Path\n", "pathway_hierarchy": "parent_st_id,sub_pathway_st_id\nP1,P2\n",
        "reaction": 'st_id,display_name,synonyms,inferred\nR1,React,"[""React"",""other""]",True\n', "reaction_order": "reaction_id,preceding_reaction_id\nR1,R0\n",
        "reaction_pathway": "pathway_id,reaction_id\nP1,R1\n", "gene": "st_id,display_name,synonyms\nG1,Gene,\n", "gene_reaction": "gene_id,relationship,reaction_id\nG1,input,R1\nG2,output,R1\n", "gene_mapping": "gene_id,symbol\nG1,Q1\nG2,none\n",
    }.items():
        put(d / f"{name}.csv", text)
    s = put(tmp_path / "s.txt", "symbol\tuniprot_ids\nAB\tQ1|Q2\nCD\tQ1\n")
    c, e = voc.reactome(spark, str(d), s)
    assert by_id(c)["R1"]["synonyms"] == ["other"] and by_id(c)["R1"]["inferred"] and by_id(c)["G1"]["synonyms"] is None
    assert links(e) == [("G1", "has_symbol", "AB"), ("P2", "part_of", "P1"), ("R1", "has_input", "G1"), ("R1", "has_output", "G2"), ("R1", "part_of", "P1"), ("R1", "preceded_by", "R0")]


def test_ohdsi(spark, tmp_path):
    d = tmp_path / "o"
    put(d / "CONCEPT.csv", "concept_id\tconcept_name\tvocabulary_id\tconcept_code\tvalid_end_date\n1\tDrug\tSNOMED\t11\t20991231\n2\tOld\tRxNorm\t22\t20000101\n3\tmg\tVocabulary\tx\t20991231\n4\tSelf\tNCIt\t4\t20991231\n")
    put(d / "CONCEPT_SYNONYM.csv", "concept_id\tconcept_synonym_name\n1\tb\n1\ta\n9\tz\n")
    put(d / "CONCEPT_RELATIONSHIP.csv", "concept_id_1\tconcept_id_2\trelationship_id\tvalid_end_date\n1\t2\tSubsumes\t20991231\n2\t1\tIs a\t20991231\n1\t2\tOdd\t20991231\n2\t1\tOdd inv\t20991231\n1\t2\tIs a\t20000101\n1\t1\tIs a\t20991231\n1\t2\tConcept replaces\t20991231\n")
    put(d / "RELATIONSHIP.csv", "relationship_id\treverse_relationship_id\nIs a\tSubsumes\nSubsumes\tIs a\nOdd\tOdd inv\nOdd inv\tOdd\nConcept replaces\tConcept replaced by\nConcept replaced by\tConcept replaces\n")
    put(d / "CONCEPT_ANCESTOR.csv", "ancestor_concept_id\tdescendant_concept_id\tmin_levels_of_separation\n8\t9\t1\n8\t7\t2\n")
    put(d / "DRUG_STRENGTH.csv", "drug_concept_id\tingredient_concept_id\tamount_value\tamount_unit_concept_id\tnumerator_value\tnumerator_unit_concept_id\tdenominator_value\tdenominator_unit_concept_id\n1\t5\t2.5\t3\t\t\t\t\n")
    c, e = voc.ohdsi(spark, str(d), 20240101)
    got = by_id(c)
    assert got["1"]["synonyms"] == ["a", "b"] and got["2"]["status"] == "deprecated" and "9" not in got
    assert (got["1"]["drug_strengths"][0]["amount_value"], got["1"]["drug_strengths"][0]["amount_unit"]) == (2.5, "mg")
    inner = links(e.where("prefix_to = 'ohdsi'"))
    assert inner == [("1", "ohdsi_relationship", "2"), ("2", "is_a", "1"), ("2", "replaced_by", "1"), ("9", "is_a", "8")]
    assert links(e.where("prefix_to <> 'ohdsi'"), "id_from", "prefix_to", "id_to") == [("1", "snomed", "11"), ("2", "rxnorm", "22")]


def _rf2(d, latest=1):
    put(d / "concept.txt", f"id\teffectiveTime\tactive\tdefinitionStatusId\n1\t20200101\t1\t{voc.FULLY_DEFINED}\n1\t20190101\t0\t0\n2\t20200101\t0\t0\n")
    put(d / "description.txt", f"id\teffectiveTime\tactive\tconceptId\ttypeId\tterm\n10\t20200101\t1\t1\t{voc.FULL_NAME}\tName{latest}\n11\t20200101\t1\t1\t5\tsyn\n12\t20200101\t0\t1\t5\tgone\n13\t20200101\t1\t3\t{voc.FULL_NAME}\tstub\n")
    put(d / "definition.txt", "id\teffectiveTime\tactive\tconceptId\tterm\n20\t20200101\t1\t1\tdef\n")
    put(d / "relationship.txt", f"id\teffectiveTime\tactive\tsourceId\tdestinationId\ttypeId\n30\t20200101\t1\t1\t2\t{voc.IS_A}\n31\t20200101\t0\t2\t1\t{voc.IS_A}\n32\t20200101\t1\t2\t1\t777\n")
    return str(d)


def test_snomed(spark, tmp_path):
    a, b = _rf2(tmp_path / "a", 1), _rf2(tmp_path / "b", 2)
    c, e = voc.snomed_releases(spark, [a, b])
    got = by_id(c)
    assert (got["1"]["label"], got["1"]["synonyms"], got["1"]["definition"], got["1"]["status"], got["1"]["fully_defined"]) == ("Name2", ["syn"], "def", "active", True)
    assert got["2"]["status"] == "deprecated" and got["3"]["status"] is None
    assert links(e) == [("1", "is_a", "2")]
    m = put(tmp_path / "m.txt", "id\teffectiveTime\tactive\treferencedComponentId\tmapTarget\n1\t20200101\t0\t5\tX\n1\t20190101\t1\t5\tX\n2\t20190101\t1\t6\tY\n")
    assert links(ann.snomed_ordo(spark, m)) == [("6", "annotated_with", "Y")]
    assert len(links(ann.snomed_ctv3(spark, m))) == 2


def test_ctv3(spark, tmp_path):
    d = tmp_path / "c"
    put(d / "concept.v3", "X1|C\nX2|R\n")
    put(d / "description.v3", "X1|T1|S\nX1|T2|P\n")
    put(d / "term.v3", "T1|C|short||\nT2|C|p30|p60|\n")
    put(d / "hierarchy.v3", "X1|X0\n")
    put(d / "redundancy.map", "X1|X9\n")
    c, e = voc.ctv3(spark, str(d))
    got = by_id(c)
    assert (got["X1"]["label"], got["X1"]["synonyms"], got["X1"]["status"], got["X2"]["label"], got["X2"]["status"]) == ("p60", ["short"], "active", None, "deprecated")
    assert links(e) == [("X1", "is_a", "X0"), ("X9", "replaced_by", "X1")]


def test_other_annotations(spark, tmp_path):
    p = put(tmp_path / "g.txt", "gene_symbol\thpo_id\tfrequency\nAB\tHP:0001\tHP:0040283\n-\tHP:0002\t-\nCD\tHP:0003\t-\n")
    assert rows(ann.gene_hpo(spark, p).select("id_from", "id_to", F.col("props")["frequency"])) == [("AB", "0001", "OC"), ("CD", "0003", "UN")]
    assert links(ann.ncit_gene(spark, put(tmp_path / "n.txt", "C1\tHGNC:5\n"))) == [("C1", "annotated_with", "5")]
    x = put(tmp_path / "o.xml", "<R><DisorderList><Disorder id='1'><OrphaCode>77</OrphaCode><DisorderGeneAssociationList count='2'><DisorderGeneAssociation><Gene><Symbol>A</Symbol></Gene></DisorderGeneAssociation><DisorderGeneAssociation><Gene><Symbol>B</Symbol></Gene></DisorderGeneAssociation></DisorderGeneAssociationList></Disorder></DisorderList></R>")
    assert links(ann.ordo_gene(spark, x)) == [("77", "annotated_with", "A"), ("77", "annotated_with", "B")]
    j = {"JDBOR": [{"DisorderList": [{"Disorder": [{"OrphaCode": "5", "ExternalReferenceList": [{"count": "2", "ExternalReference": [{"Source": "OMIM", "Reference": "600"}, {"Source": "X", "Reference": "1"}]}]}, {"OrphaCode": "6", "ExternalReferenceList": [{"count": "0"}]}]}]}]}
    assert links(ann.ordo_omim(spark, put(tmp_path / "a.json", json.dumps(j)))) == [("5", "annotated_with", "600")]
    names = spark.createDataFrame([("Orpha:5_HP:0001_Freq:VF",), ("Other",)], "name string")
    assert rows(ann.ordo_hpo(names).select("id_from", "id_to", F.col("props")["frequency"])) == [("5", "0001", "VF")]
    assert ann.loader("hpo", "gene") is ann.gene_hpo and ann.loader("ohdsi", "ncit") is ann.view
    with pytest.raises(KeyError):
        ann.loader("ctv3", "gene")


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/other.txt", "no")
        z.writestr("d/terms_1.txt", "one\ntwo\n")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("x/terms_2.txt")
        info.size = 6
        t.addfile(info, io.BytesIO(b"three\n"))
    out = readers.archive_lines(spark, str(tmp_path), "*terms*.txt")
    assert rows(out.select("member", "line_no", "line")) == [("d/terms_1.txt", 0, "one"), ("d/terms_1.txt", 1, "two"), ("x/terms_2.txt", 0, "three")]
    with gzip.open(tmp_path / "c.tsv.gz", "wt") as f:
        f.write("a\tb\n1\t\n")
    assert rows(readers.delimited(spark, str(tmp_path / "c.tsv.gz"))) == [("1", None)]


def test_dumps_round_trip(spark, tmp_path):
    c = canonical(spark.createDataFrame([("1", "One", ["uno"], ["pathway"]), ("2", None, None, None)], "concept_id string, label string, synonyms array<string>, concept_types array<string>"), "hpo")
    dumps.write_documents(c, f"{tmp_path}/hpo.doc.dump")
    assert rows(dumps.read_documents(spark, f"{tmp_path}/hpo.doc.dump", "hpo").select("concept_id", "label")) == [("1", "One"), ("2", None)]
    with pytest.raises(Exception, match="not of mondo"):
        dumps.read_documents(spark, f"{tmp_path}/hpo.doc.dump", "mondo").collect()
    e = dumps.edge_rows(spark.createDataFrame([("1", "2", "is_a", ["k", "m"]), ("2", "1", "", None)], "id_from string, id_to string, rel_type string, keys array<string>"), "hpo", "hpo")
    dumps.write_graph(e, c, f"{tmp_path}/hpo")
    assert rows(dumps.read_graph(spark, f"{tmp_path}/hpo", "hpo").select("id_from", "id_to", "rel_type", F.to_json(F.struct("keys")))) == [("1", "2", "is_a", '{"keys":["k","m"]}'), ("2", "1", "related_to", "{}")]
    a = dumps.edge_rows(spark.createDataFrame([("HPO:1", "7", "exact", {"q": 'a,"b'}), ("2", "mondo:8", "exact", None)], "id_from string, id_to string, rel_type string, props map<string,string>"), "hpo", "mondo")
    dumps.write_annotations(a, f"{tmp_path}/hpo-mondo.annotation.dump")
    back = dumps.read_annotations(spark, f"{tmp_path}/hpo-mondo.annotation.dump", "mondo", "hpo")
    assert rows(back.select("prefix_from", "id_from", "id_to", F.col("props")["q"]).where("id_from = '1'")) == [("hpo", "1", "7", 'a,"b')] and back.count() == 2
    s = spark.createDataFrame([("1", "2", 0.5), ("1", "3", 0.1)], "id_from string, id_to string, score double")
    path = dumps.write_similarities(s, str(tmp_path), "hpo", "weighed-relevance", "ordo")
    assert rows(dumps.read_similarities(spark, path)) == [("hpo", "1", "hpo", "2", "weighed-relevance:ordo", 0.5)]


def test_container(spark, tmp_path):
    vecs = [(f"c{i}", str(uuid.uuid4()), np.arange(4, dtype=np.float32) + i) for i in range(5)]
    data = dumps.encode_container(vecs, 4)
    got = list(dumps.decode_container(data))
    assert [(a, b, c.tolist()) for a, b, c in got] == [(a, b, c.tolist()) for a, b, c in vecs]
    for broken, error in ((b"XXXX" + data[4:], ValueError), (data[:-3], EOFError), (b"EM", EOFError)):
        with pytest.raises(error):
            list(dumps.decode_container(broken))
    (tmp_path / "hpo.embed.dump").write_bytes(data)
    assert dumps.read_embeddings(spark, f"{tmp_path}/hpo.embed.dump", "hpo").count() == 5
    df = spark.createDataFrame([(a, b, c.tolist()) for a, b, c in vecs], "concept_id string, vector_id string, vector array<float>")
    dumps.write_embeddings(df, f"{tmp_path}/table", 4)
    assert rows(dumps.read_embeddings(spark, f"{tmp_path}/table", "hpo", files=False).select("concept_id", "vector")) == rows(df.select("concept_id", "vector"))


def test_documents_and_lookup(spark):
    c = canonical(spark.createDataFrame([("1", "One", "active"), ("2", "Two", "deprecated")], "concept_id string, label string, status string"), "hpo")
    new = spark.createDataFrame([("hpo", "2", "Zwei"), ("hpo", "3", "Drei")], "prefix string, concept_id string, label string")
    assert rows(docs.upsert(c, new, ["prefix", "concept_id"]).select("concept_id", "label", F.coalesce("status", F.lit("-")))) == [("1", "One", "active"), ("2", "Zwei", "deprecated"), ("3", "Drei", "-")]
    assert duplicates(c.union(c), ["concept_id"]).count() == 2 and outside(c, "status", ("active",)).count() == 1
    t = spark.createDataFrame([(1, 20200101, 1), (1, 20230101, 0), (2, 20210101, 1)], "id int, effectiveTime int, active int")
    assert rows(docs.latest_rows(t, "id", "effectiveTime")) == [(1, 20230101, 0), (2, 20210101, 1)]
    url = "http://x/"
    codes = spark.createDataFrame([("http://x/hpo", "1"), ("http://x/hpo", "9"), ("urn:y", "1")], "system string, code string")
    assert rows(lookup.validate(c, codes, url).select("system", "code", "result")) == [("http://x/hpo", "1", True), ("http://x/hpo", "9", False), ("urn:y", "1", False)]
    found = lookup.lookup(c, codes, url, ("display", "inactive")).where("ok").first()["parameters"]
    assert [(p["name"], p["value"]) for p in found] == [("inactive", "false"), ("display", "One")]
    asked = spark.createDataFrame([(1, "hpo", "9"), (2, "hpo", "1")], "pos int, prefix string, concept_id string")
    assert rows(lookup.with_unknown(asked, c).select("pos", "status")) == [(1, "unknown"), (2, "active")]


def test_pathway_export(spark):
    n = spark.createDataFrame([("P", "p", "pathway", "h", None, False), ("R", "r", "reaction", "h", ["x"], True), ("G", "g", "gene", "h", None, False), ("M", "m", "gene", "mouse", None, False)], "st_id string, display_name string, kind string, species string, synonyms array<string>, inferred boolean")
    e = spark.createDataFrame([("P", "has_reaction", "R"), ("R", "input", "G"), ("R", "input", "M"), ("G", "maps_to", "S")], "st_id_from string, rel string, st_id_to string")
    out = voc.pathway_export(n, e, "h")
    assert rows(out["gene_reaction"]) == [("G", "input", "R")] and rows(out["reaction"]) == [("R", "r", '["x"]', True)] and rows(out["gene_mapping"]) == [("G", "S")]
