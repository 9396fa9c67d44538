"""Text and identifier functions on small fixed cases."""

import pytest
from pyspark.sql import functions as F

from thesaurion.functions import curie as cu
from thesaurion.functions import text as tx


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(expr).first()[0]


@pytest.fixture()
def concept(spark):
    return dict(spark=spark, i="0000001", l="Test Concept", s=["Synonym One", "Synonym Two"])


def test_ngrams(concept):
    spark = concept.pop("spark")
    got = set(one(spark, tx.ngrams("i", "l", "s", 3, 5), **concept))
    assert {"tes", "test", "oncep", "syn", "onym", "one", "two", "000", "00001"} <= got and "concept" not in got
    assert set(one(spark, tx.ngrams("i", F.lit(None).cast("string"), F.lit(None).cast("array<string>"), 3, 5), i="0000001")) >= {"000", "00001"}
    assert one(spark, tx.ngrams("i", "l", "s", 9, 15), i="0000001", l="Short", s=["x"]) == []
    assert len(one(spark, tx.ngrams("i", "l", "s"), i="1", l="a" * 30, s=["b"])) == 18


def test_search_and_canonical_text(concept):
    spark = concept.pop("spark")
    text = one(spark, tx.search_text("i", "l", "s"), **concept)
    assert text == "0000001 TestConcept SynonymOne SynonymTwo"
    assert one(spark, tx.search_text("i", F.lit(None).cast("string"), F.lit(None).cast("array<string>")), i="7") == "7"
    assert one(spark, tx.canonical_text("l", F.lit(None).cast("string"), "s"), l="L", s=["a", "b"]) == "L:  (a b)"
    assert one(spark, tx.canonical_text("l", "d", F.lit(None).cast("array<string>")), l="L", d="def") == "L: def"


def test_query_parts(spark):
    assert one(spark, tx.query_words("q"), q='The "big" (of) it') == ["the", "big"]
    assert one(spark, tx.query_needle("q"), q='The "big" one') == "thebigone"
    assert one(spark, tx.position_score("t", "n"), t="abc def", n="def") == 4
    assert one(spark, tx.position_score("t", "n"), t="abc", n="x") == 10**9
    assert one(spark, tx.label_length(F.lit(None).cast("string"))) == 999


def test_small_functions(spark):
    assert one(spark, tx.last_part("u", "/"), u="http://x/y/600001") == "600001"
    assert one(spark, tx.attributes("a"), a='gene_id "G1"; tag "x"; tag "y";') == {"gene_id": "G1", "tag": "y"}
    assert one(spark, tx.longest_term("a", "b", "c"), a="", b="mid", c="short") == "mid"
    assert [one(spark, tx.ctv3_status("c"), c=x) for x in "COR"] == ["active", "active", "deprecated"]
    assert one(spark, tx.json_synonyms("j", "l"), j='["a","b","a"]', l="a") == ["b", "a"]
    assert one(spark, tx.json_synonyms("j", "l"), j='["a"]', l="a") is None
    assert one(spark, tx.safe_identifier("n"), n="My Index-1") == "my_index_1"
    with pytest.raises(Exception, match="identifier"):
        one(spark, tx.safe_identifier("n"), n=" ")


CURIES = [("hgnc", "5", "hgnc:5"), ("hgnc", "HGNC:5", "hgnc:5"), ("gene", "Em:AC068896.4", "gene:Em:AC068896.4"), ("cgi", "ABL1:F317L", "cgi:ABL1:F317L"), ("cgi", "hpo:123", "cgi:hpo:123"), ("cgi", "CGI:7", "cgi:7")]


def test_curies(spark):
    for p, i, want in CURIES:
        assert one(spark, cu.curie("p", "i"), p=p, i=i) == want
    for p, i in (("hgnc", "ensembl:5"), ("", "5"), ("hgnc", ""), ("hgnc", "hgnc:")):
        assert one(spark, cu.curie("p", "i", strict=False), p=p, i=i) is None
        with pytest.raises(Exception, match="CURIE"):
            one(spark, cu.curie("p", "i"), p=p, i=i)
    assert one(spark, cu.curie("p", "i", F.lit("hpo")), p="", i="12") == "hpo:12"
    assert one(spark, cu.curie("p", "i", F.lit(None).cast("string")), p="", i="Mondo:1") == "mondo:1"


def test_addresses(spark):
    assert one(spark, cu.url_curie("u"), u="http://identifiers.org/snomedct/123") == "SCTID:123"
    assert one(spark, cu.url_curie("u"), u="https://omim.org/phenotypicSeries/PS%20123") == "OMIMPS: 123"
    assert one(spark, cu.url_curie("u"), u="https://omim.org/entry/") is None
    assert one(spark, cu.url_curie("u"), u="http://other/1") is None
    assert [one(spark, cu.vocabulary_prefix("v"), v=x) for x in ("Orphanet", "MESH")] == ["ordo", "mesh"]
