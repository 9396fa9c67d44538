import re

from conftest import rows
from hypothesis import given
from hypothesis import strategies as st

from thesaurion.operators.packed import PLACEHOLDERS, listed, split_field, split_packed


def test_accessions():
    for text in ("P1A|Q2-3", "P1A, Q2-3", '"P1A,Q2-3"', '"P1A"|"Q2-3"', '["P1A", "Q2-3"]', "P1A||Q2-3|", "P1A\tQ2-3\n", " P1A / Q2-3"):
        assert split_field(text, "accession") == ["P1A", "Q2-3"], text
    for text in (None, "", "  ", "-", "NA", "null", "[]", "|"):
        assert split_field(text, "accession") == split_field(text, "text") == []
    assert split_field("P1|P1", "accession") == ["P1", "P1"]
    assert split_field("P1-A|Q2-3B--R4-", "accession") == ["P1", "A", "Q2-3", "B", "R4"]
    assert split_field('["P1", null, "Q2"]', "accession") == ["P1", "Q2"]


def test_texts():
    assert split_field(' ["a, b","c|d",null,"\\u03b1-x", 3, "e\\"f", ["g"], " "] ', "text") == ["a, b", "c|d", "α-x", 'e"f']
    assert split_field('a|"b|c"|d', "text") == ["a", "b|c", "d"]
    assert split_field('"x, ""y"", z", w', "text") == ['x, "y", z', "w"]
    assert split_field("a, b; c", "text") == ["a, b", "c"]
    assert split_field("a; b, c | d; e", "text") == ["a; b, c", "d; e"]
    assert split_field('"a|b";c|d', "text") == ["a|b;c", "d"]
    assert split_field('"a|b";c,d', "text") == ["a|b", "c,d"]
    assert split_field("x (A; B) | y, z", "text") == ["x (A; B)", "y, z"]
    assert split_field("a||b| ", "text") == ["a", "b"]
    assert split_field("one value", "text") == ["one value"]
    assert split_field("[not json|b]", "text") == ["[not json", "b]"]
    assert split_field('open "quote | stays', "text") == ["open quote | stays"]
    assert len(split_field("x|" * 200_000, "text")) == 200_000


@given(st.lists(st.text(st.characters(blacklist_categories=("Cs", "Cc", "Zs", "Zl", "Zp")), min_size=1, max_size=8), min_size=2, max_size=6), st.sampled_from("|;,"))
def test_round_trip(values, sep):
    packed = sep.join('"' + v.replace('"', '""') + '"' for v in values)
    if packed.strip().startswith("["):
        return
    assert split_field(packed, "text") == values


@given(st.text("aZ09-|;, \"[]é", max_size=30))
def test_words_are_the_longest_runs(text):
    if listed(text) is None and text.strip() not in PLACEHOLDERS:
        assert split_field(text, "accession") == re.findall("[A-Za-z0-9]+(?:-[0-9]+)?", text)


def test_table(spark):
    df = spark.createDataFrame([("r", "a|b", 1), ("r", "a|b", 2), (None, "c", 3), ("s", None, 4), ("t", "[]", 5)], "id string, f string, pos int")
    assert rows(split_packed(df, "id", "f", "text").where("rec_id is not null")) == [("r", 1, "a"), ("r", 2, "b")]
    assert split_packed(df, "id", "f", "text").count() == 3
    assert split_packed(df.limit(0), "id", "f", "text").count() == 0
