"""Reading delimited, XML and archived files with fixed schemas; ids stay strings."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator
from fnmatch import fnmatch

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def delimited(spark: SparkSession, path: str, sep: str = "\t", columns: list[str] | None = None, comment: str | None = None, quote: str = "") -> DataFrame:
    """All columns as strings; with columns the file has no header and these are their names in order."""
    reader = spark.read.option("sep", sep).option("quote", quote).option("mode", "PERMISSIVE")
    if comment:
        reader = reader.option("comment", comment)
    if columns:
        return reader.schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    return reader.option("header", True).option("inferSchema", False).csv(path)


def csv(spark: SparkSession, path: str, line_ends: bool = False) -> DataFrame:
    """Comma-separated with header, quotes doubled inside quotes; all strings. With line_ends values may hold line ends;
    such files cannot be split among tasks."""
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", line_ends).csv(path)


_LINKED = "array<struct<`_rdf:resource`:string,`_VALUE`:string>>"
_OWL = f"""`_rdf:about` string, `rdfs:label` {_LINKED}, `obo:IAO_0000115` {_LINKED}, `efo:definition` {_LINKED}, `rdfs:comment` {_LINKED},
 `owl:deprecated` {_LINKED}, `oboInOwl:hasAlternativeId` {_LINKED}, `oboInOwl:consider` {_LINKED}, `oboInOwl:hasExactSynonym` {_LINKED},
 `efo:alternative_term` {_LINKED}, `oboInOwl:hasDbXref` {_LINKED}, `skos:exactMatch` {_LINKED}, `skos:broadMatch` {_LINKED},
 `skos:narrowMatch` {_LINKED}, `skos:relatedMatch` {_LINKED},
 `rdfs:subClassOf` array<struct<`_rdf:resource`:string,`owl:Restriction`:struct<`owl:onProperty`:struct<`_rdf:resource`:string>,`owl:someValuesFrom`:struct<`_rdf:resource`:string>>>>"""


def owl_classes(spark: SparkSession, path: str) -> DataFrame:
    """One row per class of an RDF/XML ontology: name, texts as arrays, parents, and restrictions (property, value).
    A name is what stands after the last / or # of an address."""
    raw = spark.read.option("rowTag", "owl:Class").schema(_OWL.replace("\n", " ")).xml(path)
    name = lambda c: F.regexp_extract(c, r"([^/#]*)$", 1)

    def texts(field: str):
        return F.filter(F.transform(F.coalesce(F.col(f"`{field}`"), F.array()), lambda x: F.coalesce(F.trim(x["_VALUE"]), x["_rdf:resource"])), lambda x: x.isNotNull() & (x != ""))

    sub = F.coalesce(F.col("`rdfs:subClassOf`"), F.array())
    return raw.where("`_rdf:about` is not null").select(
        name(F.col("`_rdf:about`")).alias("name"),
        *[texts(f).alias(a) for f, a in (
            ("rdfs:label", "labels"), ("obo:IAO_0000115", "definitions"), ("efo:definition", "efo_definitions"), ("rdfs:comment", "comments"), ("owl:deprecated", "deprecated"),
            ("oboInOwl:hasAlternativeId", "alternative_ids"), ("oboInOwl:consider", "consider"), ("oboInOwl:hasExactSynonym", "exact_synonyms"), ("efo:alternative_term", "alternative_terms"),
            ("oboInOwl:hasDbXref", "xrefs"), ("skos:exactMatch", "exact"), ("skos:broadMatch", "broad"), ("skos:narrowMatch", "narrow"), ("skos:relatedMatch", "related"))],
        F.transform(F.filter(sub, lambda x: x["_rdf:resource"].isNotNull()), lambda x: name(x["_rdf:resource"])).alias("parents"),
        F.transform(F.filter(sub, lambda x: x["owl:Restriction"].isNotNull()), lambda x: F.struct(name(x["owl:Restriction"]["owl:onProperty"]["_rdf:resource"]).alias("property"), name(x["owl:Restriction"]["owl:someValuesFrom"]["_rdf:resource"]).alias("value"))).alias("restrictions"),
    )


def archive_lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """F-24: (archive, member, line_no, line) of the first member of each zip or tar archive whose name fits the pattern.
    One task per archive reads its member as a stream; gzip files need no help, Spark's readers open them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                source = io.BytesIO(content)
                if zipfile.is_zipfile(source):
                    box = zipfile.ZipFile(source)
                    member = next((m for m in sorted(box.namelist()) if fnmatch(m, pattern)), None)
                    stream = box.open(member) if member else None
                else:
                    source.seek(0)
                    tar = tarfile.open(fileobj=source)
                    found = next((m for m in tar.getmembers() if m.isfile() and fnmatch(m.name, pattern)), None)
                    member, stream = (found.name, tar.extractfile(found)) if found else (None, None)
                if stream is None:
                    continue
                rows = []
                for i, line in enumerate(io.TextIOWrapper(stream, "utf-8")):
                    rows.append((name, member, i, line.rstrip("\r\n")))
                    if len(rows) == 50_000:
                        yield pd.DataFrame(rows, columns=["archive", "member", "line_no", "line"])
                        rows = []
                yield pd.DataFrame(rows, columns=["archive", "member", "line_no", "line"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, member string, line_no long, line string")
