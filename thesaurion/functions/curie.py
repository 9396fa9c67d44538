"""Identifiers of the form prefix:local (F-08, X-07, X-08)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from thesaurion.schema import PREFIXES

# Address beginnings and the prefixes they stand for.
URLS = {
    "http://id.who.int/icd/entity/": "icd11.foundation",
    "http://identifiers.org/meddra/": "MedDRA",
    "http://identifiers.org/medgen/": "MEDGEN",
    "http://identifiers.org/mesh/": "MESH",
    "http://identifiers.org/snomedct/": "SCTID",
    "http://linkedlifedata.com/resource/umls/id/": "UMLS",
    "http://purl.bioontology.org/ontology/ICD10CM/": "ICD10CM",
    "http://purl.obolibrary.org/obo/DOID_": "DOID",
    "http://purl.obolibrary.org/obo/NCIT_": "NCIT",
    "http://www.ebi.ac.uk/efo/EFO_": "EFO",
    "http://www.orpha.net/ORDO/Orphanet_": "Orphanet",
    "https://icd.who.int/browse10/2019/en#/": "ICD10WHO",
    "https://omim.org/entry/": "OMIM",
    "https://omim.org/phenotypicSeries/PS": "OMIMPS",
}
# Vocabulary names of the sources and our prefixes.
MONDO_NAMES = {"HGNC": "hgnc", "HP": "hpo", "NCIT": "ncit", "OMIM": "omim", "Orphanet": "ordo", "SCTID": "snomed"}
OMOP_NAMES = {"NCIt": "ncit", "SNOMED": "snomed"}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _filled(x: Column) -> Column:
    return F.when(F.length(F.trim(x)) > 0, F.trim(x))


def curie(prefix: Column | str, raw: Column | str, fallback: Column | None = None, strict: bool = True) -> Column:
    """F-08, F-08b: prefix:local from a local id or an id that carries a prefix already.

    The declared prefix comes first, then the fallback, then the one embedded in the id. Embedded text before the first
    colon is a prefix if it is a known vocabulary or, under an unknown declared prefix, equals that; letter case does not
    matter. A conflict, an empty id or no prefix at all raises an error (strict) or gives null."""
    given = _filled(_c(prefix)) if fallback is None else F.coalesce(_filled(_c(prefix)), _filled(fallback))
    text = F.trim(_c(raw))
    head = F.lower(F.trim(F.substring_index(text, ":", 1)))
    has = F.instr(text, ":") > 0
    foreign = given.isNotNull() & ~F.lower(given).isin(*PREFIXES)
    embedded = F.when(has & F.when(foreign, head == F.lower(given)).otherwise(head.isin(*PREFIXES)), head)
    local = F.when(embedded.isNotNull(), F.regexp_replace(text, r"^[^:]*:", "")).otherwise(text)
    whole = F.coalesce(given, embedded)
    fine = whole.isNotNull() & (F.length(local) > 0) & (embedded.isNull() | (embedded == F.lower(whole)))
    bad = F.raise_error(F.concat(F.lit("no CURIE can be made of "), F.coalesce(text, F.lit("null")))).cast("string") if strict else F.lit(None).cast("string")
    return F.when(F.coalesce(fine, F.lit(False)), F.concat(whole, F.lit(":"), local)).otherwise(bad)


def curie_parts(c: Column | str) -> tuple[Column, Column]:
    """(prefix, local id) at the first colon."""
    return F.substring_index(_c(c), ":", 1), F.regexp_replace(_c(c), r"^[^:]*:", "")


def url_curie(url: Column | str) -> Column:
    """X-07: percent-decoded address to prefix:local by the longest known beginning; null if none fits or nothing follows."""
    plain = F.try_url_decode(F.trim(_c(url)))
    out = F.lit(None).cast("string")
    for begin in sorted(URLS, key=len):
        rest = F.substring(plain, len(begin) + 1, 1_000_000)
        out = F.when(plain.startswith(begin) & (F.length(rest) > 0), F.concat(F.lit(URLS[begin] + ":"), rest)).otherwise(out)
    return out


def vocabulary_prefix(name: Column | str, names: dict[str, str] = MONDO_NAMES) -> Column:
    """X-08: our prefix of a source's vocabulary name, else the name in lower case."""
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(known, _c(name)), F.lower(_c(name)))
