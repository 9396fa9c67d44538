"""Text functions as column expressions (X-01 to X-06, X-09 to X-13, X-19 to X-21)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARKS = r"[()\"'\s]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _list(x: Column | str) -> Column:
    return F.coalesce(_c(x), F.array().cast("array<string>"))


def tokens(text: Column | str, longer_than: int = 2) -> Column:
    """Lower-case words without brackets and quotes, longer than the given length."""
    parts = F.split(F.regexp_replace(F.lower(_c(text)), _MARKS, " "), " +")
    return F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda w: F.length(w) > longer_than)


def ngrams(concept_id: Column | str, label: Column | str, synonyms: Column | str, least: int = 3, most: int = 20) -> Column:
    """X-01: distinct substrings of least..most characters of the lower-case id and of all words of label and synonyms."""
    words = F.flatten(F.array(F.array(F.lower(_c(concept_id))), tokens(_c(label)), F.flatten(F.transform(_list(synonyms), lambda s: tokens(s)))))
    words = F.array_distinct(F.filter(words, lambda w: F.length(w) >= least))

    def of_length(w: Column, n: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda at: F.substring(w, at, n))

    def all_of(w: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(least), F.least(F.length(w), F.lit(most))), lambda n: of_length(w, n)))

    return F.array_distinct(F.flatten(F.transform(words, all_of)))


def search_text(concept_id: Column | str, label: Column | str, synonyms: Column | str) -> Column:
    """X-02: id, label and synonyms, each without brackets, quotes and white space, joined by blanks; case kept."""
    bare = lambda x: F.regexp_replace(x, _MARKS, "")
    return F.concat_ws(" ", _c(concept_id), bare(_c(label)), F.transform(_list(synonyms), bare))


def canonical_text(label: Column | str, definition: Column | str, synonyms: Column | str) -> Column:
    """X-03: `label: definition (synonyms)` without blanks and colons at its ends."""
    syn = F.when(F.size(_list(synonyms)) > 0, F.concat(F.lit(" ("), F.array_join(_list(synonyms), " "), F.lit(")"))).otherwise("")
    whole = F.concat(F.coalesce(_c(label), F.lit("")), F.lit(": "), F.coalesce(_c(definition), F.lit("")), syn)
    return F.regexp_replace(whole, r"^[ :]+|[ :]+$", "")


def query_words(query: Column | str) -> Column:
    """X-04: the words of a query that must all match."""
    return F.array_distinct(tokens(query))


def query_needle(query: Column | str) -> Column:
    """X-04: the query as it is looked for in the search text."""
    return F.regexp_replace(F.lower(_c(query)), _MARKS, "")


def position_score(text: Column | str, needle: Column | str) -> Column:
    """X-05: 0-based character place, 10^9 where absent."""
    at = F.position(_c(needle), _c(text))
    return F.when(at > 0, at - 1).otherwise(F.lit(1_000_000_000))


def label_length(label: Column | str) -> Column:
    """X-06."""
    return F.coalesce(F.char_length(_c(label)), F.lit(999))


def last_part(x: Column | str, sep: str) -> Column:
    """X-09: what stands after the last separator."""
    return F.substring_index(_c(x), sep, -1)


def attributes(text: Column | str) -> Column:
    """X-10: map of `key "value";` pairs; of a repeated key the last value."""
    found = F.regexp_extract_all(_c(text), F.lit(r'(\w+) "([^"]*)"'), F.lit(0))
    keys = F.transform(found, lambda p: F.substring_index(p, " ", 1))
    vals = F.transform(found, lambda p: F.regexp_extract(p, r'"([^"]*)"', 1))
    n = F.size(keys)
    last = F.filter(F.sequence(F.lit(1), n), lambda i: ~F.array_contains(F.slice(keys, i + 1, F.greatest(n - i, F.lit(0))), F.element_at(keys, i)))
    return F.when(n > 0, F.map_from_arrays(F.transform(last, lambda i: F.element_at(keys, i)), F.transform(last, lambda i: F.element_at(vals, i))))


def longest_term(t198: Column | str, t60: Column | str, t30: Column | str) -> Column:
    """X-11."""
    full = lambda x: F.when(F.length(F.trim(_c(x))) > 0, _c(x))
    return F.coalesce(full(t198), full(t60), full(t30))


def ctv3_status(code: Column | str) -> Column:
    """X-12."""
    return F.when(_c(code).isin("C", "O"), "active").otherwise("deprecated")


def json_synonyms(text: Column | str, label: Column | str) -> Column:
    """X-13: a JSON list of strings without the first occurrence of the label; empty becomes null."""
    names = F.from_json(_c(text), "array<string>")
    at = F.coalesce(F.array_position(names, F.coalesce(_c(label), F.lit(""))), F.lit(0)).cast("int")
    rest = F.when(at == 0, names).otherwise(F.concat(F.slice(names, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(names, at + 1, F.size(names))))
    return F.when(F.size(rest) > 0, rest)


def safe_identifier(name: Column | str) -> Column:
    """X-19: non-word characters to _, lower case; an empty result is an error."""
    safe = F.lower(F.regexp_replace(F.trim(_c(name)), r"\W+", "_"))
    return F.when(F.length(safe) > 0, safe).otherwise(F.raise_error(F.lit("identifier is empty")).cast("string"))
