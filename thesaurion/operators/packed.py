"""Problem 6: several values packed in one field, one row per value with its place.

One finite-state tokenizer reads every kind of field. It walks over runs of characters of one class and keeps four
things: whether it is inside quotes, whether an escape is open, the bracket depth, and where in a value it stands. A
grammar says which runs end a value: one delimiter outside quotes at the field's own depth, or, where a value is a word
of a known form, everything that is not part of such a word.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fields that hold no value, and the delimiters of unlisted fields, the first one found counts.
PLACEHOLDERS = ("", "-", "NA", "null", "[]", "|")
DELIMITERS = "|;,"

#: Runs of one class; characters of no class are never significant and are skipped.
_SIGNS = re.compile(r'(?P<quote>")|(?P<escape>\\)|(?P<open>[\[{])|(?P<close>[\]}])|(?P<mark>[|;,])')
_RUNS = re.compile(r"(?P<letters>[A-Za-z]+)|(?P<digits>[0-9]+)|(?P<hyphen>-)|(?P<other>[^A-Za-z0-9-]+)")

#: Between values, in the letters and digits of one, behind its hyphen, in the number after the hyphen.
OUT, WORD, HYPHEN, NUMBER = range(4)
#: (state, class of run) -> state; a run of a class that is not listed leads OUT. A value goes on while the state grows
#: or stays, and a hyphen belongs to it only once a number follows.
_WORDS = {
    (OUT, "letters"): WORD, (WORD, "letters"): WORD, (HYPHEN, "letters"): WORD, (NUMBER, "letters"): WORD,
    (OUT, "digits"): WORD, (WORD, "digits"): WORD, (HYPHEN, "digits"): NUMBER, (WORD, "hyphen"): HYPHEN,
}


class Grammar(NamedTuple):
    delimiters: str | None  #: what parts values; None: values are words, all else parts them
    escapes: bool = False  #: a backslash inside quotes takes the next character along; else quotes are doubled
    nests: bool = False  #: the field is one bracketed list: delimiters count at depth 1 only


WORDS, LISTED = Grammar(None), Grammar(",", escapes=True, nests=True)


def tokenize(text: str, grammar: Grammar) -> list[tuple[int, int]]:
    """(begin, end) of each value in order, with its quotes and white space, and blank ones where delimiters meet."""
    out, begin, end, state = [], 0, 0, OUT
    quoted, skip, depth = False, -1, 0
    for m in (_RUNS if grammar.delimiters is None else _SIGNS).finditer(text):
        kind, at = m.lastgroup, m.start()
        if grammar.delimiters is None:
            new = _WORDS.get((state, kind), OUT)
            if state != OUT and (new < state):
                out.append((begin, end))
            if new == WORD and state != WORD:
                begin = at
            if new in (WORD, NUMBER):
                end = m.end()
            state = new
        elif at == skip:
            continue
        elif kind == "escape":
            if quoted and grammar.escapes:
                skip = at + 1
        elif kind == "quote":
            if quoted and not grammar.escapes and text[at + 1 : at + 2] == '"':
                skip = at + 1
            else:
                quoted = not quoted
        elif quoted:
            continue
        elif kind == "open":
            depth += 1
            if grammar.nests and depth == 1:
                begin = at + 1
        elif kind == "close":
            depth -= 1
            if grammar.nests and depth == 0:
                out.append((begin, at))
        elif m.group() in grammar.delimiters and (depth == 1 or not grammar.nests):
            out.append((begin, at))
            begin = at + 1
    if grammar.delimiters is None:
        return [*out, (begin, end)] if state != OUT else out
    return out if grammar.nests else [*out, (begin, len(text))]


def unquote(part: str) -> str:
    """Quotes off, doubled quotes inside quotes to one."""
    if '"' not in part:
        return part.strip()
    out, quoted, i = [], False, 0
    while i < len(part):
        c = part[i]
        if c == '"':
            if quoted and part[i + 1 : i + 2] == '"':
                out.append('"')
                i += 1
            else:
                quoted = not quoted
        else:
            out.append(c)
        i += 1
    return "".join(out).strip()


def listed(text: str) -> list[str] | None:
    """The non-null strings of a JSON list; None if the field is no such list."""
    body = text.strip()
    if not (body.startswith("[") and body.endswith("]")):
        return None
    try:
        parts = [json.loads(x) for x in (body[a:b] for a, b in tokenize(body, LISTED)) if x.strip()]
    except ValueError:
        return None
    return [x for x in parts if isinstance(x, str)]


def delimiter(text: str) -> str | None:
    """The first of DELIMITERS, in that order, that parts values outside quotes."""
    return next((d for d in DELIMITERS if d in text and len(tokenize(text, Grammar(d))) > 1), None)


def split_field(text: str | None, kind: str) -> list[str]:
    """Values of one field in order, blank ones left out, repeated ones kept.

    kind `accession`: a value is a word of letters and digits, perhaps with hyphen and number, all else is packing. kind
    `text`: the field has one delimiter, see `delimiter`. In both a JSON list gives its strings, and only these."""
    if text is None or text.strip() in PLACEHOLDERS:
        return []
    parts = listed(text)
    if kind == "accession":
        return [x[a:b] for x in (parts if parts is not None else [text]) for a, b in tokenize(x, WORDS)]
    if parts is None:
        cut = delimiter(text)
        parts = [unquote(text[a:b]) for a, b in tokenize(text, Grammar(cut))] if cut else [unquote(text)]
    return [x.strip() for x in parts if x.strip()]


def split_packed(records: DataFrame, rec_id: str, field: str, kind: str) -> DataFrame:
    """(rec_id, pos, item): one row per value of `field`, pos from 1 per record.

    Repeated rows of a record count once. A null record id is kept as null; null, blank and placeholder fields give no
    row; texts of any length are read whole. Other columns are not read."""
    rows = records.select(F.col(rec_id).cast("string").alias("rec_id"), F.col(field).alias("field"))
    rows = rows.where(F.col("field").isNotNull() & ~F.trim("field").isin(*PLACEHOLDERS)).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            items = [split_field(x, kind) for x in b["field"]]
            yield pd.DataFrame({"rec_id": b["rec_id"], "items": items})

    split = rows.mapInPandas(run, "rec_id string, items array<string>")
    return split.select("rec_id", F.posexplode("items").alias("p", "item")).select("rec_id", (F.col("p") + 1).cast("int").alias("pos"), "item")
