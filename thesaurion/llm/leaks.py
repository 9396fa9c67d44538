"""Problem 9: evaluation texts inside the corpus.

Rare word n-grams of the test items seed candidate pairs of document and item; Smith-Waterman alignment of the words
around a seed scores exact, partial, edited and paraphrased copies, and counts the longest run of equal words.

Every stretch of STRETCH item words contributes as seed its n-gram that is rarest in the corpus, so a document that
holds STRETCH consecutive words of an item always meets it. Items are taken in blocks of bounded size, one pass over
the corpus for each block, so that what a task holds of the items is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thesaurion.llm.words import words
from thesaurion.runtime import Scratch

GRAM = 5  #: words of a seed
STRETCH = 7  #: words of an item within which one n-gram is a seed
SLACK = 6  #: words, besides an eighth of the item, that may be inserted or lost before a seed
LEAST = 10  #: words that must agree for an exact leak
BLOCK_WORDS = 1_000_000  #: item words held by a task at once
MATCH, MISS, GAP = 2, -1, -1
_MIX = np.uint64(0x9E3779B97F4A7C15)
PAIRS = "doc_id long, item_id long, score int, span int, longest int, close boolean"
_PAIRS = 512  #: pairs aligned together


@dataclass
class Items:
    """A block of items as word numbers, and its distinct n-grams in hash order."""

    ids: np.ndarray
    texts: list[np.ndarray]
    vocab: dict[str, int]
    grams: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int, str]]) -> Items:
        vocab: dict[str, int] = {}
        texts = [np.array([vocab.setdefault(w, len(vocab) + 1) for w in words(t)], np.int32) for _, t in rows]
        codes = [gram_codes(t) for t in texts if len(t) >= GRAM]
        return Items(np.array([i for i, _ in rows], np.int64), texts, vocab, np.unique(np.concatenate(codes)) if codes else np.array([], np.uint64))


def gram_codes(ids: np.ndarray) -> np.ndarray:
    """Hash of every window of GRAM word numbers."""
    n = len(ids) - GRAM + 1
    if n <= 0:
        return np.array([], np.uint64)
    x = ids.astype(np.uint64)
    code = np.zeros(n, np.uint64)
    for j in range(GRAM):
        code = (code ^ x[j : j + n]) * _MIX
        code ^= code >> np.uint64(29)
    return code


def lookup(grams: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Place of each code in the sorted grams, -1 where absent."""
    if not len(grams):
        return np.full(len(codes), -1)
    at = np.minimum(np.searchsorted(grams, codes), len(grams) - 1)
    return np.where(grams[at] == codes, at, -1)


def matches(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, ids, gram, pos): documents that hold any n-gram of the items, with their words as item word numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = items.vocab.get
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"].tolist(), b["text"]):
                ids = np.array([get(w, 0) for w in words(text)], np.int32)
                if np.count_nonzero(ids) < GRAM:
                    continue
                known = np.convolve(ids > 0, np.ones(GRAM, int), "valid") == GRAM if len(ids) >= GRAM else np.array([], bool)
                pos = np.flatnonzero(known)
                gram = lookup(items.grams, gram_codes(ids)[pos])
                if (gram >= 0).any():
                    out.append((doc, ids.tolist(), gram[gram >= 0].tolist(), pos[gram >= 0].tolist()))
            yield pd.DataFrame(out, columns=["doc_id", "ids", "gram", "pos"])

    return docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>, gram array<int>, pos array<int>")


def choose_seeds(items: Items, df: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """gram -> (item, place) of the n-grams that are rarest in their stretch of STRETCH words (the first among equals);
    those that no document holds do not matter. An item shorter than that is one stretch."""
    df = np.where(df > 0, df, np.iinfo(np.int64).max)
    seeds: dict[int, set[tuple[int, int]]] = {}
    for k, t in enumerate(items.texts):
        g = lookup(items.grams, gram_codes(t))
        if not len(g):
            continue
        span = min(STRETCH - GRAM + 1, len(g))
        view = np.lib.stride_tricks.sliding_window_view(df[g], span)
        for at in np.unique(np.arange(len(view)) + view.argmin(1)):
            if df[g[at]] < np.iinfo(np.int64).max:
                seeds.setdefault(int(g[at]), set()).add((k, int(at)))
    return {g: sorted(s) for g, s in seeds.items()}


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman over a batch of padded word rows a (item) and b (document): per pair the best local score, the
    longest run of equal words, and the first row at which the best score ends. Padding is -1 in a, -2 in b.

    Rows of the item are taken in turn; the gap along the document is a running maximum, so each step is vectorised."""
    n, width = len(a), b.shape[1]
    kind = np.int16 if MATCH * a.shape[1] + width < 32_000 else np.int32
    slide = (-GAP * np.arange(width)).astype(kind)
    h = np.zeros((n, width + 1), kind)
    run = np.zeros((n, width + 1), kind)
    best, end, longest = np.zeros(n, kind), np.zeros(n, np.int32), np.zeros((n, width), kind)
    gain, gap = kind(MATCH - MISS), kind(GAP)
    for i in range(a.shape[1]):
        same = a[:, i : i + 1] == b
        own = same * gain
        own += h[:, :-1]
        own += kind(MISS)
        np.maximum(own, h[:, 1:] + gap, out=own)
        np.maximum(own, 0, out=own)
        own += slide
        np.maximum.accumulate(own, 1, out=own)
        own -= slide
        h[:, 1:] = own
        run[:, 1:] = (run[:, :-1] + kind(1)) * same
        now = own.max(1)
        end[now > best] = i
        np.maximum(best, now, out=best)
        np.maximum(longest, run[:, 1:], out=longest)
    return best.astype(np.int32), longest.max(1).astype(np.int32), end


def spans(a: np.ndarray, b: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Item words spanned by the best alignment that ends at row `end`, the first such row: the same table over both
    rows read backwards from there ends at the alignment's begin."""
    at = end[:, None] - np.arange(a.shape[1])
    back = np.where(at >= 0, np.take_along_axis(a, np.maximum(at, 0), 1), -1)
    return align(back, b[:, ::-1])[2] + 1


def near_copy(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether some alignment of item words a with document words b reaches four fifths of the full score of its item
    words, LEAST at least.

    One over 2 * LEAST item words or more falls into parts of LEAST words or more of which one reaches it too, and
    leading words that do not match only lower it: so alignments that begin at a word held by b and span fewer words
    are tried, all begins at once. At most two item words of such a stretch can fail to match."""
    held = np.isin(a, b)
    ahead = np.convolve(np.r_[held, np.zeros(LEAST - 1, bool)], np.ones(LEAST, int), "valid")
    begins = np.flatnonzero(held & (ahead >= LEAST * 4 // 5))
    if not len(begins):
        return False
    most = 2 * LEAST - 1
    rows = np.r_[a, np.full(most, -1, np.int32)][begins[:, None] + np.arange(most)]
    slide = -GAP * np.arange(len(b) + 1, dtype=np.int32)
    h = np.zeros((len(begins), len(b) + 1), np.int32)
    for i in range(most):
        new = h + GAP
        np.maximum(new[:, 1:], h[:, :-1] + np.where(rows[:, i : i + 1] == b, MATCH, MISS), out=new[:, 1:])
        h = np.maximum.accumulate(new + slide, 1) - slide
        if 5 * h.max() >= 4 * MATCH * max(i + 1, LEAST):
            return True
    return False


def _padded(rows: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows))), fill, np.int32)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def windows(ids: np.ndarray, begins: list[int], length: int, slack: int) -> list[np.ndarray]:
    """The stretches of a document where an item of that length would lie if it began at the given places, with slack for
    inserted and lost words, joined where they overlap."""
    out, lo, hi = [], None, None
    for p in sorted(begins):
        if lo is not None and p - slack <= hi:
            hi = p + length + slack
            continue
        if lo is not None:
            out.append(ids[max(0, lo) : hi])
        lo, hi = p - slack, p + length + slack
    out.append(ids[max(0, lo) : hi])
    return out


def score_pairs(found: DataFrame, items: Items, seeds: dict[int, list[tuple[int, int]]], edited: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            todo = []
            for doc, ids, gram, pos in zip(b["doc_id"].tolist(), b["ids"], b["gram"], b["pos"]):
                near: dict[int, list[int]] = {}
                for g, p in zip(gram, pos):
                    for k, at in seeds.get(int(g), ()):
                        near.setdefault(k, []).append(int(p) - at)
                ids = np.asarray(ids, np.int32)
                for k, at in near.items():
                    todo += [(doc, k, w) for w in windows(ids, at, len(items.texts[k]), SLACK + len(items.texts[k]) // 8)]
            todo.sort(key=lambda x: (len(x[2]), len(items.texts[x[1]])))
            parts, lo = [], 0
            while lo < len(todo):
                hi = min(lo + _PAIRS, len(todo))
                while hi > lo + 1 and (hi - lo) * len(todo[hi - 1][2]) > 400_000:
                    hi = lo + (hi - lo) // 2
                some = todo[lo:hi]
                a, b2 = _padded([items.texts[k] for _, k, _ in some], -1), _padded([w for _, _, w in some], -2)
                best, longest, end = align(a, b2)
                span = np.zeros(len(some), np.int32)
                if (long := best >= MATCH * LEAST * 4 // 5).any():
                    span[long] = spans(a[long], b2[long], end[long])
                close = (longest >= LEAST) | (5 * best >= 4 * MATCH * np.maximum(span, LEAST))
                for j in np.flatnonzero(long & ~close) if edited else ():
                    close[j] = near_copy(items.texts[some[j][1]], some[j][2])
                parts.append(pd.DataFrame({"doc_id": [d for d, _, _ in some], "item_id": items.ids[[k for _, k, _ in some]], "score": best, "span": span, "longest": longest, "close": close}))
                lo = hi
            if parts:
                yield pd.concat(parts)

    return found.mapInPandas(run, PAIRS)


def leaks(docs: DataFrame, items: DataFrame, scratch: Scratch, edited: bool = False) -> DataFrame:
    """doc_id, item_id, score, span, longest, close: one row per document and item that meet at a seed.

    docs: doc_id long, text; items: item_id long, text. score is the Smith-Waterman score (2 a match, -1 a miss or gap),
    span the item words of that alignment (0 where the score is below four fifths of LEAST matches), longest the longest run of equal words. close: longest is LEAST or more, or the best alignment reaches four fifths
    of the full score; with edited, any alignment that does counts, not only the best (costs more). Null ids or texts take no part,
    wordless texts meet nothing, long texts are read whole; rows that repeat a doc_id or item_id are scored together.
    Other columns are not read. A document with very many seeds is split into stretches, each aligned on its own."""
    rows = items.where("item_id is not null and text is not null").select("item_id", "text").distinct().orderBy("item_id", "text")
    out: DataFrame | None = None
    block: list[tuple[int, str]] = []
    size = 0
    for r in [*rows.toLocalIterator(), None]:
        n = len(r["text"].split()) if r else 0
        if block and (r is None or size + n > BLOCK_WORDS):
            part = _block(docs, Items.of(block), scratch, edited)
            out = part if out is None else out.unionByName(part)
            block, size = [], 0
        if r:
            block.append((r["item_id"], r["text"]))
            size += n
    if out is None:
        out = docs.sparkSession.createDataFrame([], PAIRS)
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max_by("span", "score").alias("span"), F.max("longest").alias("longest"), F.max("close").alias("close"))


def _block(docs: DataFrame, items: Items, scratch: Scratch, edited: bool) -> DataFrame:
    found = scratch.cut(matches(docs, items))
    # as many rows as the block has distinct n-grams at most
    counts = found.select("doc_id", F.explode(F.array_distinct("gram")).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()
    df = np.zeros(len(items.grams), np.int64)
    for r in counts:
        df[r["g"]] = r["n"]
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return score_pairs(found.repartition(max(cores, found.rdd.getNumPartitions())), items, choose_seeds(items, df), edited)
