"""Words and sentences of many texts at once: code points are classed by a table, and words, their hashes and the
sentences they stand in come out as arrays, without a step per word."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from thesaurion.llm.words import mended, plain

CHARS = 200_000  #: characters handled together, about; a longer text is handled alone
HEADING = 8  #: words of a heading at most
_LETTER, _DIGIT, _END, _CLOSER, _SPACE, _LINE = 1, 2, 4, 8, 16, 32
_TAG = re.compile(r"<[^<>\n]{1,80}>|&[a-z]{2,6};|&#\d{1,5};")
_STEP = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _class(c: str) -> int:
    kind = _LETTER if c.isalnum() else 0
    kind |= _DIGIT if c in "0123456789" else 0
    kind |= _END if c in ".!?。" else 0
    kind |= _CLOSER if c in "\"'”’)]" else 0
    return kind | (_SPACE if c.isspace() else 0) | (_LINE if c == "\n" else 0)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    return np.array([_class(chr(i)) for i in range(0x10000)], np.uint8)


def _kinds(code: np.ndarray) -> np.ndarray:
    if not len(code) or code.max() <= 0xFFFF:
        return _classes()[code]
    high = code > 0xFFFF
    kind = _classes()[np.where(high, 0, code)]
    some, at = np.unique(code[high], return_inverse=True)
    kind[high] = np.array([_class(chr(i)) for i in some], np.uint8)[at]
    return kind


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64)] * 2


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            row = np.full(n + n // 2, base, np.uint64)
            row[0] = 1
            _POWERS[k] = np.multiply.accumulate(row)
    return _POWERS[0], _POWERS[1]


@dataclass
class Tokens:
    """The words of a batch of texts in order: hash (odd; even for numbers), text and sentence each stands in. Texts and
    sentences are numbered, sentences over all texts; both only grow."""

    word: np.ndarray
    text: np.ndarray
    sentence: np.ndarray

    def where(self, keep: np.ndarray) -> Tokens:
        return Tokens(self.word[keep], self.text[keep], self.sentence[keep])


def groups(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the runs of True."""
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    edge = np.r_[0 if len(kind) and kind[0] else [], edge, len(kind) if len(kind) and kind[-1] else []].astype(np.int64)
    return edge[::2], edge[1::2]


def _numbers(kind: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The words of digits only."""
    some = np.flatnonzero(kind[begin] & _DIGIT)
    size = (end - begin)[some]
    first = np.cumsum(size) - size
    digit = (kind[np.repeat(begin[some] - first, size) + np.arange(size.sum())] & _DIGIT) != 0
    return some[np.logical_and.reduceat(digit, first)] if len(some) else some


def _marks(kind: np.ndarray) -> np.ndarray:
    """The end marks before white space, perhaps with closing quotes or brackets between."""
    mark = np.flatnonzero((kind & _END) != 0)
    after = mark + 1
    quoted = np.flatnonzero(kind[after] & _CLOSER)
    if len(quoted):
        closer = np.flatnonzero((kind & _CLOSER) != 0)
        last = np.flatnonzero(np.diff(closer, append=len(kind) + 1) > 1)  # of a run of closers
        after[quoted] = closer[last[np.searchsorted(last, np.searchsorted(closer, after[quoted]))]] + 1
    return mark[(kind[after] & _SPACE) != 0]


def _breaks(kind: np.ndarray) -> np.ndarray:
    """The first line end of each stretch of white space with more than one."""
    line = np.flatnonzero((kind & _LINE) != 0)
    more = ~np.logical_or.reduceat((kind & _SPACE) == 0, line)
    more[-1] = False
    return line[more & ~np.r_[False, more[:-1]]]


def _before(place: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """How many of the places lie before each word."""
    return np.cumsum(np.bincount(np.searchsorted(begin, place), minlength=len(begin))[: len(begin)])


def tokens(texts: list[str]) -> Tokens:
    """Words are runs of letters and digits of the plain text (see `words.plain`), damaged encodings mended and markup left
    out first. A sentence ends at an end mark, perhaps with closing quotes or brackets, before white space, and at a blank
    line. Headings are left out: blocks before further text of at most HEADING words that neither end in an end mark nor
    hold a finished sentence of three words."""
    dressed = []
    for t in texts:
        t = mended(t)
        if "<" in t or "&" in t:
            t = _TAG.sub(" ", t)
        dressed.append(plain(t))
    code = np.frombuffer(("\n\n".join(dressed) + "\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds(code)
    letter = (kind & _LETTER) != 0
    begin, end = groups(letter)
    if not len(begin):
        return Tokens(np.array([], np.uint32), np.array([], np.int64), np.array([], np.int64))
    up, down = _powers(len(code))
    parts = code.astype(np.uint64)
    parts += 1
    parts *= letter
    parts *= up[: len(code)]
    word = np.add.reduceat(parts, begin) * down[begin]
    word ^= word >> np.uint64(29)
    word = ((word * _MIX) >> np.uint64(32)).astype(np.uint32)
    word |= np.uint32(1)
    word[_numbers(kind, begin, end)] &= ~np.uint32(1)

    mark, breaks = _marks(kind), _breaks(kind)
    marks, block = _before(mark, begin), _before(breaks, begin)
    length = np.fromiter(map(len, dressed), np.int64, len(dressed)) + 2
    text = _before(np.cumsum(length), begin)

    sentence = marks + block
    first = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
    size = np.diff(np.r_[first, len(begin)])
    sentence = np.repeat(np.arange(len(first)), size)
    # blocks with words: their sentences, words, and whether an end mark follows the last word
    b_first = np.flatnonzero(np.r_[True, block[first][1:] != block[first][:-1]])
    b_last = np.r_[b_first[1:], len(first)] - 1
    b_text = text[first[b_first]]
    final = np.r_[first[1:], len(begin)][b_last] - 1
    closed = np.searchsorted(mark, breaks[block[final]]) > marks[final]
    finished = size.copy()
    finished[b_last] = 0
    words = np.add.reduceat(size, b_first)
    heading = (np.r_[b_text[1:], -1] == b_text) & (words <= HEADING) & ~closed & (np.maximum.reduceat(finished, b_first) < 3)
    return Tokens(word, text, sentence).where(~np.repeat(heading, words))


def batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """(begin, end) of stretches of texts that are handled together."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHARS:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def triples(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(hash, sentence) of each three words in a row of one sentence."""
    if len(t.word) < 3:
        return np.array([], np.uint64), np.array([], np.int64)
    w = t.word.astype(np.uint64)
    code = w[:-2] * _MIX
    code ^= code >> np.uint64(31)
    for x in (w[1:-1], w[2:]):
        code = (code ^ x) * _MIX
        code ^= code >> np.uint64(29)
    own = t.sentence[:-2] == t.sentence[2:]
    return code[own], t.sentence[:-2][own]


@dataclass(frozen=True)
class Triples:
    """A set of word triples: sorted hashes, and a table that tells most others at a glance."""

    codes: np.ndarray
    seen: np.ndarray

    @staticmethod
    def of(codes: np.ndarray) -> Triples:
        codes = np.unique(codes.astype(np.uint64))
        bits = max(12, int(len(codes)).bit_length() + 3)
        seen = np.zeros(1 << bits, bool)
        seen[codes >> np.uint64(64 - bits)] = True
        return Triples(codes, seen)

    def hits(self, t: Tokens) -> np.ndarray:
        """For each sentence of t, how many of its triples are in the set."""
        n = int(t.sentence[-1]) + 1 if len(t.sentence) else 0
        if not len(self.codes) or not n:
            return np.zeros(n, np.int64)
        code, sentence = triples(t)
        maybe = self.seen[code >> np.uint64(64 - len(self.seen).bit_length() + 1)]
        code, sentence = code[maybe], sentence[maybe]
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.bincount(sentence[self.codes[at] == code], minlength=n)
