import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from thesaurion.llm import tokens as m
from thesaurion.llm.words import mended, plain, words

TOKEN = re.compile(r"[^\W_]+|[.!?。][\"'”’)\]]*(?=\s|$)")


def sentences(text):
    """The rules of tokens(), word by word."""
    text = m._TAG.sub(" ", mended(text)) if "<" in text or "&" in text else mended(text)
    out, blocks = [], [b for b in re.split(r"\n\s*\n", plain(text)) if re.search(r"[^\W_]", b)]
    for i, b in enumerate(blocks):
        found, runs = TOKEN.findall(b), [[]]
        for t in found:
            if t[0] in ".!?。":
                runs.append([])
            else:
                runs[-1].append(t)
        closed = not runs[-1]
        runs = [r for r in runs if r]
        last = len(runs[-1]) if closed else 0
        short = i + 1 < len(blocks) and sum(map(len, runs)) <= m.HEADING and not closed
        if not (short and all(len(r) < 3 for r in runs[:-1]) and last == 0):
            out += runs
    return out


def shape(t, texts):
    out = [[] for _ in range(texts)]
    for s, n in Counter(t.sentence.tolist()).items():
        out[t.text[np.searchsorted(t.sentence, s)]].append(n)
    return out


@settings(deadline=None, max_examples=300)
@given(st.lists(st.text("abZ9é _.!?。\n\t\"')]<>&;*-\u00ad\U0001d400", max_size=60), min_size=1, max_size=5))
def test_as_word_by_word(texts):
    assert shape(m.tokens(texts), len(texts)) == [[len(s) for s in sentences(t)] for t in texts]


def test_words_and_numbers():
    t = m.tokens(["Alpha 12 beta", "ALPHA　beta 1b", "", "..."])
    a = t.word.tolist()
    assert a[0] == a[3] and a[2] == a[4] and a[0] != a[2]
    assert [x % 2 for x in a] == [1, 0, 1, 1, 1, 1] and t.text.tolist() == [0, 0, 0, 1, 1, 1]
    many = sorted({w for i in range(40_000) for w in words(f"w{i} x{i * 7} {i}")})
    assert len(set(m.tokens([" ".join(many)]).word.tolist())) > len(many) - 5


def test_headings():
    count = lambda x: shape(m.tokens([x]), 1)[0]
    assert count("# Title 7\n\nOne two. Three four? (Five!) six") == [2, 2, 1, 1]
    cut = "One two three four. Five six seven"
    assert count(f"Note no. 7\n\n{cut}\n\nEnd of it.") == [4, 3, 3]
    bare = "these are ten words of a paragraph without any mark"
    assert count(f"{bare}\n\nA heading of six words here\n\n{bare}:\n\nLast.") == [10, 10, 1]


def test_triples():
    held = m.Triples.of(m.triples(m.tokens(["alpha beta gamma delta epsilon zeta."]))[0])
    assert held.hits(m.tokens(["x alpha beta gamma delta epsilon. Alpha beta and other. Alpha beta"])).tolist() == [3, 0, 0]
    assert m.Triples.of(np.array([], np.uint64)).hits(m.tokens(["a b c"])).tolist() == [0]
    assert held.hits(m.tokens([""])).tolist() == []


def test_long_text_is_read_whole():
    assert len(m.tokens(["wave tide harbour. " * 100_000]).word) == 300_000
    assert list(m.batches(["x" * 500_000, "y", "z"])) == [(0, 1), (1, 3)] and list(m.batches([])) == []
