import numpy as np
import pandas as pd
from conftest import DATA, rows

from thesaurion.llm import leaks as m
from thesaurion.llm.queries import p9_found, p9_similar
from thesaurion.llm.words import mended, words


def test_words():
    assert words("Ｆｕｌｌ Wid​th, soft­hyphen; CAPS-lock_x 3²") == ["full", "width", "softhyphen", "caps", "lock", "x", "32"]
    assert words(None) == words("") == words(" .,;") == []
    assert mended("dÃ©fini") == "défini" and mended("défini") == "défini"


def test_alignment_against_table():
    rng = np.random.default_rng(1)
    a, b = rng.integers(1, 6, (40, 9)).astype(np.int32), rng.integers(1, 6, (40, 14)).astype(np.int32)
    best, longest, end = m.align(a, b)
    span = m.spans(a, b, end)
    for k in range(40):
        h = np.zeros((10, 15), int)
        begin = np.zeros((10, 15), int)  # the last row at which an alignment of that score may begin
        run = np.zeros((10, 15), int)
        for i in range(1, 10):
            for j in range(1, 15):
                same = a[k, i - 1] == b[k, j - 1]
                ways = [(h[i - 1, j - 1] + (m.MATCH if same else m.MISS), begin[i - 1, j - 1] if h[i - 1, j - 1] else i), (h[i - 1, j] + m.GAP, begin[i - 1, j]), (h[i, j - 1] + m.GAP, begin[i, j - 1])]
                h[i, j], begin[i, j] = max([x for x in ways if x[0] > 0], default=(0, 0))
                run[i, j] = run[i - 1, j - 1] + 1 if same else 0
        assert best[k] == h.max() and longest[k] == run.max()
        last = min(i for i in range(10) if h[i].max() == h.max())
        assert end[k] == last - 1
        assert span[k] == last - max(begin[last, j] for j in range(15) if h[last, j] == h.max()) + 1


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen"


def found(spark, scratch, docs, items):
    d = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], "doc_id long, text string, gram int, item_id int")
    e = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, ids string")
    return {(r["doc_id"], r["item_id"]): r for r in m.leaks(d, e, scratch).collect()}


def test_guises(spark, scratch):
    w = ITEM.split()
    docs = [
        (1, "intro " + ITEM + " end"), (2, "x " + " ".join(w[1:11]) + " y"), (3, "x " + " ".join(w[1:10]) + " y"), (4, ", ".join(x.upper() for x in w[2:12])),
        (5, " ".join(w[:7]) + " CHANGED " + " ".join(w[8:])), (6, None), (7, ""), (8, "pad " * 30_000 + ITEM + " pad" * 10), (None, ITEM), (1, "again"), (9, "unrelated words only"),
    ]
    out = found(spark, scratch, docs, [(1, ITEM), (2, None), (3, "short item here"), (None, ITEM), (4, ITEM)])
    exact = {k for k, r in out.items() if r["longest"] >= m.LEAST}
    assert exact == {(d, i) for d in (1, 2, 4, 8) for i in (1, 4)}
    assert out[3, 1]["longest"] == 9 and out[5, 1]["longest"] == 7
    assert out[5, 1]["score"] == 12 * m.MATCH + m.MISS and out[5, 1]["span"] == 13
    assert found(spark, scratch, [], [(1, ITEM)]) == found(spark, scratch, docs, []) == {}


def test_blocks_give_the_same(spark, scratch, monkeypatch):
    docs, items = [(1, ITEM), (2, "z " + ITEM[20:])], [(i, f"{ITEM} tail{i}") for i in range(5)]
    whole = found(spark, scratch, docs, items)
    monkeypatch.setattr(m, "BLOCK_WORDS", 20)
    assert found(spark, scratch, docs, items) == whole and len(whole) == 10


def test_all_documents_against_brute_force(spark):
    docs, items = pd.read_parquet(f"{DATA}/documents.parquet"), pd.read_parquet(f"{DATA}/eval_item.parquet")
    grams = {}
    for i, t in zip(items.item_id, items.text):
        w = words(t)
        for k in range(len(w) - 9):
            grams.setdefault(tuple(w[k : k + 10]), set()).add(i)
    want = set()
    for d, t in zip(docs.doc_id, docs.text):
        w = words(t)
        want |= {(d, i) for k in range(len(w) - 9) for i in grams.get(tuple(w[k : k + 10]), ())}
    assert rows(p9_found(spark, DATA)) == sorted(want)


def test_similar_by_any_alignment(spark, tmp_path):
    """A replaced sentence between two clean pieces is bridged by the best alignment, which is then too thin."""
    w = [f"w{i}" for i in range(55)]
    x = [f"x{i}" for i in range(15)]
    edited = [*w[:6], "x", *w[7:13], "y", *w[14:20]]  # no run of ten, four fifths of the full score
    docs = [(1, [*w[:20], *x, *w[35:]]), (2, [*edited, *x, *w[35:42]]), (3, w), (4, [*w[:7], *x[:7], *w[14:21], *x[:7], *w[28:35]]), (5, [*w[:7], *x])]
    spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(w))], "item_id long, text string").write.parquet(f"{tmp_path}/eval_item.parquet")
    got = {r["doc_id"]: r for r in p9_similar(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3} and (got[1]["score"], got[1]["span"]) == (65, 55)


def test_near_copy_against_table():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a = rng.integers(1, 30, 26).astype(np.int32)
        b = a.copy()
        b[rng.random(26) < rng.choice([0.05, 0.12, 0.2])] = 0
        b = np.delete(b, rng.integers(0, 26, 2)) if rng.random() < 0.5 else np.insert(b, rng.integers(0, 26, 2), 0)
        want = False
        for start in range(26):
            h = np.zeros(len(b) + 1, int)
            for i in range(start, 26):
                new = h - 1
                for j in range(len(b)):
                    new[j + 1] = max(new[j + 1], h[j] + (2 if a[i] == b[j] else -1), new[j] - 1)
                h = new
                want |= h.max() >= 1.6 * max(i - start + 1, 10)
        assert m.near_copy(a, b) == want
