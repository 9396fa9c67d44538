import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from thesaurion.llm.containers import BestFit, encoding, pack, sizes
from thesaurion.llm.queries import TOKENIZER


@given(st.lists(st.integers(0, 50), max_size=80), st.integers(1, 6))
def test_bins(items, most):
    bins, closed = BestFit(50, most), []
    for k, size in enumerate(items):
        closed += bins.add((k, size), size)
        assert bins.open <= most
    whole = closed + bins.rest()
    assert sorted(x for b in whole for x in b) == list(enumerate(items))
    assert all(sum(s for _, s in b) <= 50 for b in whole)


def check(out, want, capacity):
    by = {}
    for r in out:
        by.setdefault(r["container_id"], []).append(r["n_tokens"])
    assert all(0 <= sum(v) <= capacity for v in by.values()) and None not in by
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["n_tokens"]))
    for doc, size in want.items():
        parts = sorted(got.pop(doc))
        assert [p[0] for p in parts] == list(range(max(1, -(-size // capacity))))
        assert [p[1] for p in parts] == [i * capacity for i in range(len(parts))]
        assert sum(p[2] for p in parts) == size
    assert not got
    return by


def test_pack_many(spark, scratch):
    rng = random.Random(3)
    want = {str(i): int(rng.lognormvariate(4, 1.2)) for i in range(5000)}
    df = spark.createDataFrame(list(want.items()), "doc_id string, size int").repartition(40)
    by = check(pack(df, 1000, scratch, most=8).collect(), want, 1000)
    assert sum(want.values()) / 1000 / len(by) > 0.97


def test_odd_items(spark, scratch):
    df = spark.createDataFrame([("a", 10), ("b", 25), ("c", 0), ("d", None), ("e", -4), ("a", 3), (None, 5)], "doc_id string, size int")
    out = pack(df, 10, scratch).collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["None", "a", "a", "b", "b", "b", "c", "d", "e"]
    assert sum(r["n_tokens"] for r in out) == 43
    assert pack(df.limit(0), 10, scratch).count() == 0


def test_sizes_round_trip(spark):
    pytest.importorskip("tiktoken")
    own = encoding(TOKENIZER)
    texts = ["plain text", "Ünïcödé 😀", "", None, "a" * 20_000, " \n\t"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "id long, text string, size int")
    got = {r["doc_id"]: r["size"] for r in sizes(df, "id", "text", TOKENIZER).collect()}
    for i, t in enumerate(texts):
        tokens = own.encode_ordinary(t or "")
        assert own.decode(tokens) == (t or "") and got[str(i)] == len(tokens)


def test_a_run_of_blank_texts_fills_no_container_without_end(monkeypatch):
    from thesaurion.llm import containers

    monkeypatch.setattr(containers, "ITEMS", 50)
    bins = containers.BestFit(10, 4)
    closed = [one for i in range(220) for one in bins.add(i, 0)]
    assert [len(one) for one in closed] == [50] * 4 and sum(map(len, bins.rest())) == 20
