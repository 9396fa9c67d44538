import random

from conftest import rows

from thesaurion import runtime
from thesaurion.llm.components import groups


def brute(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        ends = [x for x in (a, b) if x is not None]
        for x in ends:
            find(x)
        if len(ends) == 2:
            r, s = sorted((find(a), find(b)))
            up[s] = r
    return sorted((x, find(x)) for x in up)


def run(spark, scratch, links):
    return rows(groups(spark.createDataFrame([(a, b, "z", 1) for a, b in links], "a string, b string, k string, u int"), scratch))


def test_shapes(spark, scratch):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(70)]
    star = [("hub", f"s{i}") for i in range(50)]
    links = [*chain, *star, ("q", "q"), ("p", None), (None, None), ("y", "x"), ("x", "y"), ("x", "y")]
    assert run(spark, scratch, links) == brute(links)
    assert run(spark, scratch, []) == []


def test_random_with_hot_record(spark, scratch, monkeypatch):
    monkeypatch.setattr(runtime, "HOT_ROWS", 1000)
    rng = random.Random(2)
    links = [("hot", f"h{i}") for i in range(12_000)] + [(f"r{rng.randrange(6000)}", f"r{rng.randrange(6000)}") for _ in range(4000)]
    assert run(spark, scratch, links) == brute(links)
