import random

from conftest import rows
from pyspark.sql import functions as F

from thesaurion.llm.topn import top_n

TIE = "try_cast(i as decimal(38, 0))"


def brute(data, n):
    best = {}
    for g, i, s in data:
        if g is None or i is None or s is None or s != s:
            continue
        best[g, i] = max(s, best.get((g, i), s))
    out = []
    for g in {g for g, _ in best}:
        own = sorted((-s, int(i) if i.isdigit() else 10**20, i) for (h, i), s in best.items() if h == g)
        out += [(g, k + 1, i, -s) for k, (s, _, i) in enumerate(own[:n])]
    return sorted(out)


def frame(spark, data):
    return spark.createDataFrame([(g, i, s, "x", 1, 2) for g, i, s in data], "g string, item string, score double, i string, s int, r int")


def test_ties_repeats_nulls_and_clashing_names(spark, scratch):
    data = [("a", "10", 0.5), ("a", "9", 0.5), ("a", "9", 0.1), ("a", "x", 0.5), ("a", None, 1.0), (None, "1", 1.0), ("a", "8", None), ("a", "7", float("nan")), ("b", "1", 0.0), ("b", "1", 0.0), ("c", "1", -3.0), ("c", "2", 9.0)]
    assert rows(top_n(frame(spark, data), "g", "item", "score", 3, F.expr(TIE), scratch)) == brute(data, 3)


def test_empty(spark, scratch):
    assert rows(top_n(frame(spark, []), "g", "item", "score", 3, F.expr(TIE), scratch)) == []


def test_hot_group_and_bands(spark, scratch):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.4 else f"g{rng.randrange(300)}", str(rng.randrange(5000)), round(rng.random() ** 3, 3)) for _ in range(12_000)]
    assert rows(top_n(frame(spark, data), "g", "item", "score", 10, F.expr(TIE), scratch)) == brute(data, 10)


def test_all_scores_equal(spark, scratch):
    data = [("g", str(i), 0.5) for i in range(200)]
    assert rows(top_n(frame(spark, data), "g", "item", "score", 10, F.expr(TIE), scratch)) == brute(data, 10)
