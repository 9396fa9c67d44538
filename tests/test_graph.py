"""Hierarchy, path, retrieval and similarity operators on hand-made graphs with known answers."""

import pytest
from conftest import rows

from thesaurion.operators import export, graph, paths, retrieval
from thesaurion.operators import similarity as sim
from thesaurion.schema import edges as canonical

DIAMOND = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d")]
ANN = [("d", "x"), ("e", "y"), ("c", "x")]


@pytest.fixture(scope="module")
def diamond(spark):
    return canonical(spark.createDataFrame([("t", a, "t", b, "is_a") for a, b in DIAMOND], "prefix_from string, id_from string, prefix_to string, id_to string, rel_type string"))


@pytest.fixture(scope="module")
def ids(spark):
    return spark.createDataFrame([("t", x) for x in "abcde"] + [("t", "unknown")], "prefix string, concept_id string")


def lists(df):
    return {r["concept_id"]: r["related"] for r in df.collect()}


def test_expand(spark, scratch, diamond, ids):
    assert lists(graph.related(diamond, ids, scratch)) == {"a": list("bcde"), "b": ["d", "e"], "c": ["d", "e"], "d": ["e"], "e": []}
    assert lists(graph.related(diamond, ids, scratch, depth=1)) == {"a": ["b", "c"], "b": ["d"], "c": ["d"], "d": ["e"]}
    assert lists(graph.related(diamond, ids, scratch, limit=1))["a"] == ["b"]
    up = lists(graph.related(diamond, ids, scratch, up=True))
    assert up == {"a": [], "b": ["a"], "c": ["a"], "d": ["a", "b", "c"], "e": ["a", "b", "c", "d"]}
    assert lists(graph.related(diamond, ids, scratch, up=True, depth=1, both_ways=True))["d"] == ["b", "c", "e"]


def test_expand_tolerates_loops(spark, scratch, ids):
    e = canonical(spark.createDataFrame([("t", "a", "t", "b", "is_a"), ("t", "b", "t", "a", "part_of")], "prefix_from string, id_from string, prefix_to string, id_to string, rel_type string"))
    assert lists(graph.related(e, ids, scratch))["a"] == ["b"]


def test_replacement(spark, diamond, ids):
    e = diamond.unionByName(canonical(spark.createDataFrame([("t", "z", "t", "a", "replaced_by")], "prefix_from string, id_from string, prefix_to string, id_to string, rel_type string")))
    got = {(r["concept_id"], r["related_id"]) for r in graph.replaced(e, ids).collect()}
    assert ("a", "z") in got and ("b", None) in got and not {x for x in got if x[0] == "unknown"}
    assert rows(graph.replacing(e, spark.createDataFrame([("t", "z")], ids.schema)).select("related_id")) == [("a",)]


def test_mapping(spark, scratch):
    data = [("p", "1", "q", "1", "exact"), ("q", "1", "r", "1", "exact"), ("p", "1", "r", "2", "annotated_with"), ("q", "1", "p", "2", "exact"), ("p", "2", "r", "3", "exact"), ("p", "1", "r", "9", "alias_symbol")]
    e = canonical(spark.createDataFrame(data, "prefix_from string, id_from string, prefix_to string, id_to string, rel_type string"))
    ask = spark.createDataFrame([("p", "1"), ("p", "77")], "prefix string, concept_id string")
    get = lambda n, **k: [(r["mapped_id"], r["hops"]) for r in sorted(paths.map_terms(e, ask, "r", scratch, n, **k).collect(), key=str)]
    assert sorted(get(1)) == [("2", 1)]
    assert sorted(get(2)) == sorted(get(3)) == [("1", 2), ("2", 1)]
    assert get(3, limit=1) == [("2", 1)]


def test_trace(spark, scratch, diamond):
    q = spark.createDataFrame([("1", "t", "d", "t", "a"), ("2", "t", "a", "t", "d")], "query_id string, prefix_start string, id_start string, prefix_end string, id_end string")
    get = lambda e, **k: sorted((r["query_id"], "".join(n[-1] for n in r["nodes"])) for r in paths.trace(e, q, scratch, "is_a", **k).collect())
    assert get(diamond) == [("1", "dba"), ("1", "dca")]
    assert get(diamond, forward=False) == [("2", "abd"), ("2", "acd")]
    short = diamond.unionByName(canonical(spark.createDataFrame([("t", "d", "t", "a", "is_a")], "prefix_from string, id_from string, prefix_to string, id_to string, rel_type string")))
    assert get(short) == [("1", "da")]
    both = paths.trace_undirected(diamond, spark.createDataFrame([("1", "t", "b", "t", "c")], q.schema), scratch).collect()
    assert [(r["length"], r["nodes"]) for r in both] == [(3, ["t:b", "t:a", "t:c"])]


@pytest.fixture(scope="module")
def fixture(spark):
    return spark.createDataFrame(DIAMOND, "child string, parent string"), spark.createDataFrame(ANN, "id string, corpus_id string")


def near(df, want, places=5):
    got = {tuple(r)[:-1]: tuple(r)[-1] for r in df.collect()}
    assert set(got) == set(want)
    assert all(abs(got[k] - v) < 10**-places for k, v in want.items()), got


def test_roll_up_relevance_and_co_annotation(spark, scratch, fixture):
    links, ann = fixture
    rolled = sim.roll_up(links, ann.groupBy("id").count().toDF("id", "w"), scratch)
    near(rolled, {("a",): 5, ("b",): 2, ("c",): 3, ("d",): 2, ("e",): 1})
    near(sim.information_content(rolled).select("id", "ic"), {("a",): 0, ("b",): 0.916291, ("c",): 0.510826, ("d",): 0.916291, ("e",): 1.609438})
    near(sim.relevance(links, ann, scratch), {("b", "d"): 0.6, ("b", "e"): 0.435339, ("c", "d"): 0.286354, ("d", "e"): 0.435339})
    want = {(x, y): 1.0 for i, x in enumerate("abcd") for y in "abcd"[i + 1 :]} | {(x, "e"): 0.25 for x in "abcd"}
    near(sim.co_annotation(links, ann, scratch), want)
    with pytest.raises(ValueError):
        sim.co_annotation(links, ann, scratch, 0)


def test_weighted(spark, scratch, fixture):
    links, ann = fixture
    none = links.limit(0)
    t, c = sim.weighted_content(links, none, ann, scratch)
    near(t.select("id", "n"), {("a",): 5.313006, ("b",): 2.156503, ("c",): 3.156503, ("d",): 2.156503, ("e",): 1.156503}, 2)
    near(c.select("id", "ic"), {("x",): 0, ("y",): 0.290888}, 2)


def test_loop_is_an_error(spark, scratch):
    links = spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string")
    with pytest.raises(sim.CycleError):
        sim.roll_up(links, spark.createDataFrame([("a", 1)], "id string, w int"), scratch)


def test_similarity_retrieval(spark):
    s = spark.createDataFrame([("p", "1", "p", "2", "relevance:x", 0.9), ("p", "1", "p", "2", "co-annotation:y", 0.4), ("p", "1", "p", "3", "relevance:x", 0.5)], "prefix_from string, id_from string, prefix_to string, id_to string, score_key string, score double")
    ask = lambda *i: spark.createDataFrame([("p", x) for x in i], "prefix string, concept_id string")
    q = spark.createDataFrame([("p", "1", 0.45), ("p", "3", 0.1)], "prefix string, concept_id string, threshold double")
    assert rows(retrieval.similar_best(s, q).select("concept_id", "neighbour_id", "best")) == [("1", "2", 0.9), ("1", "3", 0.5), ("3", "1", 0.5)]
    full = lambda **k: rows(retrieval.similar_full(s, ask("1"), **k).select("neighbour_id", "score_key", "score"))
    assert full(threshold=0.3, method="co-annotation") == [("2", "co-annotation:y", 0.4)]
    assert full(threshold=0.3, limit=1) == [("2", "co-annotation:y", 0.4), ("2", "relevance:x", 0.9)]
    assert full(threshold=0.3, corpus="x", method="relevance") == [("2", "relevance:x", 0.9), ("3", "relevance:x", 0.5)]
    groups = retrieval.similar_groups(retrieval.similar_full(s, ask("1"), threshold=0.3)).first()["similar"]
    assert [(x["concept_id"], x["scores"]) for x in groups] == [("2", {"relevance:x": 0.9, "co-annotation:y": 0.4}), ("3", {"relevance:x": 0.5})]
    assert rows(retrieval.translate(s, ask("1"), ask("3", "4"), 0.2).select("target_id", "score")) == [("3", 0.5)]
    saved = sim.save_scores(s, s.where("id_to = '3'").withColumn("score", s.score + 0.1))
    assert rows(saved.select("id_to", "score_key", "score"))[-1] == ("3", "relevance:x", 0.6)


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0]), (7, [float("nan"), 1.0])], "concept_id long, vector array<float>")
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None)], "query_id string, vector array<float>")
    out = retrieval.vector_top_k(v, q, 3).orderBy("rank").collect()
    assert [(r["query_id"], r["concept_id"]) for r in out] == [("a", 1), ("a", 2), ("a", 3)]
    assert retrieval.vector_top_k(v, q.limit(0), 3).count() == 0
    e = retrieval.hashed_embedding(spark.createDataFrame([("some words",), ("",), (None,)], "t string"), "t", 8).collect()
    assert abs(sum(x * x for x in e[0]["vector"]) - 1) < 1e-6 and e[1]["vector"] == e[2]["vector"] == [0.0] * 8


def test_exports(spark, scratch, diamond):
    nodes = export.export_nodes(diamond, scratch)
    assert rows(nodes.select("nid", "concept_id")) == list(enumerate("abcde"))
    e = export.export_edges(diamond, nodes)
    c = {r["nid"]: (r["degree"], r["start"]) for r in export.csr(e, nodes, scratch).collect()}
    assert c == {0: (2, 0), 1: (2, 2), 2: (2, 4), 3: (3, 6), 4: (1, 9)}
    walks = export.random_walks(e, scratch, 3).collect()
    assert len(walks) == 5 and all(len(r["tokens"]) == 7 for r in walks)
    grams = export.skip_grams(spark.createDataFrame([(1, list("abcd"))], "k int, t array<string>"), "k", "t", 1)
    assert rows(grams.select("centre", "context")) == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "c")]
    vec = spark.createDataFrame([("t", "b"), ("t", "d"), ("t", "e"), ("t", "q")], "prefix string, concept_id string")
    kept, left = export.with_embedding(nodes, e, vec, scratch)
    assert rows(kept.select("nid", "concept_id")) == [(0, "b"), (1, "d"), (2, "e")] and rows(left.select("src", "dst")) == [(1, 0), (2, 1)]
