import random

import pytest

from thesaurion.operators import hierarchy
from thesaurion.operators.hierarchy import hierarchies, loops_of, paths, rank
from thesaurion.plans.problems import named_links, node_pairs, node_paths

LINKS, NODES = "hier string, parent string, child string", "hier string, node string"


def brute(links, nodes):
    links = {(a, b) for a, b in links if a and b}
    names = {x for x in nodes if x} | {x for e in links for x in e}
    kids, parents = {}, {}
    for a, b in links:
        kids.setdefault(a, set()).add(b)
        parents.setdefault(b, set()).add(a)

    def below(x):
        seen, todo = set(), [x]
        while todo:
            for y in kids.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    out = {x: ("", -1, int(x in below(x))) for x in names}
    for r in sorted(x for x in names if x not in parents):
        front, level = {r}, 0
        seen = {r}
        while front:
            for x in front:
                out[x] = (r, level, out[x][2])
            front = {y for x in front for y in kids.get(x, ())} - seen
            seen |= front
            level += 1
    return out


def run(spark, scratch, links, nodes=(), **k):
    tree = hierarchies(spark.createDataFrame([("h", a, b) for a, b in links], LINKS), spark.createDataFrame([("h", x) for x in nodes], NODES), scratch, **k)
    return tree, {r["node"]: (r["root_id"], r["lvl"], r["on_cycle"]) for r in tree.collect()}


CASES = {
    "empty": ([], []),
    "alone": ([], ["a", None]),
    "self loop": ([("a", "a"), ("a", "b")], []),
    "self loop under a root": ([("r", "a"), ("a", "a"), ("a", "b")], []),
    "loop with an entrance": ([("r", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], []),
    "loop without": ([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")], []),
    "bridge between loops": ([("a", "b"), ("b", "a"), ("b", "m"), ("m", "c"), ("c", "d"), ("d", "c")], []),
    "several parents": ([("r", "a"), ("a", "b"), ("b", "c"), ("r", "c"), ("c", "d"), ("b", "d"), ("r", "a"), (None, "r"), ("d", None)], ["z"]),
    "chain": ([(f"n{i:03}", f"n{i + 1:03}") for i in range(60)], []),
    "star": ([("r", f"c{i}") for i in range(40)], []),
}


@pytest.mark.parametrize("core_links", [20_000, 0])
def test_cases(spark, scratch, core_links):
    """All cases as hierarchies of one call."""
    links = spark.createDataFrame([(h, a, b) for h, (ls, _) in CASES.items() for a, b in ls], LINKS)
    nodes = spark.createDataFrame([(h, x) for h, (_, ns) in CASES.items() for x in ns], NODES)
    got = {(r["hier"], r["node"]): (r["root_id"], r["lvl"], r["on_cycle"]) for r in hierarchies(links, nodes, scratch, core_links=core_links).collect()}
    assert got == {(h, x): v for h, case in CASES.items() for x, v in brute(*case).items()}


def test_empty(spark, scratch):
    assert run(spark, scratch, [])[1] == {}


def test_random_graphs(spark, scratch, monkeypatch):
    monkeypatch.setattr(hierarchy, "CHUNK", 3)
    rng = random.Random(5)
    links = [(f"r{min(i // 50, i % 7)}-{rng.randrange(i)}" if rng.random() < 0.8 else f"x{rng.randrange(20)}", f"r{0}-{i}" if rng.random() < 0.1 else f"y{i}") for i in range(1, 300)]
    # one root per node: keep trees apart by giving each child one parent, then close some loops
    parent = {}
    for a, b in links:
        parent.setdefault(b, a)
    links = [(a, b) for b, a in parent.items()] + [(f"y{i}", f"x{i % 20}") for i in range(0, 40, 4)]
    got = run(spark, scratch, links)[1]
    want = brute(links, [])
    assert {k: (v[1] >= 0, v[2]) for k, v in got.items()} == {k: (v[1] >= 0, v[2]) for k, v in want.items()}
    assert all(got[k][1] == want[k][1] for k in want if sum(1 for a, b in links if b == k) < 2 and want[k][0] == got[k][0])


def test_intervals_and_paths(spark, scratch):
    links = [("r", "a"), ("r", "b"), ("a", "c"), ("c", "d"), ("b", "e")]
    tree, _ = run(spark, scratch, links)
    t = {r["node"]: r for r in tree.collect()}
    inside = {(x, y) for x in t for y in t if x != y and t[x]["tin"] < t[y]["tin"] and t[y]["tout"] < t[x]["tout"]}
    assert inside == {("r", x) for x in "abcde"} | {("a", "c"), ("a", "d"), ("c", "d"), ("b", "e")}
    assert {x: r["size"] for x, r in t.items()} == {"r": 6, "a": 3, "b": 2, "c": 2, "d": 1, "e": 1}
    name = {r["nid"]: x for x, r in t.items()}
    for span in (None, 3, 1):
        assert {name[r["nid"]]: r["path"] for r in paths(tree, span).collect()}["d"] == ["r", "a", "c", "d"]


def test_lists_are_ranked_alike_by_one_task_and_by_many(spark, scratch):
    rng = random.Random(2)
    e = rng.sample(range(10_000), 900)
    ends = {e[99], e[100], e[899]}  # lists of 100, 1 and 799 elements
    rows = [(x, None if x in ends else e[i + 1], rng.randrange(5), rng.randrange(-3, 3)) for i, x in enumerate(e)]
    want, after = {}, None
    for x, nx, cnt, total in reversed(rows):
        after = (x, x, cnt, total) if nx is None else (x, after[1], after[2] + cnt, after[3] + total)
        want[x] = after
    df = spark.createDataFrame(rows, "e long, nx long, cnt long, sum long")
    for most in (10_000, 400, 20):
        assert sorted(tuple(r) for r in rank(df, scratch, most).collect()) == sorted(want.values())
    assert rank(df.limit(0), scratch).count() == 0


def test_ladder(spark, scratch, monkeypatch):
    """Every rung has a deep parent of least number and a shallow one; both ways of settling the depths."""
    monkeypatch.setattr(hierarchy, "RANKED", 30)
    links = [("a00", "s00"), *[(f"a{i:02}", f"a{i + 1:02}") for i in range(40)], *[(f"s{i:02}", f"s{i + 1:02}") for i in range(25)], *[("a40", f"s{i:02}") for i in range(1, 26)]]
    want = brute(links, [])
    assert want["s25"] == ("a00", 26, 0)
    for core in (20_000, 0):
        assert run(spark, scratch, links, core_links=core)[1] == want


def test_deep_chain_and_wide_star(spark, scratch, monkeypatch):
    monkeypatch.setattr(hierarchy, "CHUNK", 7)
    monkeypatch.setattr(hierarchy, "RANKED", 500)
    links = [(f"c{i:04}", f"c{i + 1:04}") for i in range(700)] + [("c0350", f"l{i}") for i in range(300)]
    tree, got = run(spark, scratch, links)
    assert got == brute(links, [])
    t = [(r["tin"], r["tout"], r["size"]) for r in tree.collect()]
    assert sorted(x for a, b, _ in t for x in (a, b)) == list(range(2 * len(t))) and all(b - a == 2 * n - 1 for a, b, n in t)
    assert {len(r["path"]) for r in paths(tree, 100).collect()} == set(range(1, 702))


def test_loops_of():
    assert sorted(loops_of([(1, 2), (2, 1), (3, 3), (4, 5)])) == [(1, 1), (2, 1), (3, 3)]
    chain = [(i, i + 1) for i in range(50_000)]
    assert loops_of(chain) == []
    assert len(loops_of([*chain, (50_000, 0)])) == 50_001


def distances(links):
    """(ancestor, descendant) -> least number of links, by breadth-first search from every node."""
    kids = {}
    for a, b in links:
        if a and b:
            kids.setdefault(a, set()).add(b)
    out = {}
    for x in kids:
        front, seen, d = {x}, {x}, 0
        while front:
            front, d = {z for y in front for z in kids.get(y, ())} - seen, d + 1
            seen |= front
            out |= {(x, y): d for y in front}
    return out


def test_descendants_over_all_parents_and_loops(spark, scratch):
    rng = random.Random(3)
    dag = [(f"d{i}", f"d{j}") for j in range(1, 40) for i in rng.sample(range(j), min(j, rng.choice([1, 1, 2, 3])))]
    cases = {**CASES, "dag with a loop": ([*dag, ("d30", "d5"), ("q", "q"), ("q", "d7"), ("e1", "e2"), ("e2", "e1"), ("e2", "d20")], ["alone"])}
    links = spark.createDataFrame([(h, a, b) for h, (ls, _) in cases.items() for a, b in ls], LINKS)
    nodes = spark.createDataFrame([(h, x) for h, (_, ns) in cases.items() for x in ns], NODES)
    want = {(h, *k): d for h, (ls, _) in cases.items() for k, d in distances(ls).items()}
    got = [(r["hier"], r["node_id"], r["descendant_id"], r["distance"]) for r in node_pairs(links, nodes, scratch).collect()]
    assert len(got) == len(want) and {r[:3]: r[3] for r in got} == want
    tree = scratch.cut(hierarchies(links, nodes, scratch))
    rows = node_paths(tree, named_links(tree, links, scratch), scratch).collect()
    assert {(r["hier"], r["node_id"]) for r in rows} == {(h, x) for h, case in cases.items() for x in brute(*case)} and len(rows) == tree.count()
    assert all(r["n_descendants"] == sum(1 for k in want if k[:2] == (r["hier"], r["node_id"])) for r in rows)
    assert all((r["path"] == "") == (r["lvl"] == -1) and (r["lvl"] == -1 or r["path"].count(">") == r["lvl"]) for r in rows)
