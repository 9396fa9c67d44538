import tracemalloc

import numpy as np
import pytest

from thesaurion.llm import queries
from thesaurion.llm import vectors as v


def cloud(n, dim=16, seed=0, topics=6):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(topics, dim))
    x = base[rng.integers(topics, size=n)] + 0.7 * rng.normal(size=(n, dim))
    return (x * rng.lognormal(size=(n, 1))).astype(np.float32)


def exact(x, k):
    u = v.unit(x).astype(np.float64)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, 1)[:, :k], s


def frame(spark, x, names=None, extra=()):
    data = [(str(n), [float(e) for e in row], 1) for n, row in zip(range(len(x)) if names is None else names, x)]
    return spark.createDataFrame([*data, *extra], "cid string, vector array<float>, name int")


def test_graph_recall():
    x = cloud(3000)
    true, _ = exact(x, 5)
    g = v.Graph(v.unit(x))
    ids, _ = g.search(v.unit(x), 32)
    assert np.mean([len(set(i[:6]) & set(t)) / 5 for i, t in zip(ids, true)]) > 0.95
    assert g.deg.max() <= v.DEGREE + v.SLACK


def plain_search(g, q, beam):
    """Ids of the beam for one query, vector by vector."""
    met, sim = set(g.entry.tolist()), g.x.astype(np.float64) @ q
    kept, fresh = sorted(met, key=lambda i: -sim[i])[:beam], set(met)
    while now := [i for i in kept if i in fresh][: v.WIDTH]:
        fresh -= set(now)
        new = {j for i in now for j in g.links[i].tolist() if j < len(g.x)} - met
        met |= new
        fresh |= new
        kept = sorted([*kept, *new], key=lambda i: -sim[i])[:beam]
    return kept


def test_search_takes_similarities_by_block(monkeypatch):
    """Same beams as following the links one by one, but no vector is read link by link: that took most of p4_found."""
    x = cloud(1500, seed=9)
    g, q = v.Graph(v.unit(x)), v.unit(cloud(40, seed=9) + 0.1)
    monkeypatch.setattr(np, "einsum", lambda *_, **__: pytest.fail("similarities of single links"))
    for beam in (3, 24, 64):
        ids, sims = g.search(q, beam)
        assert [set(i) for i in ids.tolist()] == [set(plain_search(g, one, beam)) for one in q]  # rounding may swap equal ones
        assert (np.diff(sims) <= 0).all() and np.allclose(sims, np.take_along_axis(q @ g.x.T, ids, 1), atol=1e-6)
    monkeypatch.setattr(v, "TABLE", 7 * 1501)  # blocks of seven queries and a rest
    again, _ = g.search(q, 64)
    near, _ = g.search(g.x[:40], 24, np.arange(40))
    assert [set(i) for i in again.tolist()] == [set(i) for i in ids.tolist()] and near[:, 0].tolist() == list(range(40))


def test_memory_of_a_search_is_bounded():
    """Whatever the size of the shard: flags of all its vectors for all queries would be 250 MB here."""
    n, rng = 100_000, np.random.default_rng(2)
    g = v.Graph.__new__(v.Graph)
    g.x, g.entry, g.done = v.unit(rng.normal(size=(n, 4))), np.arange(16, dtype=np.int32), n
    g.links = rng.integers(n, size=(n + 1, v.DEGREE + v.SLACK), dtype=np.int32)
    g.links[n] = n
    tracemalloc.start()
    ids, _ = g.search(g.x[:512], 24)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids.shape == (512, 24) and peak < 60e6


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_small_graphs_are_exact(n):
    x = cloud(n)
    g = v.Graph(v.unit(x))
    ids, _ = g.search(v.unit(x), 48)
    assert all(set(row[row >= 0]) == set(range(n)) for row in ids)


@pytest.mark.parametrize("shard", [400, 3000])
def test_recall_over_shards(spark, scratch, monkeypatch, shard):
    monkeypatch.setattr(v, "SHARD", shard)
    x = cloud(4000, seed=3)
    true, _ = exact(x, 5)
    found = v.similar(v.usable(frame(spark, x), "cid", "vector", 16), 5, 16, scratch).toPandas()
    got = found.groupby("a").b.apply(set)
    assert np.mean([len(got.get(i, set()) & set(t)) / 5 for i, t in enumerate(true)]) >= 0.9
    assert found.groupby("a").rnk.max().max() <= 5


def test_hot_shard_is_divided(spark, scratch, monkeypatch):
    monkeypatch.setattr(v, "SHARD", 300)
    monkeypatch.setattr(v, "MOST", 350)
    x = cloud(2000, seed=4, topics=1)
    true, _ = exact(x, 5)
    got = v.similar(v.usable(frame(spark, x), "cid", "vector", 16), 5, 16, scratch).toPandas().groupby("a").b.apply(set)
    assert np.mean([len(got.get(i, set()) & set(t)) / 5 for i, t in enumerate(true)]) >= 0.9


def test_tree_of_cells_and_parts(spark, scratch, monkeypatch):
    """Cells divided more than once, shards asked by more than one task answers."""
    monkeypatch.setattr(v, "SHARD", 200)
    monkeypatch.setattr(v, "MOST", 300)
    monkeypatch.setattr(v, "FAN", 4)
    monkeypatch.setattr(v, "ASKED", 100)
    x = cloud(3000, seed=6)
    u = v.usable(frame(spark, x), "cid", "vector", 16).persist()
    tree, sizes = v.grown_tree(u, 3000, 4, 0.2, 16)
    assert any(c.cells for c in tree.cells) and max(n for n, _ in sizes.values()) <= 300 and sum(n for n, _ in sizes.values()) == 3000
    assert max(asked for _, asked in sizes.values()) > 200
    true, _ = exact(x, 5)
    found = v.similar(u, 5, 16, scratch).toPandas()
    got = found.groupby("a").b.apply(set)
    assert np.mean([len(got.get(i, set()) & set(t)) / 5 for i, t in enumerate(true)]) >= 0.9
    assert not found.duplicated(["a", "b"]).any()


def test_very_many_copies(spark, scratch, monkeypatch):
    monkeypatch.setattr(v, "SHARD", 200)
    monkeypatch.setattr(v, "MOST", 300)
    x = cloud(900, seed=8)
    x[100:600] = x[100]  # more than a shard holds
    x[700] = x[701] = x[3]
    names = list(range(len(x)))
    names[899] = 150  # a name with a second vector
    found = v.similar(v.usable(frame(spark, x, names), "cid", "vector", 16), 5, 16, scratch).toPandas()
    got = found.groupby("a").b.apply(list)
    assert got[100] == [101, 102, 103, 104, 105] and got[103] == [100, 101, 102, 104, 105] and got[400] == [100, 101, 102, 103, 104]
    assert set(got[3][:2]) == {700, 701} and got[700][:2] == [3, 701]
    assert got[150] == [100, 101, 102, 103, 104] and set(got.index) == set(names)
    _, s = exact(x, 5)
    alone = [i for i in range(900) if not 100 <= i < 600 and i not in (899, 3, 700, 701)]
    hits = [np.mean([s[i, b] >= np.sort(s[i])[-5] - 1e-6 for b in got[i]]) for i in alone]
    assert np.mean(hits) >= 0.9


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_neighbours_of_the_tables(spark, sf):
    """Recall of p4_neighbours against brute force, for all ids divisible by 50; p4_found has nearly all pairs."""
    at = f"/root/testdata/sf{sf}"
    rows = v.usable(spark.read.parquet(f"{at}/embedding_record.parquet"), "concept_id", "vector", 64).toPandas().drop_duplicates("name")
    names, x = rows.name.to_numpy(), v.unit(np.array(rows.vec.tolist(), np.float32))
    got = queries.p4_neighbours(spark, at).where("concept_id % 50 = 0").toPandas().groupby("concept_id").neighbour_id.apply(set)
    hits, pairs = [], set()
    for i in np.flatnonzero(names % 50 == 0):
        s = x @ x[i]
        s[i] = -2
        best = np.argsort(-s)[:5]
        hits.append(len(got.get(names[i], set()) & set(names[best].tolist())) / 5)
        pairs |= {(min(names[i], names[j]), max(names[i], names[j])) for j in best if s[j] >= 0.9001}
    assert np.mean(hits) >= 0.9
    if sf == "0.1":
        found = set(map(tuple, queries.p4_found(spark, at).toPandas().to_numpy().tolist()))
        assert len(found & pairs) >= 0.98 * len(pairs) > 0


def test_near_copies(spark, scratch):
    x = cloud(2000, seed=5)
    x[1::50] = x[::50] * 3 + 0.01
    _, s = exact(x, 5)
    want = {(i, j) for i in range(len(x)) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.97}
    found = v.similar(v.usable(frame(spark, x), "cid", "vector", 16), 5, 16, scratch, floor=0.97, beam=12, probes=3, gap=0.12).toPandas()
    got = set(zip(found.a, found.b))
    assert got <= want and len(got) >= 0.98 * len(want)


def test_unusable_and_repeated(spark, scratch):
    x = cloud(30)
    bad = [("90", None, 1), ("91", [1.0] * 15, 1), ("92", [0.0] * 16, 1), ("93", [float("nan")] + [1.0] * 15, 1), ("94", [None] + [1.0] * 15, 1), ("95", [float("inf")] + [1.0] * 15, 1), (None, [1.0] * 16, 1), ("x", [1.0] * 16, 1)]
    again = [("3", [float(e) for e in x[3]], 1), ("4", [float(e) for e in x[5]], 1)]
    u = v.usable(frame(spark, x, extra=[*bad, *again]), "cid", "vector", 16)
    assert {r["name"] for r in u.collect()} == set(range(30))
    found = v.similar(u, 5, 16, scratch).toPandas()
    assert (found.a != found.b).all() and not found.duplicated(["a", "b"]).any()
    assert found[(found.a == 4) & (found.rnk == 1)].b.item() == 5
    assert v.similar(u.limit(0), 5, 16, scratch).count() == 0


def test_p4_found_searches_with_the_whole_beam(monkeypatch):
    """Half the beam lost pairs on the tables ten times sf0.1; small tables do not show it."""
    asked = {}

    def stop(*_, **given):
        asked.update(given)
        raise StopIteration

    for name, f in {"table": lambda *_: None, "usable": lambda *_: None, "Scratch": lambda *_: None, "similar": stop}.items():
        monkeypatch.setattr(queries, name, f)
    with pytest.raises(StopIteration):
        queries.p4_found(None, "")
    assert asked["beam"] >= 24
