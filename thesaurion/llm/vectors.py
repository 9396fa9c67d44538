"""Problem 4: the most similar vectors of every vector, by a robust-pruned directed graph per shard.

Vectors go to the shard of their nearest centroid. Centroids form a tree: a cell with too many vectors is divided by
spherical k-means on a bounded sample of its own, again and again, so that dense topics get shards of the same size as
thin ones. Each shard builds one directed graph: vectors are inserted in growing batches, a greedy beam search over the
graph so far proposes neighbours, and relaxed distance pruning keeps those that are not better reached through a kept
one. Then beam search answers the queries of the shard: its own vectors, and those of other shards for whom it is among
the next nearest; a shard that very many ask is answered by several tasks with a part of the queries each.
Only copies cannot be divided: where a cell stays too large, equal vectors are made one and their names added at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from thesaurion.runtime import Scratch, keyed_join

SAMPLE = 20_000  #: vectors of a cell, about, on which its centroids are fitted, chosen by a hash of their name
SHARD = 3_000  #: vectors per shard aimed at
MOST = 2 * SHARD  #: a shard beyond this is divided
FAN = 256  #: cells that a cell is divided into at most
LEAVES = 1 << 18  #: shards at most, hence centroids that a task holds; with more vectors shards are larger
ASKED = 8 * SHARD  #: queries from other shards that one task answers
DEGREE = 20  #: links kept of a vector by pruning
SLACK = 12  #: links more that may be added from the other side before it is pruned again
BEAM = 32  #: length of the beam while building
ALPHA = 1.2  #: relaxation of the pruning rule
MATES = 10  #: vectors inserted at the same time that are proposed besides those of the graph
WIDTH = 4  #: vectors of the beam that are expanded together
PROBES, GAP = 4, 0.2  #: the nearest shards asked for a query, those whose centroid is at most so much less similar than the nearest
TABLE = 1 << 22  #: similarities held at a time while searching; 512 queries of a shard of up to 8,191
_BATCH = 512


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def centroids(sample: np.ndarray, n: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means; empty clusters take a random vector."""
    rng = np.random.default_rng(seed)
    n = max(1, min(n, len(sample)))
    c = sample[rng.choice(len(sample), n, replace=False)]
    for _ in range(rounds if n > 1 else 1):
        own = (sample @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        size = np.linalg.norm(total, axis=1)
        empty = size < 1e-6
        total[empty] = sample[rng.choice(len(sample), empty.sum())]
        c = unit(total)
    return c


@dataclass
class Cell:
    """A node of the tree of centroids; a leaf is a shard and has a number."""

    shard: int = -1
    centroids: np.ndarray | None = None
    cells: list[Cell] = field(default_factory=list)

    def leaves(self) -> list[Cell]:
        return [x for c in self.cells for x in c.leaves()] if self.cells else [self]

    def route(self, q: np.ndarray, probes: int, gap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, rank) of the shards each row of q asks: the `probes` nearest by their centroids, those at most `gap`
        less similar than the nearest; rank 0 is the nearest. Of the inner cells twice as many are entered."""
        row, shard, sim = self._nearest(q, np.arange(len(q)), np.ones(len(q), np.float32), 2 * probes)
        order = np.lexsort((shard, -sim, row))
        row, shard, sim = row[order], shard[order], sim[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.array([], int)
        size = np.diff(np.r_[first, len(row)])
        rank = np.arange(len(row)) - np.repeat(first, size)
        keep = (rank == 0) | ((rank < probes) & (sim >= np.repeat(sim[first], size) - gap))
        return row[keep], shard[keep], rank[keep]

    def _nearest(self, q: np.ndarray, rows: np.ndarray, sim: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.cells:
            return rows, np.full(len(rows), self.shard), sim
        s = q[rows] @ self.centroids.T
        few = min(most, s.shape[1])
        best = np.argpartition(-s, few - 1, 1)[:, :few]
        top = np.take_along_axis(s, best, 1)
        if not any(c.cells for c in self.cells):
            return np.repeat(rows, few), np.array([c.shard for c in self.cells])[best].ravel(), top.ravel()
        parts = []
        for j, c in enumerate(self.cells):
            r, at = np.nonzero(best == j)
            if len(r):
                parts.append(c._nearest(q, rows[r], top[r, at], most))
        return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))


class Graph:
    """A robust-pruned directed graph over unit vectors."""

    def __init__(self, x: np.ndarray):
        self.x = x
        n = len(x)
        self.links = np.full((n + 1, DEGREE + SLACK), n, np.int32)  # n stands for no link; row n has none
        self.deg = np.zeros(n, np.int32)
        self.entry = np.zeros(1, np.int32)
        self.done = n  # vectors inserted so far, from the first
        self._build()

    def _build(self) -> None:
        n = len(self.x)
        first = min(n, BEAM)
        sims = self.x[:first] @ self.x[:first].T
        order = np.argsort(-sims, 1)
        others = order[order != np.arange(first)[:, None]].reshape(first, first - 1) if first > 1 else np.zeros((first, 0), int)
        self._connect(np.arange(first), others, np.take_along_axis(sims, others, 1))
        done = first
        while done < n:
            # entries spread over what is there, so that no topic is out of reach
            self.entry = np.unique(np.linspace(0, done - 1, min(done, 16)).astype(np.int32))
            batch = np.arange(done, min(n, done + max(BEAM, min(done, _BATCH))))
            self.done = done
            ids, sims = self._with_mates(batch, *self.search(self.x[batch], BEAM))
            self._connect(batch, ids, sims)
            self._backward(batch)
            done = batch[-1] + 1
        self.entry = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int32))
        self.done = n

    def _with_mates(self, batch: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proposals from the graph and from vectors inserted at the same time, best first."""
        among = self.x[batch] @ self.x[batch].T
        np.fill_diagonal(among, -2)
        few = min(MATES, len(batch) - 1)
        near = np.argpartition(-among, few, 1)[:, :few] if few else np.zeros((len(batch), 0), int)
        ids = np.concatenate([ids, batch[near]], 1)
        sims = np.concatenate([sims, np.take_along_axis(among, near, 1)], 1)
        order = np.argsort(-sims, 1)[:, :BEAM]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, q: np.ndarray, beam: int, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Beam search for each row of q: (ids, sims) of the beam, best first; id -1 where fewer were met."""
        m, n = len(q), len(self.x)
        most = max(1, TABLE // (n + 1))
        if m > most:
            parts = [self.search(q[lo : lo + most], beam, None if start is None else start[lo : lo + most]) for lo in range(0, m, most)]
            return np.concatenate([i for i, _ in parts]), np.concatenate([s for _, s in parts])
        entry = np.broadcast_to(self.entry, (m, len(self.entry))) if start is None else start[:, None]
        # one matrix product gives what following the links would read vector by vector, about 500 a query; a place that was
        # met, and n, which stands for no vector, get less than any similarity
        table = np.empty((m, n + 1), np.float32)
        np.matmul(q, self.x[: self.done].T, out=table[:, : self.done])
        table[:, n] = -3
        left = table.ravel()
        base = (np.arange(m) * (n + 1))[:, None]
        ids = np.full((m, beam), n, np.int32)
        sims = np.full((m, beam), -2, np.float32)
        first = min(beam, entry.shape[1])
        s = left[base + entry]
        left[base + entry] = -3
        top = np.argsort(-s, 1)[:, :first]
        ids[:, :first], sims[:, :first] = np.take_along_axis(entry, top, 1), np.take_along_axis(s, top, 1)
        fresh = ids < n
        out_i, out_s = ids, sims
        live = np.arange(m)  # queries that still have something to expand; ids, sims, fresh hold these only
        while True:
            go = fresh.any(1)
            if not go.all():
                out_i[live], out_s[live] = ids, sims
                live, ids, sims, fresh = live[go], ids[go], sims[go], fresh[go]
                if not len(live):
                    break
            elif ids is out_i:
                ids, sims = ids.copy(), sims.copy()
            row = np.arange(len(live))[:, None]
            pick = np.argpartition(np.where(fresh, -sims, 3), WIDTH - 1, 1)[:, :WIDTH] if beam > WIDTH else np.broadcast_to(np.arange(beam), (len(live), beam))
            pick = pick + row * beam
            node = np.where(np.take(fresh, pick), np.take(ids, pick), n)
            fresh.ravel()[pick] = False
            near = np.take(self.links, node, 0).reshape(len(live), -1)
            code = base[live] + near
            got = np.take(left, code)
            # the worst of a beam only gets better, so what is no better now never enters and need not be marked
            good = np.flatnonzero(got > sims.min(1)[:, None])
            code, at, got = code.ravel()[good], near.ravel()[good], got.ravel()[good]
            mark = -3 - np.arange(len(good), dtype=np.float32)
            left[code] = mark
            once = left[code] == mark  # one of equal ones is kept
            r, at, got = good[once] // near.shape[1], at[once], got[once]
            if not len(r):
                continue
            count = np.bincount(r, minlength=len(live))
            width = beam + count.max()
            place = beam + np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
            all_i = np.full((len(live), width), n, np.int32)
            all_s = np.full((len(live), width), -2, np.float32)
            all_f = np.zeros((len(live), width), bool)
            all_i[:, :beam], all_s[:, :beam], all_f[:, :beam] = ids, sims, fresh
            place += r * width
            all_i.ravel()[place], all_s.ravel()[place], all_f.ravel()[place] = at, got, True
            top = np.argpartition(-all_s, beam - 1, 1)[:, :beam] + row * width
            ids, sims, fresh = np.take(all_i, top), np.take(all_s, top), np.take(all_f, top)
        order = np.argsort(-out_s, 1)
        ids, sims = np.take_along_axis(out_i, order, 1), np.take_along_axis(out_s, order, 1)
        return np.where(ids == n, -1, ids), sims

    def _pruned(self, ids: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Kept candidates of each row, best first: one is dropped if ALPHA times its distance to a kept one is at most
        its distance to the vector. Distances are Euclidean, so squares carry ALPHA squared."""
        m, k = ids.shape
        if not k:
            return ids, np.zeros((m, 0), bool)
        v = self.x[np.maximum(ids, 0)]
        far = np.matmul(v, v.transpose(0, 2, 1))
        far *= -2
        far += 2
        far *= ALPHA**2
        reached = far <= (2 - 2 * sims)[:, None]
        alive = ids >= 0
        kept = np.zeros((m, k), bool)
        left = np.full(m, DEGREE)
        for j in range(k):
            take = alive[:, j] & (left > 0)
            kept[:, j] = take
            left -= take
            alive &= ~(take[:, None] & reached[:, j])
        return ids, kept

    def _connect(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Set the links of nodes to their pruned candidates (best first)."""
        ids = np.where(ids == nodes[:, None], -1, ids)
        ids, kept = self._pruned(ids, sims)
        row, col = np.nonzero(kept)
        count = np.bincount(row, minlength=len(nodes))
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        self.links[nodes] = len(self.x)
        self.links[nodes[row], place] = ids[row, col]
        self.deg[nodes] = count

    def _backward(self, batch: np.ndarray) -> None:
        """Add the links back to the batch; vectors with too many are pruned again over all of theirs."""
        to = self.links[batch]
        row, col = np.nonzero(to < len(self.x))
        tgt, src = to[row, col], batch[row]
        order = np.argsort(tgt, kind="stable")
        tgt, src = tgt[order], src[order]
        hit, first, count = np.unique(tgt, return_index=True, return_counts=True)
        cap = self.links.shape[1]
        place = np.arange(len(tgt)) - np.repeat(first, count) + np.repeat(self.deg[hit], count)
        fits = np.repeat(self.deg[hit] + count <= cap, count)
        self.links[tgt[fits], place[fits]] = src[fits]
        full = self.deg[hit] + count > cap
        self.deg[hit[~full]] += count[~full].astype(np.int32)
        if full.any():
            most = int((self.deg[hit[full]] + count[full]).max())
            for lo in range(0, int(full.sum()), _BATCH):
                some = hit[full][lo : lo + _BATCH]
                cand = np.full((len(some), most), -1, np.int32)
                cand[:, :cap] = np.where(self.links[some] < len(self.x), self.links[some], -1)
                for k, (f, c, t) in enumerate(zip(first[full][lo : lo + _BATCH], count[full][lo : lo + _BATCH], some)):
                    cand[k, self.deg[t] : self.deg[t] + c] = src[f : f + c]
                sims = np.where(cand >= 0, np.einsum("md,mkd->mk", self.x[some], self.x[np.maximum(cand, 0)]), -2)
                by = np.argsort(-sims, 1)[:, : 2 * cap]
                self._connect(some, np.take_along_axis(cand, by, 1), np.take_along_axis(sims, by, 1))


def shard_neighbours(names: np.ndarray, x: np.ndarray, home: np.ndarray, asks: np.ndarray, k: int, floor: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, neighbour, similarity) for the rows that ask against the home rows of one shard; similarities in double precision."""
    empty = (np.array([], names.dtype),) * 2 + (np.array([], np.float64),)
    own = np.flatnonzero(home)
    if not len(own):
        return empty
    own = own[np.random.default_rng(len(own)).permutation(len(own))]  # insertion in no order of the input
    graph = Graph(unit(x[own]))
    out = []
    place = np.full(len(x), -1)
    place[own] = np.arange(len(own))
    q = unit(x)
    for some in (own[asks[own]], np.flatnonzero(~home)):
        for lo in range(0, len(some), _BATCH):
            part = some[lo : lo + _BATCH]
            ids, _ = graph.search(q[part], beam, place[part] if home[part[0]] else None)
            r, c = np.nonzero(ids >= 0)
            a, b = part[r], own[ids[r, c]]
            real = names[a] != names[b]
            out.append((a[real], b[real]))
    if not out:
        return empty
    a, b = np.concatenate([p for p, _ in out]), np.concatenate([p for _, p in out])
    near = np.einsum("kd,kd->k", q[a], q[b]) >= floor - 1e-4
    a, b = a[near], b[near]
    u, v = x[a].astype(np.float64), x[b].astype(np.float64)
    s = np.einsum("kd,kd->k", u, v) / (np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1))
    good = s >= floor
    a, b, s = a[good], b[good], s[good]
    # a name may have several vectors: of each pair of names the best, then the k best neighbours of each name
    one, two = names[a], names[b]
    order = np.lexsort((-s, two, one))
    one, two, s = one[order], two[order], s[order]
    best = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])] if len(one) else np.array([], bool)
    one, two, s = one[best], two[best], s[best]
    order = np.lexsort((two, -s, one))
    one, two, s = one[order], two[order], s[order]
    starts = np.r_[True, one[1:] != one[:-1]] if len(one) else np.array([], bool)
    rank = np.arange(len(one)) - np.maximum.accumulate(np.where(starts, np.arange(len(one)), 0))
    return one[rank < k], two[rank < k], s[rank < k]


def _matrix(vec: pa.Array, dim: int) -> np.ndarray:
    return vec.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def usable(records: DataFrame, name: str, vector: str, dim: int) -> DataFrame:
    """(name long, vec) with dim finite components, not all zero; other vectors, and names that are no number, are none.
    Repeats that are read together count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), dim)
            keep = np.flatnonzero(np.isfinite(x).all(1) & (x != 0).any(1))
            keep = keep[first_of(b.column(0).to_numpy()[keep], x[keep])]
            yield b.take(pa.array(keep))

    rows = records.select(F.expr(f"try_cast(`{name}` as bigint)").alias("name"), F.col(vector).cast("array<float>").alias("vec"))
    rows = rows.where((F.size("vec") == dim) & F.col("name").isNotNull()).where(~F.exists("vec", lambda e: e.isNull()))
    return rows.mapInArrow(run, "name long, vec array<float>")


def first_of(names: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of the first of each (name, vector)."""
    code = np.ascontiguousarray(np.hstack([names.astype(np.int64)[:, None].view(np.uint8), np.ascontiguousarray(x, np.float32).view(np.uint8)]))
    return np.sort(np.unique(code.view(np.dtype((np.void, code.shape[1]))).ravel(), return_index=True)[1]) if len(code) else np.array([], int)


def _fitted(vectors: DataFrame, tree: Cell, large: dict[int, int], shard: int, dim: int) -> dict[int, np.ndarray]:
    """Centroids of each shard of `large` (with its number of vectors), fitted by one task on about SAMPLE of its vectors."""
    rate = {k: -(-n // SAMPLE) for k, n in large.items()}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                row, at, _ = tree.route(unit(_matrix(b.column(1), dim)), 1, 0)
                keep = np.flatnonzero([x in rate and h % rate[x] == 0 for x, h in zip(at.tolist(), b.column(2).to_pylist())])
                yield pa.RecordBatch.from_arrays([pa.array(at[keep].astype(np.int32)), b.column(1).take(pa.array(row[keep]))], names=["shard", "vec"])

    def divide(key: tuple, t: pa.Table) -> pa.Table:
        x = np.concatenate([_matrix(c, dim) for c in t.column("vec").chunks])
        c = centroids(unit(x[np.lexsort(x.T)]), min(FAN, -(-large[key[0].as_py()] // shard)))
        return pa.table({"shard": pa.array([key[0].as_py()] * len(c), pa.int32()), "vec": pa.array(c.tolist(), pa.list_(pa.float32()))})

    some = vectors.withColumn("h", F.xxhash64("name", "vec").bitwiseAND(F.lit((1 << 62) - 1))).mapInArrow(pick, "shard int, vec array<float>")
    out: dict[int, list] = {}
    for r in some.groupBy("shard").applyInArrow(divide, "shard int, vec array<float>").collect():
        out.setdefault(r["shard"], []).append(r["vec"])
    return {k: np.array(v, np.float32) for k, v in out.items()}


def _counted(vectors: DataFrame, tree: Cell, probes: int, gap: float, dim: int) -> dict[int, tuple[int, int]]:
    """(vectors, queries from other shards) of each shard."""
    shards = len(tree.leaves())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, shards), np.int64)
        for b in batches:
            if b.num_rows:
                _, at, rank = tree.route(unit(_matrix(b.column(1), dim)), probes, gap)
                total += [np.bincount(at[rank == 0], minlength=shards), np.bincount(at[rank > 0], minlength=shards)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shards, dtype=np.int32)), pa.array(total[0]), pa.array(total[1])], names=["shard", "own", "asked"])

    sums = vectors.mapInArrow(run, "shard int, own long, asked long").groupBy("shard").agg(F.sum("own").alias("own"), F.sum("asked").alias("asked"))
    return {r["shard"]: (r["own"], r["asked"]) for r in sums.collect()}


def grown_tree(vectors: DataFrame, n: int, probes: int, gap: float, dim: int) -> tuple[Cell, dict[int, tuple[int, int]]]:
    """The tree of centroids and each shard's counts. Shards hold about SHARD vectors, MOST at most but where dividing a
    cell leaves nine tenths of it in one part, as copies do."""
    tree = Cell(0)
    shard, most = max(SHARD, -(-n // LEAVES)), max(MOST, -(-2 * n // LEAVES))
    sizes, stuck = {0: (n, 0)}, set()
    while True:
        leaves = {x.shard: x for x in tree.leaves()}
        large = {k: own for k, (own, _) in sizes.items() if own > most and id(leaves[k]) not in stuck}
        if not large:
            return tree, sizes
        for k, c in _fitted(vectors, tree, large, shard, dim).items():
            leaves[k].centroids, leaves[k].cells = c, [Cell() for _ in c]
        for i, x in enumerate(tree.leaves()):
            x.shard = i
        sizes = _counted(vectors, tree, probes, gap, dim)
        for k, own in large.items():
            stuck |= {id(x) for x in leaves[k].leaves() if sizes[x.shard][0] > 0.9 * own}


def similar(vectors: DataFrame, k: int, dim: int, scratch: Scratch, floor: float = -1.0, beam: int = 64, probes: int = PROBES, gap: float = GAP) -> DataFrame:
    """(a, b, sim, rnk): for each name a its k most similar other names b of cosine at least floor; ties by smaller b.

    vectors: name long, vec array<float> of dim components, as from `usable`; a name with several vectors has its best
    similarity. Approximate: what graph and shards leave out is measured in the tests; a high floor needs a shorter beam,
    since near copies are met early. Copies in any number are no hot shard, see the module. No vectors give no rows."""
    vectors = scratch.cut(vectors)
    n = vectors.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "a long, b long, sim double, rnk int")
    tree, sizes = grown_tree(vectors, n, probes, gap, dim)
    if any(own > max(MOST, 2 * n // LEAVES) for own, _ in sizes.values()):
        found = _of_copies(vectors, k, dim, scratch, floor, beam, probes, gap)
    else:
        found = _searched(vectors, tree, sizes, k, dim, floor, beam, probes, gap)
    best = found.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    w = W.partitionBy("a").orderBy(F.desc("sim"), "b")
    return best.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k)


def _searched(vectors: DataFrame, tree: Cell, sizes: dict[int, tuple[int, int]], k: int, dim: int, floor: float, beam: int, probes: int, gap: float) -> DataFrame:
    parts = np.ones(len(sizes), np.int64)
    for s, (_, asked) in sizes.items():
        parts[s] = max(1, -(-asked // ASKED))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            row, shard, rank = tree.route(unit(_matrix(b.column(1), dim)), probes, gap)
            part = np.arange(len(row)) % parts[shard]
            # a shard's own vectors stand in each of its parts, and ask in the first
            copies = np.where(rank == 0, parts[shard], 1)
            at = np.repeat(np.arange(len(row)), copies)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
            own = rank[at] == 0
            took = b.take(pa.array(row[at]))
            columns = [took.column(0), took.column(1), pa.array(shard[at].astype(np.int32)), pa.array(np.where(own, nth, part[at]).astype(np.int32)), pa.array(own), pa.array(~own | (nth == 0))]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "vec", "shard", "part", "home", "asks"])

    def answer(t: pa.Table) -> pa.Table:
        x = np.concatenate([_matrix(c, dim) for c in t.column("vec").chunks])
        names, home, asks = (t.column(c).to_numpy() for c in ("name", "home", "asks"))
        one = first_of(names, x)
        a, b, s = shard_neighbours(names[one], x[one], home[one], asks[one], k, floor, beam)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sim": pa.array(s, pa.float64())})

    routed = vectors.mapInArrow(route, "name long, vec array<float>, shard int, part int, home boolean, asks boolean")
    return routed.groupBy("shard", "part").applyInArrow(answer, "a long, b long, sim double")


def _of_copies(vectors: DataFrame, k: int, dim: int, scratch: Scratch, floor: float, beam: int, probes: int, gap: float) -> DataFrame:
    """(a, b, sim) where many vectors are equal: each distinct vector is searched once under its least name. Each name then
    gets the neighbours of its vector, of which k + 1 names suffice, taken from its copies and its neighbours' copies."""
    member = vectors.select(F.xxhash64("vec").alias("v"), "name").distinct()
    rep = scratch.cut(vectors.groupBy("vec").agg(F.min("name").alias("name")))
    tree, sizes = grown_tree(rep.select("name", "vec"), rep.count(), probes, gap, dim)
    # a name may stand for several vectors, so vectors are named by their hash here
    by_hash = rep.select(F.xxhash64("vec").alias("name"), "vec")
    near = scratch.cut(_searched(by_hash, tree, sizes, k, dim, floor, beam, probes, gap))
    least = member.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("name"))).where(F.col("r") <= k + 1)
    least = scratch.cut(least.select(F.col("v").alias("b"), F.col("name").alias("to")))
    own = least.select("b", F.col("b").alias("a"), F.lit(1.0).alias("sim"))
    links = near.select("b", "a", "sim").unionByName(own.distinct().where(F.lit(1.0) >= floor))
    offers = links.join(least, "b").groupBy("a", "to").agg(F.max("sim").alias("sim"))
    w = W.partitionBy("a").orderBy(F.desc("sim"), "to")
    offers = offers.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).groupBy(F.col("a").alias("v")).agg(F.collect_list(F.struct("to", "sim")).alias("offer"))
    out = keyed_join(member, offers, ["v"]).select(F.col("name").alias("a"), F.explode("offer").alias("o"))
    return out.select("a", F.col("o.to").alias("b"), F.col("o.sim").alias("sim")).where("a <> b")
