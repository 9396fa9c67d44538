"""Problem 3: parent-child links to full hierarchies.

1. Pointer doubling leads every node with one parent up to a root or to the next node with several, in as many rounds as
   the logarithm of such chains; what hangs from roots alone is settled by that.
2. From the links of all others leaves and roots are peeled until only loops and what lies between loops remain; the
   strongly connected parts of that core are the loops.
3. The nodes with several parents, joined by their chains, form a small graph with lengths; its least distances from the
   roots give every node its depth and its parent.
4. The forest is laid out as Euler tours (one list per root, an entry and an exit per node) and ranked by parallel
   list ranking. Leaves need no ranking: they stand first among their siblings. Of a long list an eighth of the elements
   is picked by hash, the others are led to the next of these, and the list of those is ranked in the same way.
5. Entry and exit give depth, root, size and ancestors as an interval test; a sweep over entries in order, with the open
   intervals as a stack, gives paths.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from thesaurion.runtime import Scratch, keyed_join

#: A peeled core of at most this many links is finished in one task; a larger one by distributed rounds.
CORE_LINKS = 20_000
#: Children per chunk of a parent's sibling chain.
CHUNK = 5_000
#: A list of at most this many elements is ranked by one task, by the same doubling; of a longer one, one in PICK goes on.
RANKED, PICK = 100_000, 8
#: Positions of a tour that one task sweeps.
SPAN = 200_000


def number_nodes(links: DataFrame, nodes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(nodes with nid, links as p, c by nid). links: hier, parent, child; nodes: hier, node."""
    ends = nodes.select("hier", "node").union(links.select("hier", "parent")).union(links.select("hier", "child"))
    ids = scratch.cut(ends.where(F.col("node").isNotNull()).distinct().orderBy("hier", "node").withColumn("nid", F.monotonically_increasing_id()))
    whole = links.where(F.col("parent").isNotNull() & F.col("child").isNotNull()).select("hier", "parent", "child").distinct()
    n = whole.count()
    up = keyed_join(whole, ids.select("hier", F.col("node").alias("parent"), F.col("nid").alias("p")), ["hier", "parent"], total=n)
    both = keyed_join(up, ids.select("hier", F.col("node").alias("child"), F.col("nid").alias("c")), ["hier", "child"], total=n)
    return ids, scratch.cut(both.select("p", "c"))


def peel(links: DataFrame, scratch: Scratch, enough: int) -> tuple[DataFrame, int]:
    """Drop links whose parent has no parent or whose child has no child, until nothing changes or few are left."""
    left, n = links, links.count()
    while n > enough:
        has_parent, has_child = left.select(F.col("c").alias("x")).distinct(), left.select(F.col("p").alias("x")).distinct()
        inner = left.join(has_parent, left.p == has_parent.x, "left_semi")
        inner = scratch.cut(inner.join(has_child, inner.c == has_child.x, "left_semi"))
        m = inner.count()
        if left is not links:
            scratch.drop(left)
        left = inner
        if m == n:
            break
        n = m
    return left, n


def loops_of(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, loop) for the nodes of one link list that reach themselves; loop is the part's least node. Iterative depth-first search."""
    out: dict[int, list[int]] = {}
    selfs = set()
    for a, b in pairs:
        out.setdefault(a, []).append(b)
        if a == b:
            selfs.add(a)
    index, low, stack, on, found = {}, {}, [], set(), []
    for start in out:
        if start in index:
            continue
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        work = [(start, iter(out[start]))]
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        part.append(w)
                        if w == v:
                            break
                    if len(part) > 1 or v in selfs:
                        found += [(w, min(part)) for w in part]
    return found


def loops(links: DataFrame, scratch: Scratch, core_links: int = CORE_LINKS) -> DataFrame:
    """(nid, loop): the nodes that reach themselves, with the least node of their strongly connected part."""
    core, n = peel(links, scratch, core_links)
    if n <= core_links:

        def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pairs = [x for b in batches for x in zip(b["p"].tolist(), b["c"].tolist())]
            yield pd.DataFrame(loops_of(pairs), columns=["nid", "loop"], dtype="int64")

        return scratch.cut(core.coalesce(1).mapInPandas(one, "nid long, loop long"))
    return _loops_distributed(core, scratch, core_links)


def _loops_distributed(core: DataFrame, scratch: Scratch, core_links: int) -> DataFrame:
    """Colouring: every node takes the least node that reaches it; a colour's own node collects, backwards within the
    colour, its strongly connected part. The parts found are taken out and the rest is peeled again."""
    found: DataFrame | None = None
    left = core
    while True:
        colour = scratch.cut(left.select(F.col("p").alias("x")).union(left.select("c")).distinct().withColumn("col", F.col("x")))
        while True:
            came = left.join(colour, left.p == colour.x).groupBy(F.col("c").alias("x")).agg(F.min("col").alias("via"))
            new = scratch.cut(colour.join(came, "x", "left").select("x", F.least("col", F.coalesce("via", "col")).alias("col"), (F.coalesce("via", "col") < F.col("col")).alias("moved")))
            moved = new.where("moved").limit(1).count()
            colour = new.select("x", "col")
            if not moved:
                break
        within = left.join(colour.select(F.col("x").alias("p"), F.col("col").alias("pc")), "p").join(colour.select(F.col("x").alias("c"), F.col("col").alias("cc")), "c").where("pc = cc").select("p", "c", "pc")
        within = scratch.cut(within)
        part = scratch.cut(within.where("c = pc").select(F.col("p").alias("nid"), F.col("pc").alias("loop")).distinct())
        while True:
            back = within.join(part.select(F.col("nid").alias("c")), "c", "left_semi").select(F.col("p").alias("nid"), F.col("pc").alias("loop"))
            grown = scratch.cut(part.union(back).distinct())
            if grown.count() == part.count():
                break
            part = grown
        found = part if found is None else scratch.cut(found.union(part))
        gone = colour.join(part, colour.x == part.nid, "left_semi").select("x").union(colour.where("x = col").select("x")).distinct()
        rest = left.join(gone, left.p == gone.x, "left_anti").join(gone, F.col("c") == gone.x, "left_anti").select("p", "c")
        left, n = peel(scratch.cut(rest), scratch, 0)
        if n == 0:
            return found


def chains(nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, par, several, top, dist, rooted): par the least parent other than the node itself, several whether there are
    more. top is the root (rooted) or the node with several parents that the chain of single parents leads to in dist
    links, null where it runs into a loop.

    Distances to the tops lie without gaps, so a round of doubling that settles nobody is the last."""
    other = F.when(F.col("p") != F.col("c"), F.col("p"))
    first = links.groupBy(F.col("c").alias("v")).agg(F.min(other).alias("par"), F.count(other).alias("n"))
    root, single = F.col("n").isNull(), F.coalesce(F.col("n") == 1, F.lit(False))
    begun = nodes.select(F.col("nid").alias("v")).join(first, "v", "left")
    state = begun.select("v", "par", F.coalesce(F.col("n") > 1, F.lit(False)).alias("several"), F.when(single, F.col("par")).when(root | (F.col("n") > 1), F.col("v")).alias("top"), single.cast("long").alias("dist"), root.alias("rooted"), (~single).alias("done"))
    state = scratch.cut(state)
    done, n = state.where("done").count(), state.count()
    while done < n:
        ahead = state.select(F.col("v").alias("top"), F.col("top").alias("top2"), F.col("dist").alias("dist2"), F.col("done").alias("done2"), F.col("rooted").alias("rooted2"))
        hop = keyed_join(state.where("not done"), ahead, ["top"], total=n - done)
        hop = hop.select("v", "par", "several", F.col("top2").alias("top"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("rooted2").alias("rooted"), F.col("done2").alias("done"))
        state, old = scratch.cut(state.where("done").union(hop)), state
        scratch.drop(old)
        done, before = state.where("done").count(), done
        if done == before:
            break
    return state.select("v", "par", "several", F.when(F.col("done"), F.col("top")).alias("top"), "dist", F.coalesce("rooted", F.lit(False)).alias("rooted"))


def shortest(pairs: list[tuple[int, int, int, bool]]) -> list[tuple[int, int]]:
    """(node, least length from a root) for links (top, node, length, top is a root); Dijkstra's algorithm."""
    out: dict[int, list[tuple[int, int]]] = {}
    heap = []
    for top, node, length, rooted in pairs:
        if rooted:
            heap.append((length, node))
        else:
            out.setdefault(top, []).append((length, node))
    heapq.heapify(heap)
    best: dict[int, int] = {}
    while heap:
        d, v = heapq.heappop(heap)
        if v not in best:
            best[v] = d
            for length, w in out.get(v, ()):
                if w not in best:
                    heapq.heappush(heap, (d + length, w))
    return list(best.items())


def _least_lengths(legs: DataFrame, n: int, scratch: Scratch, core_links: int) -> DataFrame:
    """(v, d): least length from a root of the nodes with several parents. legs: t, v, w, rooted. Up to core_links of them
    are settled by one task; more by rounds that follow the last gains, one for each such node on the way."""
    if n <= core_links:

        def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pairs = [x for b in batches for x in zip(b["t"].tolist(), b["v"].tolist(), b["w"].tolist(), b["rooted"].tolist())]
            yield pd.DataFrame(shortest(pairs), columns=["v", "d"], dtype="int64")

        return scratch.cut(legs.select("t", "v", "w", "rooted").coalesce(1).mapInPandas(one, "v long, d long"))
    known = scratch.cut(legs.where("rooted").groupBy("v").agg(F.min("w").alias("d")).withColumn("gained", F.lit(True)))
    while known.where("gained").limit(1).count():
        gained = known.where("gained").select(F.col("v").alias("t"), F.col("d").alias("at"))
        offers = keyed_join(legs.where("not rooted"), gained, ["t"], total=n).groupBy("v").agg(F.min(F.col("at") + F.col("w")).alias("o"))
        new = known.select("v", "d").join(offers, "v", "full")
        new = new.select("v", F.least("d", "o").alias("d"), F.coalesce(F.col("o") < F.col("d"), F.col("d").isNull()).alias("gained"))
        known, old = scratch.cut(new), known
        scratch.drop(old)
    return known.select("v", "d")


def least_depth_parents(state: DataFrame, links: DataFrame, scratch: Scratch, core_links: int = CORE_LINKS) -> DataFrame:
    """(v, par, depth): a parent of least depth for each node that a root reaches (the least such parent), null for roots.
    state: as from `chains`."""
    tops = state.where("top is not null").select(F.col("v").alias("p"), F.col("top").alias("t"), (F.col("dist") + 1).alias("w"), "rooted")
    to = links.where("p <> c").join(state.where("several").select(F.col("v").alias("c")), "c")
    n = to.count()
    legs = scratch.cut(keyed_join(to, tops, ["p"], total=n).select("p", F.col("c").alias("v"), "t", "w", "rooted"))
    best = _least_lengths(legs, n, scratch, core_links)
    at = best.select(F.col("v").alias("t"), F.col("d").alias("at"))
    reached = keyed_join(legs, at, ["t"], "left", total=n).withColumn("d", F.when(F.col("rooted"), F.col("w")).otherwise(F.col("at") + F.col("w"))).where("d is not null")
    chosen = reached.groupBy("v").agg(F.min(F.struct("d", "p"))["p"].alias("chosen"))
    deep = keyed_join(state.where("top is not null").withColumnRenamed("top", "t"), at, ["t"], "left")
    deep = deep.withColumn("depth", F.when(F.col("rooted"), F.col("dist")).otherwise(F.col("at") + F.col("dist"))).where("depth is not null")
    return scratch.cut(deep.join(chosen, "v", "left").select("v", F.coalesce("chosen", "par").alias("par"), "depth"))


def rank_local(rows: pd.DataFrame) -> pd.DataFrame:
    """Lists of e, nx, last, cnt, sum (nx -1 at an end): for each element the `last` of the end of its list, and what cnt
    and sum add up to from it to the end."""
    rows = rows.sort_values("e", ignore_index=True)
    e, nx = rows["e"].to_numpy(), rows["nx"].to_numpy()
    at = np.where(nx < 0, np.arange(len(e)), np.searchsorted(e, nx))
    add = np.where(nx < 0, 0, 1)
    cnt, total = rows["cnt"].to_numpy().copy(), rows["sum"].to_numpy().copy()
    while add.any():
        cnt, total = cnt + add * cnt[at], total + add * total[at]
        add, at = add * add[at], at[at]
    return pd.DataFrame({"e": e, "last": rows["last"].to_numpy()[at], "cnt": cnt, "sum": total})


def rank(lists: DataFrame, scratch: Scratch, ranked: int | None = None) -> DataFrame:
    """(e, last, cnt, sum) of each element of linked lists (e, nx, cnt, sum; nx null at an end): the last element of its
    list, and what cnt and sum add up to from it to the end. Work is in proportion to the elements, not times rounds."""
    ranked = RANKED if ranked is None else ranked
    return _rank(lists.select("e", "nx", F.col("e").alias("last"), "cnt", "sum"), scratch, ranked)


def _rank(lists: DataFrame, scratch: Scratch, ranked: int, level: int = 0) -> DataFrame:
    """`last` is the last element that an element's cnt and sum take in, which run to just before nx."""
    if lists.count() <= ranked:

        def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = [b for b in batches if len(b)]
            if held:
                yield rank_local(pd.concat(held))

        rows = lists.select("e", F.coalesce("nx", F.lit(-1)).cast("long").alias("nx"), "last", "cnt", "sum")
        return scratch.cut(rows.coalesce(1).mapInPandas(one, "e long, last long, cnt long, sum long"))
    picked = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(level)), F.lit(PICK)) == 0
    goes = F.col("nx").isNotNull() & ~picked("nx")
    state = scratch.cut(lists.withColumn("goes", goes))
    both = [F.col("last2").alias("last"), (F.col("cnt") + F.col("cnt2")).alias("cnt"), (F.col("sum") + F.col("sum2")).alias("sum")]
    ahead = lambda rows: rows.withColumnsRenamed({"nx": "nx2", "e": "nx", "last": "last2", "cnt": "cnt2", "sum": "sum2", "goes": "goes2"})
    while state.where("goes").limit(1).count():
        hop = state.where("goes").drop("last").join(ahead(state), "nx").select("e", F.col("nx2").alias("nx"), *both, F.col("goes2").alias("goes"))
        state, old = scratch.cut(state.where("not goes").union(hop)), state
        scratch.drop(old)
    few = _rank(state.where(picked("e")).drop("goes"), scratch, ranked, level + 1)
    far = state.where("nx is not null").drop("last").join(ahead(few), "nx").select("e", *both)
    return scratch.cut(far.union(state.where("nx is null").select("e", "last", "cnt", "sum")))


def euler_tours(forest: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, par, root, lvl, tin, tout, size) of every node of a forest (v, par), by list ranking.

    Elements 2v (entry) and 2v + 1 (exit) of nodes with children form one list per root; an entry counts for the leaves
    below it, which follow it at once. Siblings are numbered and chained in chunks, so that a parent with very many
    children is no single group."""
    kids = forest.where("par is not null").select("par", "v")
    n = kids.count()
    sizes = kids.groupBy("par").agg(F.count(F.lit(1)).alias("n"))
    inner = scratch.cut(sizes.select(F.col("par").alias("v"), F.ceil(F.col("n") / CHUNK).cast("int").alias("k")))
    marked = kids.join(inner.select("v", F.lit(True).alias("inner")), "v", "left")
    marked = keyed_join(marked, inner.withColumnRenamed("v", "par"), ["par"], total=n).select("par", "v", F.coalesce("inner", F.lit(False)).alias("inner"), F.pmod(F.hash("v"), F.col("k")).alias("s"))
    w = W.partitionBy("par", "s", "inner").orderBy("v")
    chain = scratch.cut(marked.withColumn("nth", F.row_number().over(w)).withColumn("nxt", F.lead("v").over(w)))
    ends = scratch.cut(chain.groupBy("par", "s", "inner").agg(F.min("v").alias("a"), F.max("v").alias("z"), F.count(F.lit(1)).alias("m")))
    by = W.partitionBy("par", "inner").orderBy("s")
    ends = ends.withColumn("after", F.lead("a").over(by)).withColumn("before", F.sum("m").over(by) - F.col("m"))
    heads = ends.groupBy("par").agg(F.min_by("a", F.when(F.col("inner"), F.col("s"))).alias("head"), F.coalesce(F.sum(F.when(~F.col("inner"), F.col("m"))), F.lit(0)).alias("leaves"))
    after = ends.where("inner").select(F.col("z").alias("v"), "after")
    sib = chain.where("inner").join(after, "v", "left").select("v", "par", F.coalesce("nxt", "after").alias("nxt"))
    enter = heads.select((F.col("par") * 2).alias("e"), F.coalesce(F.col("head") * 2, F.col("par") * 2 + 1).alias("nx"), (1 + 2 * F.col("leaves")).alias("cnt"), F.lit(-1).cast("long").alias("sum"))
    one = F.lit(1).cast("long")
    leave = sib.select((F.col("v") * 2 + 1).alias("e"), F.coalesce(F.col("nxt") * 2, F.col("par") * 2 + 1).alias("nx"), one.alias("cnt"), one.alias("sum"))
    roots = forest.where("par is null").select("v").join(inner.select("v", "k"), "v", "left")
    stop = roots.where("k is not null").select((F.col("v") * 2 + 1).alias("e"), F.lit(None).cast("long").alias("nx"), one.alias("cnt"), one.alias("sum"))
    done = rank(scratch.cut(enter.union(leave).union(stop)), scratch)
    # from an entry to the end the weights add up to the number of its ancestors; the root's entry spans the whole list
    even = F.col("e") % 2 == 0
    own = done.groupBy(F.shiftright("e", 1).alias("v")).agg(F.max(F.when(even, F.col("cnt"))).alias("from_in"), F.max(F.when(~even, F.col("cnt"))).alias("from_out"), F.max(F.when(even, F.col("sum"))).alias("lvl"), F.shiftright(F.max("last"), 1).alias("root"))
    own = scratch.cut(own)
    whole = own.where("v = root").select("root", F.col("from_in").alias("len"))
    out = keyed_join(own, whole, ["root"])
    out = scratch.cut(out.select("v", "root", F.col("lvl").cast("int").alias("lvl"), (F.col("len") - F.col("from_in")).alias("tin"), (F.col("len") - F.col("from_out")).alias("tout"), ((F.col("from_in") - F.col("from_out") + 1) / 2).cast("long").alias("size")))
    inside = out.join(kids.select("v", "par"), "v", "left").select("v", "par", "root", "lvl", "tin", "tout", "size")
    place = ends.where("not inner").select("par", "s", "before")
    leaf = chain.where("not inner").join(place, ["par", "s"]).select("v", "par", (2 * (F.col("before") + F.col("nth")) - 1).alias("on"))
    leaf = keyed_join(leaf, out.select(F.col("v").alias("par"), "root", (F.col("lvl") + 1).alias("lvl"), "tin"), ["par"])
    leaf = leaf.select("v", "par", "root", "lvl", (F.col("tin") + F.col("on")).alias("tin"), (F.col("tin") + F.col("on") + 1).alias("tout"), one.alias("size"))
    none = F.lit(0).cast("long")
    alone = roots.where("k is null").select("v", F.lit(None).cast("long").alias("par"), F.col("v").alias("root"), F.lit(0).alias("lvl"), none.alias("tin"), one.alias("tout"), one.alias("size"))
    return inside.union(leaf).union(alone)


def hierarchies(links: DataFrame, nodes: DataFrame, scratch: Scratch, core_links: int = CORE_LINKS) -> DataFrame:
    """hier, node, nid, par, root, lvl, tin, tout, size, on_cycle: one row per node.

    links: hier, parent, child; nodes: hier, node (nodes without links; may be empty). Repeated links count once, links
    with a null end name nothing but their other end. root is '' and lvl -1, and tin, tout, size are null, where no
    node without parents leads to the node. A node is on_cycle 1 if it reaches itself. A node with several parents
    stands in the tours under one of least depth. Blank handling and spelling are the caller's. Empty input gives no row."""
    ids, pairs = number_nodes(links, nodes, scratch)
    state = scratch.cut(chains(ids, pairs, scratch))
    # what hangs from roots by single parents is on no loop but its own
    loose = state.where("not rooted").select("v")
    core = pairs.join(loose, pairs.c == loose.v, "left_semi")
    core = core.join(loose, core.p == loose.v, "left_semi").union(pairs.where("p = c")).distinct()
    knots = loops(scratch.cut(core), scratch, core_links)
    forest = least_depth_parents(state, pairs, scratch, core_links)
    tours = euler_tours(forest.select("v", "par"), scratch)
    named = ids.select(F.col("nid").alias("root"), F.col("node").alias("root_id"))
    out = ids.join(knots.select("nid", F.lit(1).alias("on_cycle")), "nid", "left").join(tours.withColumnRenamed("v", "nid"), "nid", "left")
    out = scratch.cut(out)
    out = keyed_join(out, named, ["root"], "left")
    return out.select("hier", "node", "nid", "par", F.col("root").alias("root_nid"), F.coalesce("root_id", F.lit("")).alias("root_id"), F.coalesce("lvl", F.lit(-1)).alias("lvl"), "tin", "tout", "size", F.coalesce("on_cycle", F.lit(0)).alias("on_cycle"))


def descendants(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, dist): every pair of different nodes such that b is reached from a, over whichever parents, loops and nodes
    without a root included; dist is the least number of links. links: p, c.

    A pair more than far and at most 2 * far links apart has a node exactly far links behind its first; these are
    joined with all pairs known so far, so the rounds follow the logarithm of the greatest distance."""
    known = scratch.cut(links.where("p <> c").select(F.col("p").alias("a"), F.col("c").alias("b"), F.lit(1).alias("dist")).distinct())
    far = 1
    while True:
        edge = known.where(F.col("dist") == far)
        if edge.limit(1).count() == 0:
            return known
        above = edge.groupBy(F.col("b").alias("m")).agg(F.collect_list("a").alias("tops"))
        ahead = keyed_join(known.withColumnRenamed("a", "m"), above, ["m"])
        ahead = ahead.select(F.explode("tops").alias("a"), "b", (F.col("dist") + far).alias("dist")).where("a <> b")
        new = ahead.groupBy("a", "b").agg(F.min("dist").alias("dist")).join(known, ["a", "b"], "left_anti")
        known, old = scratch.cut(known.unionByName(new)), known
        scratch.drop(old)
        far *= 2


def paths(tree: DataFrame, span: int | None = None) -> DataFrame:
    """(nid, path array<string>, the nodes from the root to the node) for nodes with a root, from the entry-exit intervals
    of `hierarchies`: a stretch of a tour is swept in order of entries, the open intervals are the ancestors. A tour is
    cut into stretches of `span` positions, each of which also gets the intervals that are open where it begins."""
    span = SPAN if span is None else span
    own = tree.where("lvl >= 0").select("nid", "node", "root_nid", "tin", "tout", F.expr(f"tin div {span}").alias("part"), F.lit(True).alias("own"))
    over = own.where(f"tout div {span} > part").withColumn("part", F.explode(F.expr(f"sequence(part + 1, tout div {span})"))).withColumn("own", F.lit(False))
    # small tours share a task
    rows = own.unionByName(over).withColumn("lot", F.pmod(F.xxhash64("root_nid", "part"), F.lit(own.sparkSession.sparkContext.defaultParallelism * 8)))

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "root_nid", "tin"])
        at, stack, nid, path = None, [], [], []
        for part, root, i, name, tin, tout, mine in zip(*(pdf[c].tolist() for c in ("part", "root_nid", "nid", "node", "tin", "tout", "own"))):
            if at != (part, root):
                at, stack = (part, root), []
            while stack and stack[-1][0] < tin:
                stack.pop()
            stack.append((tout, name))
            if mine:
                nid.append(i)
                path.append([x for _, x in stack])
        return pd.DataFrame({"nid": nid, "path": pd.Series(path, dtype=object)})

    return rows.groupBy("lot").applyInPandas(sweep, "nid long, path array<string>")
