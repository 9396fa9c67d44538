"""Similarity of concepts computed from a hierarchy and its annotations (A-01 to A-11).

Target hierarchy: links (child, parent). Annotations: (id, corpus_id), distinct. Results are pairs id_1 < id_2."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thesaurion.runtime import Scratch


class CycleError(ValueError):
    pass


def roll_up(links: DataFrame, weights: DataFrame, scratch: Scratch) -> DataFrame:
    """A-02: (id, n): own weight plus the sum over children, so a descendant counts once for each path to it.

    Level by level: every round pushes the sums of finished nodes to their parents. weights: (id, w). A loop raises."""
    nodes = links.select(F.col("child").alias("id")).union(links.select("parent")).union(weights.select("id")).distinct()
    wait = links.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("open"))
    state = nodes.join(weights, "id", "left").join(wait, "id", "left").select("id", F.coalesce("w", F.lit(0.0)).cast("double").alias("n"), F.coalesce("open", F.lit(0)).alias("open"))
    state = scratch.cut(state)
    hops = scratch.cut(links.select("child", "parent"))
    out: DataFrame | None = None
    while True:
        ready = scratch.cut(state.where("open = 0").select("id", "n"))
        if ready.limit(1).count() == 0:
            break
        out = ready if out is None else out.union(ready)
        push = hops.join(ready, hops.child == ready.id).groupBy(F.col("parent").alias("id")).agg(F.sum("n").alias("more"), F.count(F.lit(1)).alias("got"))
        rest = state.where("open > 0").join(push, "id", "left")
        state, old = scratch.cut(rest.select("id", (F.col("n") + F.coalesce("more", F.lit(0.0))).alias("n"), (F.col("open") - F.coalesce("got", F.lit(0))).alias("open"))), state
        scratch.drop(old)
    if state.limit(1).count():
        raise CycleError("the hierarchy has a loop")
    return out if out is not None else state.select("id", "n")


def path_counts(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, anc, m): the number of paths from each node up to each node above it, itself with 1. A loop raises.

    What repeated roll-ups over the same hierarchy need once: each is then one join and one sum."""
    hops = scratch.cut(links.select(F.col("child").alias("anc"), F.col("parent").alias("up")))
    front = scratch.cut(hops.select("anc").union(hops.select("up")).distinct().select(F.col("anc").alias("id"), "anc", F.lit(1).cast("double").alias("m")))
    out = front
    while True:
        front = scratch.cut(front.join(hops, "anc").groupBy("id", F.col("up").alias("anc")).agg(F.sum("m").alias("m")))
        if front.limit(1).count() == 0:
            return scratch.cut(out.groupBy("id", "anc").agg(F.sum("m").alias("m")))
        if front.where("id = anc").limit(1).count():
            raise CycleError("the hierarchy has a loop")
        out = out.union(front)


def information_content(rolled: DataFrame, most: float | None = None) -> DataFrame:
    """A-03: (id, n, top, ic): -ln(n / top), null where n is 0. top is the greatest n unless given."""
    top = rolled.agg(F.max("n")).first()[0] if most is None else most
    top = F.lit(None if top is None else float(top)).cast("double")
    return rolled.select("id", "n", top.alias("top"), F.when(F.col("n") > 0, F.abs(-F.log(F.col("n") / top))).alias("ic"))


def ancestors_or_self(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, anc): distinct closure with every node itself."""
    hops = scratch.cut(links.select(F.col("child").alias("id"), F.col("parent").alias("up")).distinct())
    front = scratch.cut(hops.select("id").union(hops.select("up")).distinct().select("id", F.col("id").alias("anc")))
    met = front
    while True:
        front = scratch.cut(front.join(hops.select(F.col("id").alias("anc"), "up"), "anc").select("id", F.col("up").alias("anc")).distinct().join(met, ["id", "anc"], "left_anti"))
        if front.limit(1).count() == 0:
            return met
        met = met.union(front)


def _pairs_at(closure: DataFrame, ic: DataFrame) -> DataFrame:
    """(id_1, id_2, mica ic, mica n): per pair the common ancestor-or-self of most information.

    Only ancestors that carry information above 0 make pairs: at the others the score is 0, whatever the pair."""
    carry = closure.join(ic.where("ic > 0").select(F.col("id").alias("anc"), F.col("ic").alias("m_ic"), F.col("n").alias("m_n")), "anc")
    a, b = carry.withColumnRenamed("id", "id_1"), carry.select(F.col("id").alias("id_2"), "anc")
    both = a.join(b, "anc").where("id_1 < id_2")
    return both.groupBy("id_1", "id_2").agg(F.max(F.struct("m_ic", "m_n")).alias("m"))


def relevance(links: DataFrame, annotations: DataFrame, scratch: Scratch, threshold: float = 0.2) -> DataFrame:
    """A-04, A-05: (id_1, id_2, score): 2 IC(m) / (IC(1) + IC(2)) * (1 - n(m) / n_max), pairs of at least threshold (above 0).

    m is the common ancestor-or-self of most information; pairs without one, or with no information, have no score."""
    weights = annotations.distinct().groupBy("id").agg(F.count(F.lit(1)).cast("double").alias("w"))
    ic = scratch.cut(information_content(roll_up(links, weights, scratch)))
    return relevance_of(links, ic, scratch, threshold)


def relevance_of(links: DataFrame, ic: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    if threshold <= 0:
        raise ValueError("a threshold above 0 is needed: at 0 every pair would be a result")
    own = ic.where("ic is not null").select("id", "ic")
    pairs = _pairs_at(ancestors_or_self(links, scratch), ic)
    pairs = pairs.join(own.select(F.col("id").alias("id_1"), F.col("ic").alias("ic_1")), "id_1").join(own.select(F.col("id").alias("id_2"), F.col("ic").alias("ic_2")), "id_2")
    top = F.lit(ic.agg(F.max("top")).first()[0]).cast("double")
    score = F.try_divide(2 * F.col("m.m_ic"), F.col("ic_1") + F.col("ic_2")) * (1 - F.col("m.m_n") / top)
    return pairs.select("id_1", "id_2", score.alias("score")).where(F.col("score") >= threshold)


def weighted_content(target: DataFrame, corpus: DataFrame, annotations: DataFrame, scratch: Scratch, close: float = 1e-3, most_rounds: int = 100, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A-06: (target, corpus) as (id, n, top, ic), by turns: a node's sum is its annotations' exp(IC / 2) of the other side
    and its children's sums. In the first pass an annotation counts 0.5. Ends when no IC of either side moves by close or more,
    not before the second round; or after exactly `rounds`."""
    pairs = scratch.cut(annotations.select("id", "corpus_id").distinct())
    flip = pairs.select(F.col("corpus_id").alias("id"), F.col("id").alias("corpus_id"))

    def side(paths: DataFrame, ann: DataFrame, other: DataFrame | None) -> DataFrame:
        if other is None:
            w = ann.groupBy("id").agg((F.count(F.lit(1)) * F.lit(0.5)).alias("w"))
        else:
            w = ann.join(other.where("ic is not null").select(F.col("id").alias("corpus_id"), "ic"), "corpus_id").groupBy("id").agg(F.sum(F.exp(F.col("ic") * 0.5)).alias("w"))
        below = paths.join(w, "id").groupBy(F.col("anc").alias("id")).agg(F.sum(F.col("m") * F.col("w")).alias("n"))
        lone = w.join(paths.select("id").distinct(), "id", "left_anti").select("id", F.col("w").alias("n"))
        return scratch.cut(information_content(scratch.cut(below.union(lone))))

    def moved(new: DataFrame, old: DataFrame) -> float:
        return new.join(old.select("id", F.col("ic").alias("old")), "id").agg(F.max(F.abs(F.col("ic") - F.col("old")))).first()[0] or 0.0

    target, corpus = path_counts(target, scratch), path_counts(corpus, scratch)
    t = side(target, pairs, None)
    c = side(corpus, flip, t)
    for _ in range(1, rounds or most_rounds):
        t2 = side(target, pairs, c)
        c2 = side(corpus, flip, t2)
        still = rounds is None and max(moved(t2, t), moved(c2, c)) < close
        t, c = t2, c2
        if still:
            break
    return t, c


def weighted_relevance(target: DataFrame, corpus: DataFrame, annotations: DataFrame, scratch: Scratch, threshold: float = 0.2) -> DataFrame:
    """A-06: relevance over weighted sums."""
    t, _ = weighted_content(target, corpus, annotations, scratch)
    return relevance_of(target, t, scratch, threshold)


def co_annotation(links: DataFrame, annotations: DataFrame, scratch: Scratch, threshold: float = 0.2) -> DataFrame:
    """A-07: (id_1, id_2, score): NPMI brought to 0..1, times Jaccard, over the corpus nodes annotated to a node or below it.

    N is the number of corpus nodes that are annotated at all. Nodes without annotation are pruned first. Pairs that share
    none have score 0 and are not results, as the threshold is above 0. Sets that cover all N have NPMI 1."""
    if threshold <= 0:
        raise ValueError("a threshold above 0 is needed: at 0 every pair would be a result")
    ann = scratch.cut(annotations.select("id", "corpus_id").distinct())
    total = ann.agg(F.count_distinct("corpus_id")).first()[0]
    up = ancestors_or_self(links, scratch)
    sets = scratch.cut(up.join(ann, "id").select(F.col("anc").alias("id"), "corpus_id").union(ann).distinct())
    size = sets.groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    both = sets.select(F.col("id").alias("id_1"), "corpus_id").join(sets.select(F.col("id").alias("id_2"), "corpus_id"), "corpus_id").where("id_1 < id_2")
    common = both.groupBy("id_1", "id_2").agg(F.count(F.lit(1)).alias("x"))
    rows = common.join(size.select(F.col("id").alias("id_1"), F.col("k").alias("k1")), "id_1").join(size.select(F.col("id").alias("id_2"), F.col("k").alias("k2")), "id_2")
    n = F.lit(float(total or 1))
    px = F.col("x") / n
    npmi = F.when(F.col("x") == n, F.lit(1.0)).otherwise(F.try_divide(F.log(px / ((F.col("k1") / n) * (F.col("k2") / n))), -F.log(px)))
    score = (npmi + 1) / 2 * (F.col("x") / (F.col("k1") + F.col("k2") - F.col("x")))
    return rows.select("id_1", "id_2", score.alias("score")).where(F.col("score") >= threshold)


def calculate(method: str, prefix: str, corpus: str, links: DataFrame, annotations: DataFrame, scratch: Scratch, corpus_links: DataFrame | None = None, threshold: float = 0.2) -> DataFrame:
    """A-09: the scores of a method as rows of the similarities table, score_key `method:corpus`."""
    if annotations.limit(1).count() == 0:
        raise ValueError(f"no annotations between {prefix} and {corpus}")
    if method == "relevance":
        pairs = relevance(links, annotations, scratch, threshold)
    elif method == "co-annotation":
        pairs = co_annotation(links, annotations, scratch, threshold)
    elif method == "weighed-relevance":
        if corpus_links is None:
            raise ValueError("weighed-relevance needs the corpus hierarchy")
        pairs = weighted_relevance(links, corpus_links, annotations, scratch, threshold)
    else:
        raise ValueError(f"unknown similarity method: {method}")
    p = F.lit(prefix)
    return pairs.select(p.alias("prefix_from"), F.col("id_1").alias("id_from"), p.alias("prefix_to"), F.col("id_2").alias("id_to"), F.lit(f"{method}:{corpus}").alias("score_key"), "score")


def save_scores(old: DataFrame, new: DataFrame) -> DataFrame:
    """R-12: scores of the same pair and key are overwritten."""
    keys = ["prefix_from", "id_from", "prefix_to", "id_to", "score_key"]
    return old.join(new, keys, "left_anti").unionByName(new)
