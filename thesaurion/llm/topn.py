"""Problem 2: the N best items of every group by descending score bands.

The rows are read twice: once for the quantiles of the score, once to combine repeated items and write each with its best
score into the band of its score. Bands are read from the top. A band first leaves out groups that are filled already,
then takes each task's N best of a group before the group meets, and finishes with the exact tie rule what the bands
above left open. Most rows of large groups lie in bands below the one that fills them and go unranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from thesaurion.runtime import HOT_SHARE, Scratch

#: Shares of the rows above each band's lower edge; the last band takes all that is left.
BANDS = (0.04, 0.2, 0.5)


def band_edges(scores: DataFrame, score: str, bands: tuple[float, ...] = BANDS) -> list[float]:
    """Lower edges from the top, distinct; from a quantile sketch over all rows."""
    cuts = scores.approxQuantile(score, [1 - b for b in bands], 0.005)
    return sorted(set(cuts), reverse=True)


def write_bands(usable: DataFrame, edges: list[float], scratch: Scratch) -> DataFrame:
    """(g, i, s, band): each item of a group once with its best score, written in folders by band. Repeats are combined
    before the shuffle, which goes by group and item, so that no group is hot in it."""
    band = F.lit(len(edges))
    for k in reversed(range(len(edges))):
        band = F.when(F.col("s") >= edges[k], k).otherwise(band)
    best = usable.groupBy("g", "i").agg(F.max("s").alias("s"))
    return scratch.cut(best.withColumn("band", band), ["band"])


def top_n(rows: DataFrame, group: str, item: str, score: str, n: int, tie: Column, scratch: Scratch, bands: tuple[float, ...] = BANDS) -> DataFrame:
    """group, rnk (from 1), item, score: per group the n items of highest score; equal scores by `tie` ascending (an
    expression of the item, named i), then by item. An item counts once, with its best score.

    Rows with a null group, item or score, or a NaN score, do not take part (a null tie sorts last). Groups with fewer
    than n items give what they have. Empty input gives no row. Other columns are not read. Groups that hold more than
    HOT_SHARE of a band's rows are at most 1 / HOT_SHARE; those of them that are filled are left out by a broadcast
    before anything is sorted or moved. Of all other groups a task sends at most its n best."""
    usable = rows.where(F.col(group).isNotNull() & F.col(item).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    usable = usable.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).alias("s"))
    edges = band_edges(usable, "s", bands)
    table = write_bands(usable, edges, scratch)
    w = W.partitionBy("g").orderBy(F.desc("s"), F.asc_nulls_last("t"), "i")
    kept: DataFrame | None = None
    for k in range(len(edges) + 1):
        band = table.where(F.col("band") == k).select("g", "i", "s")
        if kept is not None:
            # the rank so far of each group: those at n are filled
            have = kept.groupBy("g").agg(F.max("r").alias("have"))
            sizes = band.groupBy("g").agg(F.count(F.lit(1)).alias("c"))
            large = sizes.orderBy(F.desc("c")).limit(int(1 / HOT_SHARE))
            hot = large.join(have.where(F.col("have") >= n), "g", "left_semi").select("g")
            band = band.join(F.broadcast(hot), "g", "left_anti")
        ranked = band.withColumn("t", tie).withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
        if kept is not None:
            open_ = ranked.join(have.where(F.col("have") >= n), "g", "left_anti").join(have, "g", "left")
            ranked = open_.withColumn("r", F.col("r") + F.coalesce("have", F.lit(0))).where(F.col("r") <= n)
        ranked = ranked.select("g", F.col("r").cast("int").alias("r"), "i", "s")
        part = ranked if kept is None else kept.unionByName(ranked)
        kept, old = scratch.cut(part), kept
        scratch.drop(old)
    scratch.drop(table)
    return kept.select(F.col("g").alias(group), F.col("r").alias("rnk"), F.col("i").alias(item), F.col("s").alias(score))
