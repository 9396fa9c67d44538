"""Session helpers: lineage cuts in shared storage, table access, joins on skewed keys."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}
_ROOTS: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by spark.checkpoint.dir. A folder of our own only where that is unset and
    driver and executors are one process; on a cluster a local folder would not be seen by all, so that raises."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="thesaurion-")
        atexit.register(shutil.rmtree, _OWN_DIRS[app], True)
    return "file://" + _OWN_DIRS[app]


class Scratch:
    """Tables written once to the shared folder, so that an iteration neither recomputes its past nor loses it
    with an executor. Tables that later rounds no longer read are dropped at once."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._made = 0
        if not _ROOTS:
            atexit.register(_sweep)
        _ROOTS.append((spark, self.root))

    def cut(self, df: DataFrame, folders: list[str] | None = None) -> DataFrame:
        """Write df, return it read back; one pass over its plan. folders: columns by whose values the files are parted,
        so that a filter on them reads no others."""
        path = f"{self.root}/{self._made}"
        self._made += 1
        df.write.mode("overwrite").partitionBy(*folders or []).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, *tables: DataFrame | None) -> None:
        for df in tables:
            path = getattr(df, "_scratch_path", None)
            if path:
                remove(self.spark, path)


def _sweep() -> None:
    """What is left in the shared folder goes when the driver ends; results read it until then."""
    for spark, root in _ROOTS:
        try:
            remove(spark, root)
        except Exception:  # noqa: BLE001 - the session is gone already
            return


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key is hot when it alone holds this share of the rows; hence there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 500
#: Fewer rows of one key are never hot: a task takes so many without trouble.
HOT_ROWS = 200_000


def keyed_join(rows: DataFrame, side: DataFrame, on: list[str], how: str = "inner", total: int | None = None) -> DataFrame:
    """Join rows with a side that holds each key once, also where one key owns a large share of the rows.

    Keys above HOT_SHARE of the rows are found by a counted aggregation (map-side combined). They are at most
    1 / HOT_SHARE, so that their part of the side has a proven bound and is broadcast; all others are joined by a
    shuffle on the key. Null keys match nothing and are kept apart from the shuffle (kept by a left join)."""
    total = rows.count() if total is None else total
    least = max(HOT_ROWS, int(total * HOT_SHARE))
    if total <= least:
        return rows.join(side, on, how)
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > least).drop("_n")
    hot = [r.asDict() for r in counts.limit(int(1 / HOT_SHARE) + 1).collect()]
    if not hot:
        return rows.join(side, on, how)
    marks = rows.sparkSession.createDataFrame([tuple(h[c] for c in on) for h in hot], counts.schema)
    hot_side = F.broadcast(side.join(F.broadcast(marks), on, "left_semi"))
    hot_rows = rows.join(F.broadcast(marks), on, "left_semi")
    cold_rows = rows.join(F.broadcast(marks), on, "left_anti")
    return hot_rows.join(hot_side, on, how).unionByName(cold_rows.join(side, on, how))


def blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return c.isNull() | (F.length(trim_ws(c)) == 0)


def trim_ws(c: Column) -> Column:
    """Strip white space of every kind, not only the space character."""
    return F.regexp_replace(c, r"^[\s\p{Z}​﻿]+|[\s\p{Z}​﻿]+$", "")
