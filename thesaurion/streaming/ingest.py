"""Streams: document ingest with upsert, status snapshots, and windows over events (R-18, M-01 to M-08)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from thesaurion.operators.documents import upsert, vocabulary_status
from thesaurion.operators.graph import count_edges, count_scores
from thesaurion.runtime import remove
from thesaurion.schema import CONCEPTS_DDL
from thesaurion.schema import concepts as concept_rows


class ConceptStore:
    """Concepts kept as versions of a Parquet table: a version is written whole, then named current; readers never see
    half of one. A batch that comes again after a failure is recognised by its number and not applied twice; hence a
    store belongs to one stream and its checkpoint."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.getName()[2:]) for n in names if n.getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS")))

    def version(self) -> int:
        """M-06: grows with every change; -1 before the first."""
        return (self._versions() or [-1])[-1]

    def read(self) -> DataFrame:
        v = self.version()
        if v < 0:
            return self.spark.createDataFrame([], CONCEPTS_DDL)
        return self.spark.read.schema(CONCEPTS_DDL).parquet(f"{self.path}/v={v}")

    def apply(self, batch: DataFrame, number: int) -> None:
        """Upsert one micro-batch as version `number`; of repeated ids in it the greatest row by content stands."""
        if number <= self.version():
            return
        fields = [c for c in batch.columns if c not in ("prefix", "concept_id")]
        one = batch.where("prefix is not null and concept_id is not null").groupBy("prefix", "concept_id").agg(F.max(F.struct(*fields)).alias("r")).select("prefix", "concept_id", "r.*")
        upsert(self.read(), concept_rows(one), ["prefix", "concept_id"]).select(*self.read().columns).write.mode("overwrite").parquet(f"{self.path}/v={number}")
        for v in self._versions()[: -self.keep]:
            remove(self.spark, f"{self.path}/v={v}")


def ingest(spark: SparkSession, folder: str, store: ConceptStore, checkpoint: str, bad_rows: str = "FAILFAST", files_per_batch: int = 100) -> StreamingQuery:
    """R-18, M-02: JSON lines (gzip too) that appear in folder are upserted batch by batch; started with availableNow it
    takes what is there and ends. A malformed line fails the batch unless bad_rows says otherwise."""
    lines = spark.readStream.schema(CONCEPTS_DDL).option("mode", bad_rows).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return lines.writeStream.foreachBatch(store.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_snapshot(concepts: DataFrame, edges: DataFrame, vectors: DataFrame, similarities: DataFrame, prefixes: DataFrame, keys: DataFrame, ttl_s: int = 3600) -> dict[str, DataFrame]:
    """M-05, M-07: the three status tables computed together, with when they were computed and when they are stale (ttl)
    or expired (7 ttl)."""
    now = F.current_timestamp()
    stamp = {"computed_at": now, "stale_at": now + F.make_interval(secs=F.lit(ttl_s)), "expires_at": now + F.make_interval(secs=F.lit(7 * ttl_s))}
    parts = {"vocabulary": vocabulary_status(concepts, edges, vectors, prefixes), "annotation": count_edges(edges), "similarity": count_scores(similarities, keys)}
    return {k: v.withColumns(stamp) for k, v in parts.items()}


def _timed(events: DataFrame, late: str) -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if events.isStreaming else rows


def windowed_counts(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """M-08, a native extra: counts and sums per event type in tumbling or sliding windows; alike for streams and tables."""
    rows = _timed(events, late)
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = rows.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """M-08, a native extra: a user's runs of events with pauses below gap."""
    rows = _timed(events, late)
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
