"""The offline interchange files: documents, graphs, annotations, similarities, embeddings (W-01 to W-05, R-01 to R-08)."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thesaurion.functions.curie import curie
from thesaurion.functions.text import ngrams, search_text
from thesaurion.schema import CONCEPTS_DDL, METHODS, PREFIXES
from thesaurion.schema import concepts as concept_rows
from thesaurion.schema import edges as edge_rows

_CAMEL = {"concept_id": "conceptId", "concept_types": "conceptTypes", "vector_id": "vectorId", "bio_type": "bioType", "drug_strengths": "drugStrengths", "fully_defined": "fullyDefined"}


def write_documents(concepts: DataFrame, path: str) -> None:
    """W-01: JSON lines, nulls left out, with n-grams and search text."""
    out = concepts.withColumn("nGrams", ngrams("concept_id", "label", "synonyms")).withColumn("searchText", search_text("concept_id", "label", "synonyms"))
    out.withColumnsRenamed({k: v for k, v in _CAMEL.items() if k in out.columns}).write.mode("overwrite").option("ignoreNullFields", True).json(path)


def read_documents(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """R-04: a row of another vocabulary or without an id is an error."""
    ddl = CONCEPTS_DDL
    for a, b in _CAMEL.items():
        ddl = ddl.replace(f"{a} ", f"{b} ", 1)
    raw = spark.read.schema(ddl).option("mode", "FAILFAST").json(path).withColumnsRenamed({v: k for k, v in _CAMEL.items()})
    fine = F.coalesce((F.col("prefix") == prefix) & (F.length("concept_id") > 0), F.lit(False))
    return concept_rows(raw.withColumn("prefix", F.when(fine, F.col("prefix")).otherwise(F.raise_error(F.lit(f"a document is not of {prefix} or has no id")).cast("string"))))


def write_graph(edges: DataFrame, concepts: DataFrame, path: str) -> None:
    """W-02: links (from, to, kind, key) and nodes (id, list of types as text)."""
    key = F.explode_outer("keys").alias("key")
    edges.select("id_from", "id_to", "rel_type", key).write.mode("overwrite").csv(f"{path}.graph.dump")
    types = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("concept_types", F.array().cast("array<string>")), lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "), F.lit("]"))
    concepts.select("concept_id", types.alias("types")).write.mode("overwrite").csv(f"{path}.node_ids.dump")


def read_graph(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """R-01, R-05: always many links between two nodes; an empty kind is related_to; keys of a link are collected."""
    raw = spark.read.schema("id_from string, id_to string, rel_type string, key string").csv(f"{path}.graph.dump")
    rel = F.coalesce(F.when(F.length("rel_type") > 0, F.col("rel_type")), F.lit("related_to"))
    keyed = raw.where("id_from is not null and id_to is not null").groupBy("id_from", "id_to", rel.alias("rel_type")).agg(F.array_sort(F.collect_set("key")).alias("keys"))
    return edge_rows(keyed.withColumn("keys", F.when(F.size("keys") > 0, F.col("keys"))), prefix, prefix)


def write_annotations(edges: DataFrame, path: str) -> None:
    """W-03: prefix and CURIE of both ends, kind, properties as JSON."""
    out = edges.select("prefix_from", curie("prefix_from", "id_from").alias("a"), "prefix_to", curie("prefix_to", "id_to").alias("b"), "rel_type", F.coalesce(F.to_json("props"), F.lit("{}")).alias("props"))
    out.write.mode("overwrite").option("escape", '"').csv(path)


def read_annotations(spark: SparkSession, path: str, prefix_1: str | None = None, prefix_2: str | None = None) -> DataFrame:
    """R-02, R-08: short rows are skipped, ids may carry their prefix, kinds default to annotated_with; with two prefixes
    only links between these, in either order. Of repeated links the one with the last properties as text stands."""
    raw = spark.read.option("escape", '"').schema("p1 string, i1 string, p2 string, i2 string, rel string, props string").csv(path)
    fall = lambda p: F.lit(p) if p else F.lit(None).cast("string")
    rows = raw.where("i1 is not null and i2 is not null and props is not null")
    rows = rows.select(curie("p1", "i1", fall(prefix_1)).alias("a"), curie("p2", "i2", fall(prefix_2)).alias("b"), F.coalesce("rel", F.lit("annotated_with")).alias("rel_type"), F.col("props").alias("json"))
    left = lambda c: F.substring_index(c, ":", 1)
    local = lambda c: F.regexp_replace(c, r"^[^:]*:", "")
    rows = rows.select(left("a").alias("prefix_from"), local("a").alias("id_from"), left("b").alias("prefix_to"), local("b").alias("id_to"), "rel_type", "json")
    if prefix_1 and prefix_2:
        rows = rows.where(F.array_sort(F.array("prefix_from", "prefix_to")) == F.lit(sorted((prefix_1, prefix_2))))
    one = rows.groupBy("prefix_from", "id_from", "prefix_to", "id_to", "rel_type").agg(F.max("json").alias("json"))
    return edge_rows(one.withColumn("props", F.from_json("json", "map<string,string>")))


def write_similarities(similarities: DataFrame, folder: str, target: str, method: str, corpus: str | None, threshold: float = 0.2) -> str:
    """W-04."""
    path = f"{folder}/{target}-{method}{'-' + corpus if corpus else ''}.similarity.dump"
    similarities.where(F.col("score") >= threshold).select("id_from", "id_to", "score").write.mode("overwrite").csv(path)
    return path


def read_similarities(spark: SparkSession, path: str) -> DataFrame:
    """R-07: vocabulary, method and corpus from the file name, the longest known method first; a score that is no finite
    number is an error."""
    raw = spark.read.schema("id_from string, id_to string, score double").csv(path).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)\.similarity\.dump", 1))
    shape = f"^({'|'.join(PREFIXES)})-({'|'.join(sorted(METHODS, key=len, reverse=True))})(?:-(.+))?$"
    part = lambda i: F.regexp_extract(F.url_decode("file"), shape, i)
    fine = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")) & (part(1) != "")
    score = F.when(fine, F.col("score")).otherwise(F.raise_error(F.concat(F.lit("bad similarity row in "), "file")).cast("double"))
    key = F.when(part(3) != "", F.concat(part(2), F.lit(":"), part(3))).otherwise(part(2))
    return raw.select(part(1).alias("prefix_from"), "id_from", part(1).alias("prefix_to"), "id_to", key.alias("score_key"), score.alias("score"))


MAGIC, VERSION = b"EMB1", 1
_HEAD = struct.Struct("<4sHIHH")  # magic, version, dimension, flags, unused
_BLOCK = struct.Struct("<I")  # bytes of the block's payload
BLOCK_ROWS = 50_000


def encode_container(rows: list[tuple[str, str, np.ndarray]], dim: int) -> bytes:
    """W-05: header, then blocks of (rows; per row length of id, id, 16 bytes of vector id, float32 components)."""
    out = bytearray(_HEAD.pack(MAGIC, VERSION, dim, 0, 0))
    for lo in range(0, len(rows), BLOCK_ROWS):
        some = rows[lo : lo + BLOCK_ROWS]
        body = bytearray(struct.pack("<I", len(some)))
        for cid, vid, vec in some:
            name = cid.encode()
            v = np.ascontiguousarray(vec, "<f4")
            if len(name) > 0xFFFF or v.shape != (dim,):
                raise ValueError(f"{cid}: id too long or vector not of {dim} components")
            body += struct.pack("<H", len(name)) + name + uuid.UUID(vid).bytes + v.tobytes()
        out += _BLOCK.pack(len(body)) + body
    return bytes(out)


def decode_container(data: bytes) -> Iterator[tuple[str, str, np.ndarray]]:
    """R-03: the inverse; wrong magic, version or flags and cut-off files are errors."""
    if len(data) < _HEAD.size:
        raise EOFError("no header")
    magic, version, dim, flags, _ = _HEAD.unpack_from(data, 0)
    if (magic, version, flags) != (MAGIC, VERSION, 0):
        raise ValueError(f"no embedding container: {magic!r} version {version} flags {flags}")
    at = _HEAD.size
    while at < len(data):
        end = at + _BLOCK.size + _BLOCK.unpack_from(data, at)[0] if at + _BLOCK.size <= len(data) else len(data) + 1
        if end > len(data):
            raise EOFError("block cut off")
        n, at = struct.unpack_from("<I", data, at + _BLOCK.size)[0], at + _BLOCK.size + 4
        for _ in range(n):
            k = struct.unpack_from("<H", data, at)[0] if at + 2 <= end else end
            if at + 2 + k + 16 + 4 * dim > end:
                raise EOFError("row cut off")
            cid, vid = data[at + 2 : at + 2 + k].decode(), str(uuid.UUID(bytes=data[at + 2 + k : at + 18 + k]))
            yield cid, vid, np.frombuffer(data, "<f4", dim, at + 18 + k).copy()
            at += 18 + k + 4 * dim


def write_embeddings(vectors: DataFrame, path: str, dim: int) -> None:
    """One container per partition, as a table of (content binary) in Parquet under path; see save_containers for files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(c, v, np.asarray(x, np.float32)) for c, v, x in zip(b["concept_id"], b["vector_id"], b["vector"])]
            yield pd.DataFrame({"content": [encode_container(rows, dim)]})

    vectors.select("concept_id", "vector_id", "vector").mapInPandas(run, "content binary").write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str, prefix: str, files: bool = True) -> DataFrame:
    """R-03, R-06: vectors of container files (*.embed.dump), or of a table from write_embeddings. A file is one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                part: list = []
                for row in decode_container(content):
                    part.append(row)
                    if len(part) == 10_000:
                        yield _vectors(part)
                        part = []
                yield _vectors(part)

    raw = spark.read.format("binaryFile").load(path).select("content") if files else spark.read.parquet(path)
    out = raw.mapInPandas(run, "concept_id string, vector_id string, vector array<float>")
    return out.select(F.lit(prefix).alias("prefix"), "concept_id", "vector_id", "vector")


def _vectors(rows: list) -> pd.DataFrame:
    return pd.DataFrame({"concept_id": [r[0] for r in rows], "vector_id": [r[1] for r in rows], "vector": [r[2] for r in rows]})
