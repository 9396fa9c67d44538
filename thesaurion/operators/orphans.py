"""Problem 7: references to records that are missing, deleted or arrive later.

Keys of both sides are encoded as dense integers. Per key range and month, one bitmap holds the keys referred to and
one the usable keys that had arrived before. Reference AND-NOT parent leaves the suspect bits; they are decoded, and
only the rows they name are looked at again to settle the reason to the instant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thesaurion.runtime import Scratch, keyed_join

RANGE = 8 * 4096  #: keys per range: the bits of one bitmap


def encode(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """(kind, key, kid): dense integers in key order, numbered within each part of a range-sorted table."""
    ordered = keys.where(F.col("key").isNotNull()).select("kind", "key").distinct().orderBy("kind", "key")
    return scratch.cut(ordered.withColumn("kid", F.monotonically_increasing_id()))


def _bitmaps(rows: DataFrame, by: list[str]) -> DataFrame:
    at = F.col("kid") + 1
    return (
        rows.groupBy(*by, F.bitmap_bucket_number(at).alias("range"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    )


def and_not(refs: pd.DataFrame, parents: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """(period, surviving bit places) of one key range: reference bits AND NOT the bits of parents of earlier periods."""
    known = np.zeros(RANGE // 8, np.uint8)
    arrivals = sorted(zip(parents["period"], parents["bits"]))
    i = 0
    for period, bits in sorted(zip(refs["period"], refs["bits"])):
        while i < len(arrivals) and arrivals[i][0] < period:
            known |= np.frombuffer(arrivals[i][1], np.uint8)
            i += 1
        left = np.frombuffer(bits, np.uint8) & ~known
        if left.any():
            yield period, np.flatnonzero(np.unpackbits(left, bitorder="little"))


def orphan_references(refs: DataFrame, parents: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of refs whose key is `missing`, `deleted` or `late`: columns of refs plus reason.

    refs: kind, ref_table, key string, feed_seq, received_at, yyyymm int. parents: kind, key, deleted boolean,
    first_at timestamp, one row per key. Null keys refer to nothing. Repeated rows each come out. A null received_at
    is never late; its rows are compared with all parents. Further columns are carried along, but one named reason gives
    way. Empty sides are allowed. A key with a third of all rows
    makes one bit per month, its rows are joined apart (see keyed_join)."""
    columns = refs.columns
    refs = refs.where(F.col("key").isNotNull()).select("kind", "key", F.coalesce("yyyymm", F.lit(0)).alias("period"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    marks = refs.select("kind", "key", "period").distinct()
    ids = encode(marks.select("kind", "key").unionByName(parents.select("kind", "key")), scratch)
    usable = parents.where(~F.coalesce("deleted", F.lit(False))).select("kind", "key", F.coalesce(F.date_format("first_at", "yyyyMM").cast("int"), F.lit(-1)).alias("period"))
    left = _bitmaps(marks.join(ids, ["kind", "key"]), ["kind", "period"])
    right = _bitmaps(usable.join(ids, ["kind", "key"]), ["kind", "period"])

    def decode(key, r: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        found = [(int(m), (int(key[1]) - 1) * RANGE + at.astype("int64")) for m, at in and_not(r, p)]
        return pd.DataFrame({"kind": key[0], "period": np.repeat([m for m, _ in found], [len(a) for _, a in found]) if found else np.array([], "int64"), "kid": np.concatenate([a for _, a in found]) if found else np.array([], "int64")})

    suspects = left.groupBy("kind", "range").cogroup(right.groupBy("kind", "range")).applyInPandas(decode, "kind string, period int, kid long")
    named = suspects.join(ids, ["kind", "kid"]).join(parents, ["kind", "key"], "left")
    named = named.select("kind", "key", "period", "deleted", "first_at", F.col("deleted").isNotNull().alias("_known"))
    named = scratch.cut(named)
    rows = keyed_join(refs, named, ["kind", "key", "period"])
    reason = (
        F.when(~F.col("_known"), "missing")
        .when(F.col("deleted"), "deleted")
        .when(F.col("first_at") > F.col("row.received_at"), "late")
    )
    kept = rows.select("row", reason.alias("why")).where(F.col("why").isNotNull())
    return kept.select(*[F.col("row")[c].alias(c) for c in columns if c != "reason"], F.col("why").alias("reason"))
