"""Code lookup and validation (B-01 to B-04), batched relation lookups (L-01 to L-14) and label folding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thesaurion.schema import PREFIXES

# Fixed value: the order of the parameters of a looked-up code.
PROPERTIES = ("name", "code", "system", "inactive", "display", "designation", "definition")


def _asked(codes: DataFrame, base_url: str) -> DataFrame:
    inside = F.when(F.col("system").startswith(base_url), F.substring("system", len(base_url) + 1, 1000))
    return codes.withColumn("prefix", F.when(inside.isin(*PREFIXES), inside))


def code_systems(status: DataFrame, base_url: str) -> DataFrame:
    """B-01, B-02: loaded vocabularies as code systems."""
    return status.where("concepts > 0").select(F.concat(F.lit(base_url), "prefix").alias("url"), "prefix", F.col("concepts").alias("count"))


def lookup(concepts: DataFrame, codes: DataFrame, base_url: str, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """B-03, X-21: (system, code, ok, parameters): name-value pairs in fixed order without nulls, only the wanted ones.
    ok is false for unknown systems and codes."""
    found = _asked(codes, base_url).join(concepts.withColumnRenamed("concept_id", "code").withColumn("_there", F.lit(True)), ["prefix", "code"], "left")
    values = {
        "name": F.col("prefix"),
        "code": F.col("code"),
        "system": F.col("system"),
        "inactive": F.when(F.col("status").isNotNull(), (F.col("status") == "deprecated").cast("string")),
        "display": F.col("label"),
        "designation": F.when(F.size(F.coalesce("synonyms", F.array().cast("array<string>"))) > 0, F.array_join("synonyms", "|")),
        "definition": F.col("definition"),
    }
    use = [p for p in PROPERTIES if wanted is None or p in wanted]
    pairs = F.array_compact(F.array(*[F.when(values[p].isNotNull(), F.struct(F.lit(p).alias("name"), values[p].alias("value"))) for p in use]))
    return found.select("system", "code", F.col("_there").isNotNull().alias("ok"), F.when(F.col("_there").isNotNull(), pairs).alias("parameters"))


def validate(concepts: DataFrame, codes: DataFrame, base_url: str) -> DataFrame:
    """B-04: (system, code, result, display, message)."""
    have = concepts.select("prefix", F.col("concept_id").alias("code"), F.col("label").alias("display"), F.lit(True).alias("_there")).dropDuplicates(["prefix", "code"])
    found = _asked(codes, base_url).join(have, ["prefix", "code"], "left")
    result = F.coalesce("_there", F.lit(False))
    message = F.when(F.col("prefix").isNull(), F.concat(F.lit("unknown code system "), "system")).when(~result, F.concat(F.lit("unknown code "), "code", F.lit(" in "), "system"))
    return found.select("system", "code", result.alias("result"), "display", message.alias("message"))


def in_request_order(requests: DataFrame, related: DataFrame, column: str) -> DataFrame:
    """L-02 to L-10, O-07: requests (pos, prefix, concept_id) with the list of each, empty where there is none."""
    some = related.select("prefix", "concept_id", F.col(column).alias("related"))
    return requests.select("pos", "prefix", "concept_id").join(some, ["prefix", "concept_id"], "left").select("pos", "prefix", "concept_id", F.coalesce("related", F.array().cast("array<string>")).alias("related"))


def with_unknown(requests: DataFrame, concepts: DataFrame) -> DataFrame:
    """L-11: every requested concept; a missing one keeps its prefix, has status `unknown` and nulls otherwise."""
    have = concepts.select("prefix", "concept_id", "label", F.coalesce("status", F.lit("active")).alias("_s"), F.col("status").alias("_status"))
    out = requests.join(have, ["prefix", "concept_id"], "left")
    return out.select(*requests.columns, "label", F.when(F.col("_s").isNull(), F.lit("unknown")).otherwise(F.col("_status")).alias("status"))


def fold_labels(terms: DataFrame, key: str = "concept_id") -> DataFrame:
    """F-18, F-22: terms (key, kind P or S, term, place) folded to (key, label, synonyms): the first P term, else the first
    S term; synonyms are all S terms in order, also one that is used as label."""
    at = F.struct(F.when(F.col("kind") == "P", 0).otherwise(1), F.col("place"))
    return terms.groupBy(key).agg(
        F.min_by("term", at).alias("label"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "S", F.struct("place", "term")))), lambda x: x["term"]).alias("synonyms"),
    )


def symbol_sets(symbols: DataFrame, aliases: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """F-07: (symbol, status): symbols and aliases without withdrawn ones are active, withdrawn ones deprecated."""
    s = lambda d: d.toDF("symbol").where("symbol is not null and trim(symbol) <> ''").distinct()
    gone = s(withdrawn)
    active = s(symbols).union(s(aliases)).distinct().join(gone, "symbol", "left_anti")
    return active.withColumn("status", F.lit("active")).union(gone.withColumn("status", F.lit("deprecated")))
