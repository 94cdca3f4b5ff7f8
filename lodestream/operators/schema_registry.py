"""A registry of the fields that documents of each type have: collected from JSON, kept in versions, compared.

Fields are collected in one pass with partial aggregation: a document becomes its (path, type) pairs, which are counted by
kind of document. A registered version is a row per field; versions of all kinds are one table of hash buckets, so
registering one kind rewrites that kind's buckets only, and older versions stay readable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.sources import bucketed

#: Levels of nested objects whose fields are listed; deeper ones count as objects.
DEPTH = 4
#: What a field's type may become without a reader of old data failing.
WIDER = {("integer", "decimal"), ("null", "integer"), ("null", "decimal"), ("null", "text"), ("null", "boolean"), ("null", "object"), ("null", "array")}
_OBJECT = "map<string,variant>"


class Incompatible(ValueError):
    """A version that readers of the last one can't read."""


def type_of(value: Column) -> Column:
    """integer, decimal, text, boolean, null, object or array."""
    name = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    known = {"BIGINT": "integer", "DECIMAL": "decimal", "DOUBLE": "decimal", "FLOAT": "decimal", "BOOLEAN": "boolean", "VOID": "null", "OBJECT": "object", "ARRAY": "array"}
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in known.values()]), F.array_position(F.array(*[F.lit(x) for x in known]), name).cast("int") - 1), F.lit("text"))


def fields(documents: DataFrame, kind: str, value: str, depth: int = DEPTH) -> DataFrame:
    """(kind, path, type, n): the fields of each kind of document, with the number of documents that have them.

    ``value`` is JSON text; a text that is no JSON object has no fields. A field that is seen as an integer and as a
    decimal is a decimal, one with null and another type has that type; else it is mixed.
    """
    level = documents.select(F.col(kind).alias("kind"), F.lit("").alias("path"), F.try_parse_json(value).alias("v"))
    found = None
    for _ in range(depth):
        level = level.select("kind", "path", F.explode(F.try_variant_get("v", "$", _OBJECT)).alias("k", "v"))
        level = level.select("kind", F.concat("path", F.when(F.col("path") == "", "").otherwise("."), "k").alias("path"), "v")
        one = level.select("kind", "path", type_of(F.col("v")).alias("type"))
        found = one if found is None else found.unionAll(one)
    seen = found.groupBy("kind", "path", "type").agg(F.count(F.lit(1)).alias("n"))
    types = F.array_sort(F.collect_set(F.when(F.col("type") != "null", F.col("type"))))
    merged = seen.groupBy("kind", "path").agg(types.alias("types"), F.sum("n").alias("n"))
    one_type = F.when(F.size("types") == 0, "null").when(F.size("types") == 1, F.get("types", F.lit(0))).when(F.array_join("types", ",") == "decimal,integer", "decimal").otherwise("mixed")
    return merged.select("kind", "path", one_type.alias("type"), "n")


def compare(registered: DataFrame, seen: DataFrame) -> DataFrame:
    """(kind, path, change, old_type, new_type, n): each field that is new, lost, widened or retyped; n documents have it now.

    A kind that isn't registered has new fields only; a registered kind that isn't seen at all has no drift.
    """
    old = registered.select("kind", "path", F.col("type").alias("old_type"))
    old = old.join(seen.select("kind").distinct(), "kind", "left_semi")
    both = old.join(seen.select("kind", "path", F.col("type").alias("new_type"), "n"), ["kind", "path"], "full")
    pair = F.concat_ws(">", "old_type", "new_type")
    change = F.when(F.col("old_type").isNull(), "new").when(F.col("new_type").isNull(), "lost").when(pair.isin([f"{a}>{b}" for a, b in sorted(WIDER)]), "widened").when(F.col("old_type") != F.col("new_type"), "retyped")
    return both.select("kind", "path", change.alias("change"), "old_type", "new_type", F.coalesce("n", F.lit(0)).alias("n")).where("change IS NOT NULL")


def registered(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(kind, path, type) of the latest version, or of a numbered one."""
    return bucketed.read(spark, path, version).select("kind", F.inline("fields"))


def register(seen: DataFrame, path: str, allow: tuple[str, ...] = ("new", "widened"), buckets: int = 16) -> int:
    """Make the fields of ``seen`` the next version of their kinds; other kinds stay. Returns the number of the version.

    Raises where a change is of a kind that isn't allowed; by default fields may come and widen, not go or change type.
    """
    spark = seen.sparkSession
    if bucketed.versions(spark, path):
        refused = compare(registered(spark, path), seen).where(~F.col("change").isin(list(allow)))
        shown = [f"{r['kind']}.{r['path']} {r['change']} ({r['old_type']} to {r['new_type']})" for r in refused.orderBy("kind", "path").limit(5).collect()]
        if shown:
            raise Incompatible("; ".join(shown))
    rows = seen.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("path", "type"))).alias("fields"))
    return bucketed.upsert(rows, path, "kind", buckets)["version"]
