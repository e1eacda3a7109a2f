"""Rules as data: JSON against a schema, the first of several keys, labels overridden by tables of patterns, offices of sites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlens.functions import urls

#: JSON types, by how Spark names the type of a variant.
KINDS = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING", "integer": "^BIGINT", "number": "^(BIGINT|DOUBLE|DECIMAL)", "boolean": "^BOOLEAN", "null": "^VOID"}


def schema_messages(json: Column, schema: dict) -> Column:
    """array<string> of what a JSON text has against a schema (type, enum, minimum, required, properties, items), in the schema's order; a text
    that is no JSON has one message, a null none."""
    parsed = F.try_parse_json(json)
    return F.when(json.isNull(), F.array().cast("array<string>")).when(parsed.isNull(), F.array(F.lit("$: no JSON"))).otherwise(_messages(parsed, schema, F.lit("$")))


def _messages(v: Column, schema: dict, at: Column) -> Column:
    none = F.array().cast("array<string>")
    say = lambda wrong, text: F.when(wrong, F.array(F.concat(at, F.lit(f": {text}")))).otherwise(none)
    found, kinds = [], schema.get("type")
    kind = F.schema_of_variant(v)
    if kinds:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        fits = reduce(lambda a, b: a | b, [kind.rlike(KINDS[k]) for k in kinds])
        found.append(say(~fits, f"not of type {' or '.join(kinds)}"))
    if "enum" in schema:
        found.append(say(~F.coalesce(F.try_variant_get(v, "$", "string").isin(schema["enum"]), F.lit(False)), f"not one of {', '.join(schema['enum'])}"))
    if "minimum" in schema:
        found.append(say(kind.rlike(KINDS["number"]) & (F.try_variant_get(v, "$", "double") < schema["minimum"]), f"below {schema['minimum']}"))
    for name, part in schema.get("properties", {}).items():
        child, place = F.try_variant_get(v, f"$.{name}", "variant"), F.concat(at, F.lit(f".{name}"))
        missing = F.array(F.concat(place, F.lit(": missing"))) if name in schema.get("required", []) else none
        found.append(F.when(~kind.rlike(KINDS["object"]), none).when(child.isNull(), missing).otherwise(_messages(child, part, place)))
    if "items" in schema:
        items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
        found.append(F.flatten(F.transform(items, lambda x, i: _messages(x, schema["items"], F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))))
    return F.concat(*found) if found else none


def projected(json: Column, fields: dict[str, list[str]]) -> Column:
    """struct of fields, each from the first of its paths that has a value; values of nested paths as JSON texts."""
    return F.struct(*(F.coalesce(*(F.nullif(F.get_json_object(json, p), F.lit("")) for p in paths)).alias(name) for name, paths in fields.items()))


def overridden(rows: DataFrame, label: str, text: str, rules: DataFrame) -> DataFrame:
    """rows with the label that the first rule gives whose old label (null: any) is the row's and whose pattern is found in its text.

    rules (priority, old, pattern, new) are a table that people keep by hand; it is joined, so its number of rows doesn't matter to the
    plan. Without a rule a row keeps its label."""
    # rules for any label meet every row, so they stand under each label that the rules and rows have
    labels = rows.select(F.col(label).alias("_old")).distinct()
    known = rules.filter("old is not null").select(F.col("old").alias("_old"), "priority", "pattern", "new").unionByName(labels.join(F.broadcast(rules.filter("old is null").select("priority", "pattern", "new"))))
    per = known.groupBy("_old").agg(F.array_sort(F.collect_list(F.struct("priority", "pattern", "new"))).alias("_rules"))
    met = rows.join(per, rows[label].eqNullSafe(per["_old"]), "left")
    hit = F.get(F.filter("_rules", lambda r: F.rlike(F.lower(F.coalesce(F.col(text), F.lit(""))), r["pattern"])), F.lit(0))["new"]
    return met.withColumn(label, F.coalesce(hit, F.col(label))).drop("_old", "_rules")


def offices_of_sites(refs: DataFrame, url: str, sites: DataFrame, redirects: DataFrame) -> DataFrame:
    """refs with office and by ('site', 'parent site', 'redirect', or null): the office of the URL's host, with or without www, else of the host
    without its first label, else of the host that it redirects to. sites (host, office) and redirects (host, to): one row a host."""
    host = lambda c: F.regexp_replace(F.lower(F.col(c)), r"^www\.", "")
    known = sites.select(host("host").alias("_h"), F.col("office").alias("_o")).groupBy("_h").agg(F.min("_o").alias("_o"))
    to = redirects.select(host("host").alias("_own"), host("to").alias("_to")).groupBy("_own").agg(F.min("_to").alias("_to"))
    own = refs.withColumn("_own", urls.host(F.col(url))).join(to, "_own", "left").withColumn("_up", F.regexp_extract("_own", r"^[^.]+\.(.+\..+)$", 1))
    for key, name in (("_own", "_site"), ("_up", "_parent"), ("_to", "_moved")):
        own = own.join(known.select(F.col("_h").alias(key), F.col("_o").alias(name)), key, "left")
    by = F.when(F.col("_site").isNotNull(), "site").when(F.col("_parent").isNotNull(), "parent site").when(F.col("_moved").isNotNull(), "redirect")
    return own.select(*refs.columns, F.coalesce("_site", "_parent", "_moved").alias("office"), by.alias("by"))
