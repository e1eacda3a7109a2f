"""Queries on rules kept as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.operators import rules
from assetlens.registry import query
from assetlens.sources.tables import table

SCHEMA = {
    "type": "object", "required": ["persons"],
    "properties": {"persons": {"type": "array", "items": {"type": "object", "required": ["name", "year"], "properties": {
        "name": {"type": "string"}, "year": {"type": ["integer", "null"]}, "relative": {"type": "string", "enum": ["S", "C"]}, "incomes": {"type": "array", "items": {"type": "number", "minimum": 0}}}}}},
}


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN '$.persons[0].name: missing' WHEN 2 THEN '$.persons[0].year: not of type integer or null' WHEN 3 THEN '$.persons[0].incomes[1]: below 0'
    WHEN 4 THEN '$.persons[0].relative: not one of S, C' WHEN 5 THEN '$: no JSON' ELSE '$.persons: missing' END AS messages FROM orders""")
def k2_schema_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations as JSON against a schema; six of seven have a fault of their own."""
    k, price = F.col("o_orderkey") % 7, F.col("o_totalprice").cast("string")
    person = F.concat(F.lit('{"persons": [{'), F.when(k == 1, "").otherwise('"name": "x", '), F.when(k == 2, '"year": "1999"').when(F.col("o_orderkey") % 2 == 0, '"year": null').otherwise('"year": 1999'),
                      F.when(k == 4, ', "relative": "Q"').when(F.col("o_orderkey") % 3 == 0, ', "relative": "S"').otherwise(""), F.lit(', "incomes": ['), price, F.when(k == 3, ", -1").otherwise(", 0"), F.lit("]}]}"))
    json = F.when(k == 5, F.lit('{"persons": [')).when(k == 6, F.lit('{"person": 5}')).otherwise(person)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(rules.schema_messages(json, SCHEMA), "; ").alias("messages"))


@query("""SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS person, CASE WHEN o_orderkey % 3 < 2 THEN o_orderstatus END AS status FROM orders""")
def f1_projected_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON under the keys of three formats."""
    k = F.col("o_orderkey") % 3
    json = F.when(k == 0, F.to_json(F.struct(F.struct(F.col("o_custkey").alias("id")).alias("person"), F.col("o_orderstatus").alias("state")))).when(k == 1, F.to_json(F.struct(F.col("o_custkey").alias("person_id"), F.lit("").alias("state"), F.col("o_orderstatus").alias("status")))).otherwise(F.to_json(F.struct(F.col("o_custkey").alias("owner"))))
    fields = {"person": ["$.person.id", "$.person_id", "$.owner"], "status": ["$.state", "$.status"]}
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), rules.projected(json, fields).alias("x")).select("id", "x.*")


@query("""SELECT p_partkey AS id, CASE WHEN p_type = 'ECONOMY' AND regexp_matches(p_name, 'red|blue') THEN 'colours' WHEN regexp_matches(p_name, 'ring$') THEN 'rings' WHEN p_type = 'ECONOMY' AND regexp_matches(p_name, '^s') THEN 's' ELSE p_type END AS rubric FROM part""")
def f3_overridden_rubrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rubrics by a table of rules, some for one rubric only, some for any."""
    table_ = spark.createDataFrame([(1, "ECONOMY", "red|blue", "colours"), (2, None, "ring$", "rings"), (3, "ECONOMY", "^s", "s")], "priority int, old string, pattern string, new string")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("rubric"), "p_name")
    return rules.overridden(rows, "rubric", "p_name", table_).select("id", "rubric")


@query("""SELECT o_orderkey AS id, CAST(CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN (o_custkey + 1) % 25 ELSE o_custkey % 25 END AS BIGINT) AS office, ['site', 'parent site', 'redirect', NULL][o_orderkey % 4 + 1] AS by FROM orders""")
def j17_offices_of_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to sites of nations: with www, of a part of a site, by a redirect, and of nobody's site."""
    k, n = F.col("o_orderkey") % 4, (F.col("o_custkey") % 25).cast("string")
    url = F.when(k == 0, F.concat(F.lit("http://www.Nation"), n, F.lit(".gov.example/a"))).when(k == 1, F.concat(F.lit("https://city.nation"), n, F.lit(".gov.example"))).when(k == 2, F.concat(F.lit("http://old"), n, F.lit(".example/x"))).otherwise(F.concat(F.lit("http://else"), n, F.lit(".example")))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"))
    sites = nations.select(F.concat(F.lit("www.nation"), F.col("k").cast("string"), F.lit(".gov.example")).alias("host"), F.col("k").alias("office"))
    redirects = nations.select(F.concat(F.lit("old"), F.col("k").cast("string"), F.lit(".example")).alias("host"), F.concat(F.lit("nation"), ((F.col("k") + 1) % 25).cast("string"), F.lit(".gov.example")).alias("to"))
    refs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), url.alias("url"))
    return rules.offices_of_sites(refs, "url", sites, redirects).select("id", "office", "by")
