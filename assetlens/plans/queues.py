"""Queries on the work queue and its cache: events are what happens to users' work, orders are cached versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.operators.graph import cut
from assetlens.registry import query
from assetlens.sources.tables import table
from assetlens.streaming import queue

#: What types of events stand for; the others are new work.
KINDS = {"error": "error", "purchase": "ok"}


@query()
def t1_work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, retries, results and keys given up, of a stream over events. It reads a copy of the table, as streams read folders."""
    cut(spark.range(1))  # the folder of checkpoints is set
    folder = f"{spark.sparkContext.getCheckpointDir()}/queue-{uuid.uuid4()}"
    kind = F.coalesce(*(F.when(F.col("event_type") == t, k) for t, k in KINDS.items()), F.lit("new"))
    table(spark, sf_dir, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), (F.col("event_id") % 7).cast("string")).alias("key"), "ts", kind.alias("kind"), F.col("event_id").cast("string").alias("value")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("key string, ts timestamp, kind string, value string").parquet(f"{folder}/in")
    actions = queue.work_queue(stream, most=3, patience=10**9)
    actions.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(queue.ACTIONS).parquet(f"{folder}/out")


@query("""WITH c AS (SELECT o_custkey AS key, CAST(year(o_orderdate) AS INTEGER) AS version, max(o_orderkey) AS value FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL),
    r AS (SELECT DISTINCT o_custkey AS key, CAST(year(o_orderdate) + o_orderkey % 3 - 1 AS INTEGER) AS version FROM orders)
    SELECT r.key, r.version, c.version AS found, c.value FROM r ASOF LEFT JOIN c ON r.key = c.key AND r.version >= c.version""")
def t2_cached_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest cached version up to the one asked for."""
    o = table(spark, sf_dir, "orders")
    cache = o.filter("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("key"), F.year("o_orderdate").alias("version"), F.col("o_orderkey").alias("value"))
    requests = o.select(F.col("o_custkey").alias("key"), (F.year("o_orderdate") + F.col("o_orderkey") % 3 - 1).cast("int").alias("version")).distinct()
    return queue.cached(cache, requests)
