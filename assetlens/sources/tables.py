"""Parquet tables of the warehouse, and how the driver's tables stand in for it (README, "Bindings")."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Minimum wage and average income by year, in the units of the demo tables (fixed values of the demo).
WAGES = [(y, 400.0 + 50.0 * (y - 1992), 60_000.0 + 3_000.0 * (y - 1992)) for y in range(1992, 2003)]
WAGES_SQL = "(SELECT CAST(y AS INTEGER) AS year, 400.0 + 50.0 * (y - 1992) AS min_wage, 60000.0 + 3000.0 * (y - 1992) AS mean_income FROM range(1992, 2003) t(y))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wages(spark: SparkSession) -> DataFrame:
    """year, min_wage, mean_income: one row for each of some ten years, so it can be broadcast at any scale."""
    return spark.createDataFrame(WAGES, "year int, min_wage double, mean_income double")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declaration per row: orders stand for sections, customers for persons, nations for offices, segments for rubrics."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("section_id"), F.col("o_custkey").alias("person_id"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("income"), F.col("o_orderstatus").alias("status"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("person_name"), F.col("c_nationkey").alias("office_id"), F.col("c_mktsegment").alias("rubric"))
    return o.join(c, "person_id")


#: The same in SQL, to be put before a query as a common table expression.
SECTIONS_SQL = """sections AS (
    SELECT o_orderkey AS section_id, o_custkey AS person_id, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice AS income,
           o_orderstatus AS status, c_name AS person_name, c_nationkey AS office_id, c_mktsegment AS rubric
    FROM orders JOIN customer ON o_custkey = c_custkey)"""


def offices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("office_id"), F.col("n_name").alias("office"), F.col("n_regionkey").alias("region_id"))


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real estate of a section: lineitems of an order."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("section_id"), F.col("l_linenumber").alias("number"), F.col("l_quantity").alias("square"), F.col("l_returnflag").alias("own_type"), F.col("l_partkey").alias("vehicle_id"))
