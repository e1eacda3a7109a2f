"""Operators that need an order: places, ranks, series, carry-forward, resets and rates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlens.operators.graph import cut


def in_parts(df: DataFrame, order: list[Column]) -> DataFrame:
    """df in ranges of an order, the range's number in _part. Written once, so that the ranges are the same wherever they are used."""
    return cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))


def running_totals(df: DataFrame, order: list[Column], **sums: str | Column) -> DataFrame:
    """Running sums in an order over all rows, without one task seeing all of them: each range adds up its own rows, and the totals of
    the ranges (a row each) say where every range starts."""
    parts = in_parts(df.withColumns({f"_v_{name}": F.col(of) if isinstance(of, str) else of for name, of in sums.items()}), order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_part").agg(*(F.sum(f"_v_{name}").alias(f"_s_{name}") for name in sums))
    starts = starts.select("_part", *(F.coalesce(F.sum(f"_s_{name}").over(before), F.lit(0)).alias(f"_s_{name}") for name in sums))
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = parts.join(F.broadcast(starts), "_part").withColumns({name: F.sum(f"_v_{name}").over(own) + F.col(f"_s_{name}") for name in sums})
    return out.drop("_part", *(f"_{k}_{name}" for name in sums for k in "vs"))


def top_places(df: DataFrame, group: list[str], order: list[Column], n: int, least: int = 1) -> DataFrame:
    """The first n rows of each group of at least ``least`` rows, with their place and the number of competitors.

    row_number() below n lets Spark keep n rows per group and task before the shuffle; group sizes are counted apart, with partial
    sums, so that a large group is never sorted whole in one task."""
    places = df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("place") <= n)
    sizes = df.groupBy(*group).agg(F.count("*").alias("competitors")).filter(F.col("competitors") >= least)
    return places.join(sizes, group)


def first_of(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """One row of each group, the first in an order."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter("_place = 1").drop("_place")


def unique_ranks(df: DataFrame, key: str, of: str) -> DataFrame:
    """Unique ranks from 0 of keys by (number of distinct values desc, key desc), numbered range by range."""
    counts = df.groupBy(key).agg(F.countDistinct(of).alias("n"))
    return running_totals(counts, [F.col("n").desc(), F.col(key).desc()], rank=F.lit(1)).select(key, "n", (F.col("rank") - 1).alias("rank"))


def running(df: DataFrame, group: list[str], order: list[Column], **sums: str) -> DataFrame:
    """Running sums within a group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({name: F.sum(of).over(w) for name, of in sums.items()})


def carried_forward(df: DataFrame, group: list[str], order: list[Column], column: str, out: str) -> DataFrame:
    """The last value that isn't null, up to the row itself."""
    return df.withColumn(out, F.last(column, ignorenulls=True).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def islands(df: DataFrame, group: list[str], order: list[Column], starts: Column, out: str = "island") -> DataFrame:
    """Number runs of rows within a group; ``starts`` says where a new one begins."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def last_round(df: DataFrame, group: list[str], order: list[Column], value: str) -> DataFrame:
    """The rows since a value last grew: a queue that grows has begun a new round."""
    w = Window.partitionBy(*group).orderBy(*order)
    numbered = islands(df.withColumn("_before", F.lag(value).over(w)), group, order, F.col(value) > F.col("_before"), "_round")
    last = numbered.withColumn("_last", F.max("_round").over(Window.partitionBy(*group)))
    return last.filter("_round = _last").drop("_before", "_round", "_last")


def rates(df: DataFrame, group: list[str], ts: str, **seconds: int) -> DataFrame:
    """Events of the group in the last so many seconds, the row's own time included."""
    second = F.unix_timestamp(ts)
    return df.withColumns({name: F.count("*").over(Window.partitionBy(*group).orderBy(second).rangeBetween(-n, 0)) for name, n in seconds.items()})


def until_gap(df: DataFrame, group: str, order: str, gap: int) -> DataFrame:
    """Rows whose value is below the last kept one plus a gap; the fold depends on rows kept, so it runs over sorted batches of a group."""

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        last, kept = None, []
        for v in rows.sort_values(order)[order]:
            if last is None or v < last + gap:
                last = v
                kept.append(v)
        return rows[rows[order].isin(kept)]

    return df.groupBy(group).applyInPandas(keep, df.schema)


def key_ranges(counts: DataFrame, key: str, n: str, most: int) -> DataFrame:
    """Consecutive key ranges of about ``most`` rows: (low, high, rows), from counts by key. A range ends where the running sum of rows
    passes the next multiple of ``most``."""
    placed = running_totals(counts.select(key, n), [F.col(key)], _upto=n)
    return placed.groupBy(F.floor((F.col("_upto") - F.col(n)) / most).alias("_k")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.sum(n).alias("rows")).drop("_k")


def chunked(df: DataFrame, order: str, size: int) -> DataFrame:
    """A chunk number and a place in it for each row in order, as sitemaps need, without one task seeing all rows."""
    number = F.col("_number") - 1
    return running_totals(df, [F.col(order)], _number=F.lit(1)).withColumn("chunk", F.floor(number / size).cast("bigint")).withColumn("place", (number % size).cast("bigint")).drop("_number")
