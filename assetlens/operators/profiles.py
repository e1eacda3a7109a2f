"""Profiles of groups and series: partners, shares of a class, popularity, runs, scores against a golden answer, keys that are unique."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlens.operators.ordered import in_parts

from assetlens.operators.ordered import islands


def distinct_partners(df: DataFrame, of: str, partner: str) -> DataFrame:
    """How many different partners a value has: surnames of a first name, or first names of a surname. Nulls are neither."""
    return df.filter(F.col(of).isNotNull()).groupBy(of).agg(F.count_distinct(partner).alias("partners"), F.count("*").alias("n"))


def class_by_share(df: DataFrame, key: str, holds: Column, high: int = 90, low: int = 10) -> DataFrame:
    """A value is of the class if more than ``high`` percent of its rows are, of the other if less than ``low`` are (whole percents)."""
    share = F.floor(100 * F.count_if(holds) / F.count("*"))
    verdict = F.when(F.col("share") > high, 1).when(F.col("share") < low, 0)
    return df.groupBy(key).agg(share.alias("share"), F.count("*").alias("n")).withColumn("class", verdict)


def popularity_change(df: DataFrame, name: str, year: str, first: int, last: int) -> DataFrame:
    """A name's percentage of a year's rows in two years and the difference; names missing in one of them have 0 there."""
    counts = df.filter(F.col(year).isin(first, last)).groupBy(name).agg(F.count_if(F.col(year) == first).alias("a"), F.count_if(F.col(year) == last).alias("b"))
    everything = df.agg(F.count_if(F.col(year) == first).alias("all_a"), F.count_if(F.col(year) == last).alias("all_b"))  # one row
    share = lambda n, total: F.coalesce(F.round(100 * F.col(n) / F.nullif(F.col(total), F.lit(0)), 4), F.lit(0.0))
    found = counts.crossJoin(F.broadcast(everything)).select(name, share("a", "all_a").alias("before"), share("b", "all_b").alias("after"))
    return found.withColumn("change", F.round(F.col("after") - F.col("before"), 4))


def run_sums(df: DataFrame, group: list[str], order: list[Column], key: str, value: str) -> DataFrame:
    """Sums over runs of consecutive rows with one key."""
    before = df.withColumn("_before", F.lag(key).over(Window.partitionBy(*group).orderBy(*order)))
    runs = islands(before, group, order, ~F.col(key).eqNullSafe(F.col("_before")), "run")
    return runs.groupBy(*group, "run", key).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def ranges_by_distance(df: DataFrame, group: list[str], order: str, most: int) -> DataFrame:
    """Series cut where the next value is ``most`` or more away from the last: first and last value of each range, and its rows."""
    before = df.withColumn("_before", F.lag(order).over(Window.partitionBy(*group).orderBy(order)))
    cut = islands(before, group, [F.col(order)], F.col("_before").isNull() | (F.col(order) - F.col("_before") >= most), "range")
    return cut.groupBy(*group, "range").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def f_scores(df: DataFrame, by: str, said: Column, golden: Column) -> DataFrame:
    """Precision, recall and their harmonic mean of each annotator's answers; 0 where nothing is right."""
    hits, n_said, n_golden = F.count_if(said & golden), F.count_if(said), F.count_if(golden)
    return df.groupBy(by).agg(hits.alias("hits"), n_said.alias("said"), n_golden.alias("golden")).withColumn("f", F.coalesce(F.round(2 * F.col("hits") / F.nullif(F.col("said") + F.col("golden"), F.lit(0)), 6), F.lit(0.0)))


def subset_of_previous(df: DataFrame, group: list[str], order: list[Column], members: str) -> DataFrame:
    """Whether all members of a row's set are in the set of the row before it (null in a group's first row)."""
    w = Window.partitionBy(*group).orderBy(*order)
    before = F.lag(members).over(w)
    return df.withColumn("subset", F.when(before.isNotNull(), F.size(F.array_except(members, before)) == 0))


def by_unique_keys(records: DataFrame, reference: DataFrame, value: str, *keys: list[str]) -> DataFrame:
    """The value of the first key, from the left, that only one value of the reference has; keys of several values do not match."""
    found, names = records, []
    for i, key in enumerate(keys):
        unique = reference.dropna(subset=key).groupBy(*key).agg(F.min(value).alias(f"_v{i}"), F.max(value).alias("_most")).filter(F.col(f"_v{i}") == F.col("_most")).drop("_most")
        found, names = found.join(unique, key, "left"), [*names, f"_v{i}"]
    return found.withColumn(value, F.coalesce(*names)).drop(*names)


def falls(history: DataFrame, order: str, metrics: list[str]) -> DataFrame:
    """Metrics that must not shrink and did, against the snapshot before: order, metric, before, value. Snapshots are few."""
    long = history.select(order, F.explode(F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*(F.col(m).cast("double") for m in metrics)))).alias("metric", "value"))
    before = F.lag("value").over(Window.partitionBy("metric").orderBy(order))
    return long.withColumn("before", before).filter("value < before").select(order, "metric", "before", "value")


def text_hash(c: Column) -> Column:
    """h = 31 h + code point over a text without white space, as a signed number of 32 bits."""
    codes = F.transform(F.split(F.regexp_replace(c, r"\s", ""), ""), lambda x: F.ascii(x).cast("bigint"))
    h = F.aggregate(F.filter(codes, lambda x: x > 0), F.lit(0).cast("bigint"), lambda h, x: (h * 31 + x).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(h >= 2**31, h - 2**32).otherwise(h)


def passport(*columns: Column) -> Column:
    """A record's key as text: parts joined by semicolons, missing ones empty, so that parts keep their places."""
    return reduce(lambda a, b: F.concat(a, F.lit(";"), b), [F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def amount_links(records: DataFrame, block: list[str], id_: str, amount: str) -> DataFrame:
    """Links (a, b, p) between records of a block that follow one another in order of amount; p is the ratio of their amounts.

    Amounts in order are linked at any threshold just as all pairs of the block are: if two amounts are near enough, so are all that
    lie between them. So n - 1 links do, and a record's nearest mate is one of its two neighbours. Amounts must be positive."""
    order = [*map(F.col, block), F.col(amount), F.col(id_)]
    parts = in_parts(records.filter(F.col(amount) > 0).select(*block, F.col(id_).alias(id_), F.col(amount).alias(amount)), order)
    w = Window.partitionBy("_part", *block).orderBy(amount, id_)
    placed = parts.select("_part", *block, F.col(id_).alias("b"), F.col(amount).alias("_y"), F.lag(F.struct(F.col(id_).alias("a"), F.col(amount).alias("x"))).over(w).alias("_before"))
    # a block that goes on from one range to the next: the last record there and the first one here
    last = parts.groupBy("_part", *block).agg(F.max_by(F.struct(F.col(id_).alias("a"), F.col(amount).alias("x")), F.struct(amount, id_)).alias("_last"))
    over = last.select("_part", *block, F.lag("_last").over(Window.partitionBy(*block).orderBy("_part")).alias("_over"))
    linked = placed.join(over, ["_part", *block], "left").withColumn("_before", F.coalesce("_before", "_over")).filter("_before is not null")
    return linked.select(F.col("_before.a").alias("a"), "b", F.round(F.col("_before.x") / (F.col("_y") + 1e-9), 6).alias("p"))


def rare_and_rich(persons: DataFrame, name_ranks: DataFrame, surname_ranks: DataFrame, name: str, surname: str, income: str, most: float, least: float) -> DataFrame:
    """Persons whose ranks of name and surname have a product below ``most`` and whose income is above ``least``.

    The ranks come as (value, rank) of all names; the income filter goes before the joins."""
    first = name_ranks.select(F.col(name_ranks.columns[0]).alias(name), F.col("rank").alias("_first"))
    second = surname_ranks.select(F.col(surname_ranks.columns[0]).alias(surname), F.col("rank").alias("_second"))
    rich = persons.filter(F.col(income) > least).join(first, name).join(second, surname)
    return rich.filter(F.col("_first") * F.col("_second") < most).drop("_first", "_second")


def status_changes(before: DataFrame, after: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """How many keys changed from one status to another between two runs, and whether that is up, down or the same in ``order``
    (worst first). A key or status missing in a run has the status null, below all others."""
    place = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, order)), c), F.lit(0))
    both = before.select(key, F.col(status).alias("before")).join(after.select(key, F.col(status).alias("after")), key, "full")
    counts = both.groupBy("before", "after").agg(F.count("*").alias("n"))
    moved = place(F.col("after")) - place(F.col("before"))
    return counts.withColumn("change", F.when(moved > 0, "up").when(moved < 0, "down").otherwise("same"))
