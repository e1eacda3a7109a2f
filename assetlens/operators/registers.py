"""Filters, joins and rules of a register of declarations: what is shown, imported, searched, matched and drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlens.operators.ordered import running_totals


def with_children(rows: DataFrame, key: str, **children: tuple[DataFrame, list[str]]) -> DataFrame:
    """rows with a sorted array of structs for each child table (joined by key); none gives an empty array. Children are grouped before they meet the rows."""
    for name, (child, columns) in children.items():
        kind = f"array<struct<{', '.join(f'{c}: {child.schema[c].dataType.simpleString()}' for c in columns)}>>"
        lists = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        rows = rows.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return rows


def few_vehicles(sections: DataFrame, vehicles: DataFrame, key: str, text: str, most: int = 60) -> DataFrame:
    """Vehicles with a text, of sections that have no more than ``most`` of them."""
    named = vehicles.filter(F.col(text).isNotNull())
    many = named.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > most)
    return named.join(sections.select(key), key, "left_semi").join(many, key, "left_anti")


def region_incomes(rows: DataFrame, wages: DataFrame, most: float, without_offices: list[int], without_regions: list[int]) -> DataFrame:
    """Incomes that a report by region counts: positive, below a limit, above the minimum wage, of offices with a region."""
    kept = rows.filter((F.col("income") > 0) & (F.col("income") < most) & ~F.col("office_id").isin(without_offices) & F.col("region_id").isNotNull() & ~F.col("region_id").isin(without_regions))
    return kept.join(F.broadcast(wages.select("year", "min_wage")), "year").filter(F.col("income") / 12 > F.col("min_wage")).drop("min_wage")


def filtered_or_doubtful(found: DataFrame, group: str, fits: Column) -> DataFrame:
    """Of each query's hits those that fit; where none does, all of them, as doubtful ones."""
    marked = found.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    any_ = marked.groupBy(group).agg(F.bool_or("_fits").alias("_any"))
    return marked.join(any_, group).filter(F.col("_fits") | ~F.col("_any")).withColumn("doubtful", ~F.col("_any")).drop("_fits", "_any")


def file_date(name: Column) -> Column:
    """The day that a log file's name holds, as 20240131 or 2024-01-31."""
    return F.try_to_timestamp(F.regexp_replace(F.regexp_extract(name, r"(?<!\d)(20\d\d-?[01]\d-?[0-3]\d)(?!\d)", 1), "-", ""), F.lit("yyyyMMdd")).cast("date")


def may_be_declaration(text: Column, words: list[str]) -> Column:
    """All words, and a number of six digits (or three and three)."""
    low = F.lower(text)
    every = low.contains(words[0])
    for w in words[1:]:
        every = every & low.contains(w)
    return F.coalesce(every & text.rlike(r"\d{6}|\d{3} \d{3}"), F.lit(False))


def sites_to_visit(calls: DataFrame, site: str, ts: str, ok: Column, retries: int) -> DataFrame:
    """Sites whose failures since their last success are fewer than ``retries``, with the time of the last call; the longest unvisited first in order of last."""
    last_ok = calls.groupBy(site).agg(F.max(F.when(ok, F.col(ts))).alias("_ok"))
    seen = calls.join(last_ok, site).groupBy(site).agg(F.count_if(~ok & (F.col("_ok").isNull() | (F.col(ts) > F.col("_ok")))).alias("failures"), F.max(ts).alias("last"))
    return seen.filter(F.col("failures") < retries)


def bad_names(sections: DataFrame, doc: str, good: Column, estates: DataFrame) -> DataFrame:
    """Documents with more than one section of which fewer than a fifth have a good name, and without any real estate."""
    per = sections.groupBy(doc).agg(F.count("*").alias("sections"), F.count_if(good).alias("good"))
    return per.filter((F.col("sections") > 1) & (F.col("good") * 5 < F.col("sections"))).join(estates.select(doc), doc, "left_anti")


def newest_hit(rows: DataFrame, group: str, newest: str, hit: Column) -> DataFrame:
    """The newest row of each group that a search finds; older ones aren't looked at any more."""
    return rows.filter(hit).groupBy(group).agg(F.max(newest).alias(newest))


def reordered_key(name: Column) -> Column:
    """Equal for names of the same words in any order, ё as е."""
    return F.array_join(F.array_sort(F.filter(F.split(F.translate(F.lower(F.trim(name)), "ё", "е"), r"\s+"), lambda w: w != "")), " ")


def external_match(own: DataFrame, external: DataFrame) -> DataFrame:
    """own (id, host, name, old) to (id, entity): the external entity (entity, host, label) of the host. Of several: equal label and name,
    else the name begins with the label, else the label with the name; only if that leaves one. An old entity that differs stays."""
    both = own.join(external, "host")
    n = F.count("*").over(Window.partitionBy("id"))
    rank = F.when(F.col("label") == F.col("name"), 1).when(F.col("name").startswith(F.col("label")), 2).when(F.col("label").startswith(F.col("name")), 3)
    ranked = both.withColumn("_rank", F.when(n == 1, 0).otherwise(rank)).filter("_rank is not null")
    best = ranked.groupBy("id").agg(F.min("_rank").alias("_best"))
    one = ranked.join(best, "id").filter("_rank = _best").groupBy("id").agg(F.count("*").alias("_n"), F.min("entity").alias("entity")).filter("_n = 1").select("id", "entity")
    return own.select("id", "old").join(one, "id", "left").select("id", F.coalesce("old", "entity").alias("entity"))


def drawn(rows: DataFrame, id_: str, weight: str, n: int, seed: str) -> DataFrame:
    """n draws (draw, id) in proportion to whole-number weights, by a digest of the draw's number.

    Every id owns a range of the running sum of weights; ranges and draws meet by cells of the sum, so that no task sees all of them."""
    totals = rows.groupBy(F.col(id_)).agg(F.sum(weight).cast("bigint").alias("_w")).filter("_w > 0")
    placed = running_totals(totals, [F.col(id_)], _to="_w").withColumn("_from", F.col("_to") - F.col("_w"))
    whole = placed.agg(F.max("_to")).first()[0] or 0
    width = max(1, whole // 4096)
    cells = placed.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor((F.col("_to") - 1) / width))))
    number = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.col("draw").cast("string"))), 1, 12), 16, 10).cast("bigint")
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw")).withColumn("_at", F.floor(number / float(1 << 48) * whole)).withColumn("_cell", F.floor(F.col("_at") / width))
    return draws.join(cells, "_cell").filter("_from <= _at and _at < _to").select("draw", id_)


def merged_epochs(before: DataFrame, now: DataFrame, key: str, first: str) -> DataFrame:
    """All keys of both epochs: the row of now where there is one, else that of before; ``first`` is the earlier of both."""
    newer = now.withColumn("_new", F.lit(1)).unionByName(before.withColumn("_new", F.lit(0)))
    others = [c for c in now.columns if c not in (key, first)]
    return newer.groupBy(key).agg(F.min(first).alias(first), F.max_by(F.struct(*others), "_new").alias("_row")).select(key, first, "_row.*")


def golden_pool(pairs: DataFrame, label: str, order: list[Column], negatives_per_positive: int, fixes: DataFrame, keys: list[str]) -> DataFrame:
    """Labelled pairs with corrections put over them, all positives and so many negatives for each positive, in a fixed order."""
    fixed = pairs.join(fixes.withColumnRenamed(label, "_fixed"), keys, "left").withColumn(label, F.coalesce("_fixed", label)).drop("_fixed")
    yes = fixed.filter(F.col(label) == 1)
    n = yes.count() * negatives_per_positive
    return yes.unionByName(fixed.filter(F.col(label) == 0).orderBy(*order).limit(n))


def pauses(log: DataFrame, session: str, ts: str, is_head: Column) -> DataFrame:
    """Of each crawl: seconds, steps, head requests, steps a minute and the longest pause."""
    next_ = F.lead(ts).over(Window.partitionBy(session).orderBy(ts))
    rows = log.withColumn("_pause", F.unix_timestamp(next_) - F.unix_timestamp(ts)).withColumn("_head", is_head)
    per = rows.groupBy(session).agg((F.unix_timestamp(F.max(ts)) - F.unix_timestamp(F.min(ts))).alias("elapsed"), F.count("*").alias("steps"), F.count_if("_head").alias("heads"), F.max("_pause").alias("longest_pause"))
    return per.withColumn("per_minute", F.round(F.try_divide(60 * F.col("steps"), F.col("elapsed")), 4))
