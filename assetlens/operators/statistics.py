"""Group statistics of incomes, growth, gaps between groups, counters and shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlens.operators.graph import cut
from assetlens.operators.ordered import running_totals


def income_facts(sections: DataFrame, low: float, high: float, years: tuple[int, int]) -> DataFrame:
    """Sections of known persons whose income lies strictly between two bounds, in a range of years."""
    return sections.filter((F.col("income") > low) & (F.col("income") < high) & F.col("year").between(*years) & F.col("person_id").isNotNull())


def above_minimum_wage(facts: DataFrame, wages: DataFrame, months: int = 12) -> DataFrame:
    """Rows whose monthly income is at least the year's minimum wage; years without one go. wages has a row per year."""
    return facts.join(F.broadcast(wages), "year").filter(F.col("income") / months >= F.col("min_wage"))


def quantile(rows: DataFrame, keys: list[str], value: str, p: float, out: str) -> DataFrame:
    """The exact quantile (interpolated) of each group, of groups of any size; null values don't count.

    A sketch gives two values around it, between which two percent of a large group's rows lie; rows below are counted, and only those
    between are put in order. No group's values are held together. The sketch depends on the order in which its parts arrive, so it is written
once, and rows below are counted by the same values as rows between."""
    rows = rows.filter(F.col(value).isNotNull()).select(*keys, value)
    around = rows.groupBy(*keys).agg(F.percentile_approx(value, [max(0.0, p - 0.01), min(1.0, p + 0.01)], 10_000).alias("_q"), F.count("*").alias("_n"), F.min(value).alias("_min"), F.max(value).alias("_max"))
    small = F.col("_n") < 1000
    around = cut(around.select(*keys, "_n", F.when(small, F.col("_min")).otherwise(F.col("_q")[0]).alias("_low"), F.when(small, F.col("_max")).otherwise(F.col("_q")[1]).alias("_high")))
    near = rows.join(around, keys).filter(F.col(value) <= F.col("_high"))
    below = F.col(value) < F.col("_low")
    first = near.groupBy(*keys).agg(F.count_if(below).alias("_below"))
    placed = near.filter(~below).withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).join(first, keys)
    at = p * (F.col("_n") - 1)
    k = F.col("_k") + F.col("_below") - 1 - F.floor(at)
    two = placed.withColumn("_k", k).filter(F.col("_k").isin(0, 1)).groupBy(*keys).agg(F.max("_n").alias("_n"), F.max(F.when(F.col("_k") == 0, F.col(value))).alias("_a"), F.max(F.when(F.col("_k") == 1, F.col(value))).alias("_b"))
    return two.select(*keys, F.when(at == F.floor(at), F.col("_a")).otherwise((F.floor(at) + 1 - at) * F.col("_a") + (at - F.floor(at)) * F.col("_b")).alias(out))


def group_medians(facts: DataFrame, *keys: str) -> DataFrame:
    """Median and count of incomes, and distinct declarants, of each group."""
    counts = facts.groupBy(*keys).agg(F.count("*").alias("n_incomes"), F.countDistinct("person_id").alias("n_declarants"))
    return counts.join(quantile(facts, list(keys), "income", 0.5, "_m").withColumn("median_income", F.round("_m", 2)).drop("_m"), list(keys), "left")


def yearly_incomes(facts: DataFrame, *group: str) -> DataFrame:
    """One row per group, person and year: the largest income of that year."""
    return facts.groupBy(*group, "person_id", "year").agg(F.max("income").alias("income"))


def consecutive_growth(yearly: DataFrame, wages: DataFrame, *group: str) -> DataFrame:
    """For each group: pairs of consecutive years of a person, and the median of the declarant's growth over the population's."""
    series = Window.partitionBy(*group, "person_id").orderBy("year")
    pairs = yearly.withColumn("next", F.lead(F.struct("year", "income")).over(series)).filter(F.col("next.year") == F.col("year") + 1)
    mean = wages.select("year", "mean_income")
    pairs = pairs.join(F.broadcast(mean), "year").join(F.broadcast(mean.select((F.col("year") - 1).alias("year"), F.col("mean_income").alias("mean_next"))), "year")
    ratio = F.try_divide(F.try_divide(F.col("next.income"), F.col("income")), F.col("mean_next") / F.col("mean_income"))
    return pairs.groupBy(*group).agg(F.round(F.median(ratio), 2).alias("median_ratio"), F.count("*").alias("n_pairs"))


def first_last_growth(yearly: DataFrame, wages: DataFrame) -> DataFrame:
    """Per person with two valid years: truncated growth in percent from the first to the last, beside the population's."""
    valid = yearly.filter(F.col("income").isNotNull() & (F.col("income") > 0)).join(F.broadcast(wages), "year").filter(F.col("income") >= 12 * F.col("min_wage"))
    ends = valid.groupBy("person_id").agg(
        F.min("year").alias("min_year"), F.max("year").alias("max_year"),
        F.min_by("income", "year").alias("first"), F.max_by("income", "year").alias("last"),
        F.min_by("mean_income", "year").alias("mean_first"), F.max_by("mean_income", "year").alias("mean_last"),
    ).filter("max_year > min_year")
    percent = lambda a, b: F.try_divide(100 * (F.col(b) - F.col(a)), F.col(a)).cast("int")
    return ends.select("person_id", "min_year", "max_year", percent("first", "last").alias("declarant_growth"), percent("mean_first", "mean_last").alias("population_growth"))


def gap_by_class(facts: DataFrame, of: str, base: object, *sets: tuple[str, ...]) -> DataFrame:
    """Grouping sets (of, *set): count, median, and the truncated gap in percent of the base class's median over the own."""
    keys = sorted({k for s in sets for k in s})
    base_sql = "'" + str(base).replace("'", "''") + "'"
    groups = ", ".join("(" + ", ".join([of, *s]) + ")" for s in sets)
    columns = ", ".join([of, *keys])
    marks = ", ".join(f"grouping({k}) AS all_{k}" for k in keys)
    grouped = facts.sparkSession.sql(f"SELECT {columns}, {marks}, count(*) AS n, median(income) AS middle FROM {{facts}} GROUP BY GROUPING SETS ({groups})", facts=facts)
    flags = [f"all_{k}" for k in keys]
    own = grouped.alias("o")
    reference = grouped.filter(f"{of} = {base_sql}").select(*keys, *flags, F.col("middle").alias("base_middle"))
    same = [own[k].eqNullSafe(reference[k]) for k in [*keys, *flags]]
    gap = F.try_divide(100 * (F.col("base_middle") - F.col("middle")), F.col("middle")).cast("int")
    return own.join(reference, same, "left").select(*(own[c] for c in [of, *keys]), "n", F.round("middle", 2).alias("median_income"), gap.alias("gap"))


def share_of_total(df: DataFrame, value: str, *within: str, out: str = "share", digits: int = 4) -> DataFrame:
    """A row's part of its group's total."""
    total = F.sum(value).over(Window.partitionBy(*within))
    return df.withColumn(out, F.round(F.try_divide(F.col(value), total), digits))


def distinct_counters(facts: DataFrame, counters: dict[str, list[str]]) -> DataFrame:
    """One row of counts of distinct combinations; rows with a null in one don't count for it."""
    return facts.agg(*(F.countDistinct(*c).alias(name) for name, c in counters.items()))


def fan_out_free(parent: DataFrame, key: str, *children: tuple[DataFrame, dict[str, Column]]) -> DataFrame:
    """Sums of several child tables side by side: each is aggregated by the key first, so that no row counts twice; no rows give 0."""
    for child, aggregates in children:
        summed = child.groupBy(key).agg(*(c.alias(n) for n, c in aggregates.items()))
        parent = parent.join(summed, key, "left").fillna(0, list(aggregates))
    return parent


def too_small(stats: DataFrame, per_year: int, in_all: int, years: int, *group: str) -> DataFrame:
    """Groups kept for a report: years with more than per_year incomes, at least so many of them, over in_all incomes together."""
    own = Window.partitionBy(*group)
    usable = stats.filter(F.col("n_incomes") > per_year)
    return usable.withColumn("n_all", F.sum("n_incomes").over(own)).withColumn("n_years", F.count("*").over(own)).filter((F.col("n_all") > in_all) & (F.col("n_years") >= years))


def merged_regions(df: DataFrame, region: str, joined_to: dict[int, int]) -> DataFrame:
    """Regions that report as a part of another one take its id."""
    if not joined_to:
        return df
    mapping = F.create_map(*(F.lit(x) for pair in joined_to.items() for x in pair))
    return df.withColumn(region, F.coalesce(mapping[F.col(region)], F.col(region)))


def first_word_groups(df: DataFrame, text: str, least: int) -> DataFrame:
    """Median income by the first word of a text, for words of more than ``least`` rows."""
    word = F.lower(F.split(F.trim(text), r"\s+")[0])
    return df.withColumn("word", word).groupBy("word").agg(F.count("*").alias("n"), F.round(F.median("income"), 2).alias("median_income")).filter(F.col("n") > least)


def presence_index(parents: DataFrame, children: DataFrame, key: str, *group: str) -> DataFrame:
    """Share of a group's parents that have a child row (cars per declarant and the like)."""
    seen = children.select(key).distinct().withColumn("has", F.lit(1))
    return parents.join(seen, key, "left").groupBy(*group).agg(F.count("*").alias("n"), F.count("has").alias("n_with")).withColumn("index", F.round(F.col("n_with") / F.col("n"), 4))


def without_partner(children: DataFrame, key: str, kind: str, has: str, lacks: str) -> DataFrame:
    """Keys with a child row of one kind and none of another (families without a second parent)."""
    return children.filter(F.col(kind) == has).select(key).distinct().join(children.filter(F.col(kind) == lacks).select(key), key, "left_anti")


def pivot_shares(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of row by column, a column for each given value, and the share of all rows."""
    wide = df.groupBy(row).pivot(column, values).count().fillna(0)
    names = [str(v) for v in values]
    total = sum((F.col(f"`{n}`") for n in names), F.lit(0))
    return wide.withColumn("total", total).withColumn("percent", F.round(100 * F.col("total") / F.sum("total").over(Window.partitionBy()), 2))


def rank_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Spearman's rho of all pairs of columns (average ranks for ties), over rows without nulls.

    A column's values are counted first, so that each different value is put in order once, range by range, however many rows have it."""
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in columns]))
    for c in columns:
        counts = running_totals(rows.groupBy(c).agg(F.count("*").alias("_n")), [F.col(c)], _upto="_n")
        rows = rows.join(counts.select(c, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(f"_r_{c}")), c)
    rho = lambda a, b: F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = rows.agg(*(F.round(F.coalesce(rho(f"_r_{a}", f"_r_{b}"), F.lit(float("nan"))), 4).alias(f"_{k}") for k, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{k}").alias("rho")) for k, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")
