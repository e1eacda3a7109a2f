"""Merging sources, matching by keys with ambiguity, surrogate keys, redirects, votes and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlens.operators.graph import cut
from assetlens.operators.ordered import running_totals


def unique_by(df: DataFrame, keys: list[str], value: str, equal_is_fine: bool = False) -> DataFrame:
    """Keys that lead to one row only; equal_is_fine: to one value only."""
    one = F.max(value) == F.min(value) if equal_is_fine else F.count("*") == 1
    return df.dropna(subset=keys).groupBy(*keys).agg(one.alias("_one"), F.min(value).alias(value)).filter("_one").drop("_one")


def two_key_match(left: DataFrame, right: DataFrame, first: list[str], second: list[str], value: str) -> DataFrame:
    """left with the value of right by the first key, else by the second; keys that are ambiguous in right don't match."""
    one = unique_by(right, first, value).withColumnRenamed(value, "_one")
    two = unique_by(right, second, value).withColumnRenamed(value, "_two")
    return left.join(one, first, "left").join(two, second, "left").withColumn(value, F.coalesce("_one", "_two")).drop("_one", "_two")


def variant_match(left: DataFrame, right: DataFrame, variants: list[Column], id_: str, value: str) -> DataFrame:
    """Match by the most detailed of several key strings that finds a unique value; of rows of one id the smallest value of that level.

    Levels go one after the other, and only ids that found nothing go on to the next."""
    rest, out = left, None
    for level, key in enumerate(variants):
        unique = unique_by(right.select(key.alias("_key"), value), ["_key"], value, equal_is_fine=True)
        found = rest.select(id_, key.alias("_key")).distinct().join(unique, "_key").groupBy(id_).agg(F.min(value).alias(value)).withColumn("level", F.lit(level))
        if level < len(variants) - 1:
            found = cut(found)
            rest = rest.join(found.select(id_), id_, "left_anti")
        out = found if out is None else out.unionByName(found)
    return out


def merged_documents(*sets: DataFrame) -> DataFrame:
    """sha256, ref rows of several document sets: one row per hash with all its distinct references, in order, and the count of sets."""
    rows = None
    for k, s in enumerate(sets):
        part = s.select("sha256", F.lit(k).alias("_set"), "ref")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("sha256").agg(F.array_sort(F.collect_set("ref")).alias("refs"), F.bit_or(F.expr("shiftleft(1, _set)")).alias("sets"))


def passport(*parts: Column) -> Column:
    """Key string of a section; nulls count as empty."""
    return F.concat_ws(";", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def first_seen(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the first in document order."""
    names = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_row")).select(key, "_row.*")


def surrogate_keys(new: DataFrame, old: DataFrame, first: str, second: str, order: str) -> DataFrame:
    """new with ``id``: that of the old row with the same first key, else the second; new ones go on from the largest old id.

    New ids are numbered range by range of the order (ordered.running_totals)."""
    by = lambda key: old.dropna(subset=[key]).groupBy(key).agg(F.min("id").alias(f"_{key}"))
    known = new.join(by(first), first, "left").join(by(second), second, "left").withColumn("id", F.coalesce(f"_{first}", f"_{second}")).drop(f"_{first}", f"_{second}")
    most = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_most"))
    fresh = running_totals(known.filter("id is null").drop("id"), [F.col(order)], _n=F.lit(1)).join(F.broadcast(most)).withColumn("id", (F.col("_most") + F.col("_n")).cast("bigint"))
    return known.filter("id is not null").select(*new.columns, F.col("id").cast("bigint")).unionByName(fresh.select(*new.columns, "id"))


def most_shared(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """For each left id the right id that shares most rows with it, of several the smallest."""
    counts = pairs.groupBy(left, right).agg(F.count("*").alias("n"))
    return counts.groupBy(left).agg(F.max_by(right, F.struct("n", -F.col(right))).alias(right), F.max("n").alias("n"))


def voted(answers: DataFrame, task: str, answer: str) -> DataFrame:
    """The answer with most votes, null on a tie, and whether all agree."""
    counts = answers.groupBy(task, answer).agg(F.count("*").alias("n"))
    return counts.groupBy(task).agg(F.max(F.struct("n", answer)).alias("_top"), F.max_by("n", "n").alias("_n"), F.collect_list("n").alias("_all"), F.count("*").alias("kinds")).select(
        task, F.when(F.size(F.filter("_all", lambda x: x == F.col("_n"))) == 1, F.col("_top")[answer]).alias("majority"), (F.col("kinds") == 1).alias("unanimous"))


def pair_quality(gold: DataFrame, found: DataFrame) -> DataFrame:
    """gold (a, b, yes) and found (a, b) pairs in any orientation: true and false positives, false negatives, precision, recall, F1."""
    turned = lambda df, *more: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *more)
    g = turned(gold, "yes").groupBy("a", "b").agg(F.max("yes").alias("yes"))
    f = turned(found).distinct().withColumn("hit", F.lit(True))
    both = g.join(f, ["a", "b"], "left")
    counts = both.agg(F.count_if(F.col("yes") & F.col("hit").isNotNull()).alias("tp"), F.count_if(~F.col("yes") & F.col("hit").isNotNull()).alias("fp"), F.count_if(F.col("yes") & F.col("hit").isNull()).alias("fn"))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", F.round(p, 4)).withColumn("recall", F.round(r, 4)).withColumn("f1", F.round(F.try_divide(2 * p * r, p + r), 4))


def bag_match(golden: DataFrame, test: DataFrame, doc: str, *fields: str) -> DataFrame:
    """Per document: fields matched one to one as bags, and the F-score of that."""
    count = lambda df, n: df.groupBy(doc, *fields).agg(F.count("*").alias(n))
    both = count(golden, "g").join(count(test, "t"), [doc, *fields], "full").fillna(0, ["g", "t"])
    sums = both.groupBy(doc).agg(F.sum(F.least("g", "t")).alias("tp"), F.sum(F.greatest(F.col("t") - F.col("g"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("g") - F.col("t"), F.lit(0))).alias("fn"))
    return sums.withColumn("f_score", F.round(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 4))


def precision_recall(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Points of the precision-recall curve, one for each distinct score; scores are counted first, so that rows aren't sorted."""
    by = scored.groupBy(score).agg(F.count("*").alias("n"), F.sum(label).alias("yes"))
    placed = running_totals(by, [F.col(score).desc()], tp="yes", found="n")
    return placed.join(F.broadcast(by.agg(F.sum("yes").alias("all_yes")))).select(score, F.round(F.col("tp") / F.col("found"), 4).alias("precision"), F.round(F.try_divide(F.col("tp"), F.col("all_yes")), 4).alias("recall"))
