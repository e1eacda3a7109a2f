"""How filters interact: what each removes first, again, alone or in vain, in every order of applying them.

Every document gets a mask with one bit for each filter that it fails. All but the last filter look at the text alone and
are native expressions; the last one fails where the same text has a smaller doc_id anywhere in the table, which a groupBy
of texts (under their sha256) decides. Documents are counted by part and mask: 32 cells for five filters. All orders are
then read off the cells: filter f, after the filters E, removes the cells that have f's bit and none of E's. So no order
touches a document again, and 80 pairs (E, f) say all of the 120 orders.

Shuffles carry an id, a digest and a mask for each document, never its text. Equal rows are folded into counts first, and
copies of a text before their group is looked at, so a group of copies of any size is a row for each part and label.

A null text counts as empty; a null part as an empty string; a null doc_id sorts after all others and has no label. Rows
that repeat a doc_id are documents of their own, and neither is smaller. A doc_id with several labels has those that any of
them gives; one without has none. Columns other than doc_id, text, the part and the two labels are ignored. An empty table
gives no cells and no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetlens.llm.common import table

WORDS = r"[^\x20\x09-\x0D]+"


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions by letter; words: the array of all words of the text."""
    n = F.size(words)
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n,
        "C": 100 * F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, part: str = "source", filters=text_filters) -> DataFrame:
    """doc_id, part, digest of the text and mask of the filters that look at the text alone, a row for each document."""
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    rows = rows.withColumn("_words", F.regexp_extract_all("_text", F.lit(WORDS), F.lit(0)))
    bits = [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(filters(F.col("_text"), F.col("_words")).values())]
    return rows.select("doc_id", "part", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))


def mask_histogram(docs: DataFrame, labels: DataFrame, part: str = "source", filters=text_filters) -> DataFrame:
    """part, mask, n, good and toxic (how many of the n have these labels); the highest bit says that the text repeats."""
    top = 1 << len(filters(F.lit(""), F.array(F.lit(""))))
    # ids that are null have no label to meet, so they are dealt out by their text
    key = F.coalesce(F.col("doc_id"), F.xxhash64("digest"))
    folded = masks(docs, part, filters).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")).withColumn("_key", key)
    known = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = folded.join(known, (F.col("_key") == F.col("_id")) & F.col("doc_id").isNotNull(), "left").fillna(0, ["good", "toxic"])
    # equal texts of a part and label: their number, their smallest id and how many rows have that
    id_ = F.coalesce(F.col("doc_id"), F.lit(2**63 - 1))
    copies = rows.groupBy("digest", "part", "mask", "good", "toxic", id_.alias("_at")).agg(F.sum("n").alias("n"))
    copies = copies.groupBy("digest", "part", "mask", "good", "toxic").agg(F.min(F.struct("_at", "n")).alias("first"), F.sum("n").alias("n"))
    copies = copies.withColumn("_least", F.min("first._at").over(Window.partitionBy("digest")))
    first = F.when(F.col("first._at") == F.col("_least"), F.col("first.n")).otherwise(0)
    split = F.explode(F.array(F.struct(F.lit(0).alias("bit"), first.alias("n")), F.struct(F.lit(top).alias("bit"), (F.col("n") - first).alias("n"))))
    cells = copies.select("part", "mask", "good", "toxic", split.alias("x")).filter("x.n > 0")
    return cells.groupBy("part", (F.col("mask") + F.col("x.bit")).cast("int").alias("mask")).agg(
        F.sum("x.n").alias("n"), F.sum(F.col("good") * F.col("x.n")).alias("good"), F.sum(F.col("toxic") * F.col("x.n")).alias("toxic"))


def orders(names: str) -> Mapping[tuple[int, int], list[tuple[str, int]]]:
    """For each (filters before, filter), as bits: the orders and steps at which they stand so."""
    found: dict[tuple[int, int], list[tuple[str, int]]] = {}
    for order in itertools.permutations(range(len(names))):
        before = 0
        for step, f in enumerate(order):
            found.setdefault((before, f), []).append(("".join(names[x] for x in order), step + 1))
            before |= 1 << f
    return found


def interactions(cells: DataFrame, names: str = "ABCDE") -> DataFrame:
    """part, filter_order, step and the counts of every step of every order, from cells. A part has at most 2 ** len(names) of them."""
    at = orders(names)
    both = F.array(*(F.struct(F.lit(e).alias("before"), F.lit(f).alias("f"), F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step")) for o, s in steps)).alias("steps")) for (e, f), steps in at.items()))
    many = len(list(itertools.permutations(names)))
    per = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def total(of: str, where) -> Column:
        return F.aggregate("cells", F.lit(0).cast("bigint"), lambda acc, c: acc + F.when(where(c["mask"]), c[of]).otherwise(0))

    bit, before = F.expr("shiftleft(1, x.f)"), F.col("x.before")
    has, free = (lambda m: m.bitwiseAND(bit) != 0), (lambda m: m.bitwiseAND(before) == 0)
    removed = lambda m: has(m) & free(m)
    #: a document that fails k filters meets each of them first in one of k orders
    shapley = F.aggregate("cells", F.lit(0).cast("bigint"), lambda acc, c: acc + F.when(has(c["mask"]), c["n"] * F.lit(many) / F.bit_count(c["mask"])).otherwise(0).cast("bigint"))
    counts = per.select("part", "cells", F.explode(both).alias("x")).select(
        "part", F.explode("x.steps").alias("at"),
        total("n", lambda m: free(m) & ~has(m)).alias("kept"), total("n", removed).alias("removed"), total("n", lambda m: has(m) & ~free(m)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"), total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), shapley.alias("shapley"),
    )
    return counts.select("part", "at.filter_order", "at.step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(mask_histogram(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


#: Applies every order to every document, one by one.
ORACLE_SQL = r"""
    WITH docs AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), fails AS (
        SELECT d.doc_id, part, {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w),
               'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
               'E': coalesce(d.doc_id, 9223372036854775807) > min(coalesce(d.doc_id, 9223372036854775807)) OVER (PARTITION BY t)} AS f,
               coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
        FROM docs d LEFT JOIN (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id
    ), letters AS (
        SELECT doc_id, part, good, toxic, (CASE WHEN f.A THEN 'A' ELSE '' END) || (CASE WHEN f.B THEN 'B' ELSE '' END) || (CASE WHEN f.C THEN 'C' ELSE '' END)
               || (CASE WHEN f.D THEN 'D' ELSE '' END) || (CASE WHEN f.E THEN 'E' ELSE '' END) AS failed
        FROM fails
    ), one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
        SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM one a, one b, one c, one d, one e
        WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
    ), steps AS (SELECT filter_order, CAST(s AS INTEGER) AS step, filter_order[s] AS letter, filter_order[1:s - 1] AS before FROM orders, range(1, 6) r(s)),
    applied AS (
        SELECT part, filter_order, step, letter, good, toxic, failed, contains(failed, letter) AS fails_it,
               len(regexp_replace(failed, '[^' || before || '-]', '', 'g')) > 0 AS gone
        FROM letters, steps
    ), counted AS (
        SELECT part, filter_order, step, letter, count(*) FILTER (NOT gone AND NOT fails_it) AS kept, count(*) FILTER (NOT gone AND fails_it) AS removed,
               count(*) FILTER (gone AND fails_it) AS redundant, count(*) FILTER (failed = letter) AS unique_fails,
               count(*) FILTER (NOT gone AND fails_it AND good = 1) AS good_lost, count(*) FILTER (NOT gone AND fails_it AND toxic = 1) AS toxic_lost
        FROM applied GROUP BY ALL
    )
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
    FROM counted
"""
