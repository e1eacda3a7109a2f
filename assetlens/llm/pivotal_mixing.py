"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words; a document is then wanted target / source size times, which is a whole
number of copies and a fraction. Fractions are rounded in pairs: words move between two documents of a source, in a
random direction with odds that keep every document's expectation, until one of them is wanted a whole number of times.
So a source's words never change but for its last document. Parts of a source are rounded apart, each leaves one
document with a fraction, and these meet in a reduction tree whose last step rounds one document per source at random.

Sizes count words ``[^\\x20\\x09-\\x0D]+`` (null text: 0); a null source is a source of its own, sorted last. Rows that
repeat are documents of their own. A source without words has target 0. Documents without words are taken 0 times.
Randomness depends on the seed, the source and doc_ids only, so reruns agree. Other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetlens.llm.common import NULL_ID, checkpoint, table

#: Documents that one task rounds, and fractions that one node of the tree combines.
PART, FAN_IN = 5_000, 64
FIELDS = "doc_id bigint, text_hash bigint, source string, size bigint, copies double, part bigint, whole bigint, fraction double"


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, docs, target: all words shared by weights 1, 2, 3, ..., at most 3 times a source's size.

    Sources are filled to one level per weight. Sorted by size per weight, those before the level are full; the level is
    what the sources before leave over the weights that are left, at its largest."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", (1 + (F.row_number().over(order) - 1) % 3).cast("double")).withColumn("most", 3.0 * F.col("source_size"))
    filling = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = filling.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return per.select("source", "source_size", "docs", F.least("most", F.col("weight") * F.col("level")).alias("target"))


def pivotal(sizes: np.ndarray, fractions: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round fractions in place of all documents but one (-1: none is left), moving words from one to the other."""
    out, carry = fractions.tolist(), -1
    sizes, luck = sizes.tolist(), rng.random(len(sizes)).tolist()
    for b, f_b in enumerate(out):
        if sizes[b] == 0 or f_b in (0.0, 1.0):
            out[b] = float(f_b == 1.0)
            continue
        if carry < 0:
            carry = b
            continue
        a, f_a = carry, out[carry]
        s_a, s_b = sizes[a], sizes[b]
        to_b, to_a = min(s_a * f_a, s_b * (1 - f_b)), min(s_a * (1 - f_a), s_b * f_b)
        move = to_b if luck[b] * (to_a + to_b) < to_a else -to_a
        f_a, f_b = f_a - move / s_a, f_b + move / s_b
        f_a, f_b = (0.0 if f < 1e-12 else 1.0 if f > 1 - 1e-12 else f for f in (f_a, f_b))
        out[a], out[b] = f_a, f_b
        carry = -1 if f_a in (0.0, 1.0) and f_b in (0.0, 1.0) else a if f_a not in (0.0, 1.0) else b
    return np.array(out), carry


def _round(seed: int, level: int, last: bool):
    def each(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "text_hash"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        source = "" if key[0] is None or key[0] != key[0] else "s" + str(key[0])
        rng = np.random.default_rng([seed, level, int(key[1]), zlib.crc32(source.encode())])
        fractions, carry = pivotal(rows["size"].to_numpy(), rows["fraction"].to_numpy(float), rng)
        if carry >= 0 and last:
            fractions[carry] = float(rng.random() < fractions[carry])
            carry = -1
        rows["fraction"] = fractions
        done = np.arange(len(rows)) != carry
        rows.loc[done, "whole"] += fractions[done].astype(np.int64)
        rows["fraction"] = rows["fraction"].mask(done)
        rows["part"] = int(key[1])
        return rows

    return each


def mix_sources(docs: DataFrame, seed: int = 6) -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target, copies (an integer) of every row."""
    sizes = checkpoint(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size")))
    targets = checkpoint(source_targets(sizes))
    largest = targets.agg(F.max("docs")).first()[0]
    if largest is None:
        return sizes.select("*", F.lit(0).cast("bigint").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("bigint").alias("copies"))
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    parts = F.ceil(F.col("docs") / PART)
    rows = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).select(
        "doc_id", "text_hash", sizes["source"], "size", wanted.alias("copies"), F.pmod(F.xxhash64("doc_id", "text_hash"), parts).cast("bigint").alias("part"),
        F.floor(wanted).cast("bigint").alias("whole"), (wanted - F.floor(wanted)).alias("fraction"),
    )
    left, level = -(-largest // PART), 0
    done = None
    while True:
        last = left == 1
        rounded = rows.groupBy("source", "part").applyInPandas(_round(seed, level, last), FIELDS)
        if last:
            done = rounded if done is None else done.unionByName(rounded)
            break
        rounded = checkpoint(rounded)
        whole = rounded.filter(F.col("fraction").isNull())
        done = whole if done is None else done.unionByName(whole)
        rows = rounded.filter(F.col("fraction").isNotNull()).withColumn("part", F.floor(F.col("part") / FAN_IN).cast("bigint"))
        left, level = -(-left // FAN_IN), level + 1
    named = done.withColumnRenamed("source", "from")
    return named.join(targets, named["from"].eqNullSafe(targets["source"])).select("doc_id", "text_hash", "source", "size", "source_size", "target", F.col("whole").alias("copies"))


def mixed_documents(docs: DataFrame, seed: int = 6) -> DataFrame:
    """docs with their columns, each row as often as the mix takes it.

    Rows with one doc_id, source and text are one document, taken as often as all of them together."""
    key = [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("from")]
    names = ["id", "from", "text_hash"]
    taken = mix_sources(docs, seed).filter(F.col("copies") > 0).select(*key, "text_hash", "copies").groupBy(*names).agg(F.sum("copies").cast("int").alias("copies"))
    rows = docs.select(F.struct("*").alias("row"), *key, F.xxhash64(F.col("text").cast("string")).alias("text_hash")).join(taken, names).dropDuplicates(names)
    rows = rows.select("row", F.explode(F.sequence(F.lit(1), "copies")))
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op6_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
