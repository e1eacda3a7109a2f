"""Sharding by balanced label propagation: documents with equal texts go to one shard, and shards are equally large.

Documents with the same key (by default their text) are linked, each with each. Every document begins in a shard that a hash
names. In each round, documents move to the shard that holds most of their linked documents. Documents of one key in one
shard want the same, so a row with their number stands for them, and a round is: a groupBy that finds each key's favourite
shard, a join that tells it to all its rows, and a groupBy that adds up who wishes to go where. Quotas then keep every shard
within its capacity, a tenth above the mean number of bytes: wishes are admitted by hash bins of keys, with what leaves a shard
making room in it, so that a key's documents move together or wait for the next round. Shards that are full are no favourites.
Rounds end when no wish is left or none is admitted.

Keys too large to wait for room (over 1/64 of a shard, so at most 2048 of them) are placed before, the largest first, whole
where that fits, else over as few shards as hold them. Should shards be above the mean after the rounds, bins of keys leave
them. Documents without a link have no neighbours to go to; they fill the shards up, bin by bin from the largest documents to the
smallest. The driver only sees sums of bins, of a number that doesn't depend on the input.

Sizes are the UTF-8 bytes of a text plus 1. A null text is linked with empty ones (size 1, checksum 0). Rows that repeat are
linked like other copies; a null doc_id is no link. Columns other than doc_id and text are ignored. An empty table gives no
rows. Within a shard, slots number the documents without gaps, bucket by bucket, so no task numbers a whole shard. Documents
are told apart by a number that is written with them first, so that a lost executor changes nothing.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetlens.llm.common import remove_folder, shared_folder, table

#: A key is large beyond this part of a shard (in bytes or documents). Bins of keys that are admitted together, bins of one size of
#: documents without links, and bins that a key's documents are dealt to where it is split.
LARGE, QUOTA_BINS, FILL_BINS, SPLIT_BINS = 64, 64, 1024, 1024
#: While documents move, shards may hold so many times the mean.
SLACK = 1.1
#: Documents that one task numbers.
NUMBERED = 50_000


def by_text() -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256))


def bins(n: int, *of: str | Column) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")


def magnitude(size: str) -> Column:
    """The number of binary digits of a size."""
    return F.floor(F.log2(F.greatest(F.col(size), F.lit(1)))).cast("int")


def admitted(load: np.ndarray, wishes: np.ndarray, capacity: float) -> np.ndarray:
    """How many bins each shard admits. load: bytes by shard, wishes: bytes by (from, to, bin).

    All are admitted at first. A shard that would be too full then admits a bin less, which keeps bytes in the shards they come
    from, until no shard is too full or those that are admit none."""
    shards, _, n = wishes.shape
    upto = np.concatenate([np.zeros((shards, shards, 1)), np.cumsum(wishes, axis=2)], axis=2)
    open_ = np.full(shards, n)
    while True:
        flow = upto[:, np.arange(shards), open_]
        after = load + flow.sum(0) - flow.sum(1)
        full = (after > capacity) & (flow.sum(0) > 0)
        if not full.any():
            return open_
        open_[full] -= 1


def spread(n: int, size: float, load: np.ndarray, capacity: float) -> dict[int, int]:
    """Documents of one key by shard: all in the emptiest if they fit, else the emptiest shards are filled one after the other."""
    placed: dict[int, int] = {}
    while n:
        t = int(np.argmin(load))
        k = n if load[t] + n * size <= capacity else min(n, max(1, int((capacity - load[t]) / size), -(-n // (1 << 20))))
        placed[t] = placed.get(t, 0) + k
        load[t] += k * size
        n -= k
    return placed


def fill(load: np.ndarray, sizes: list[int]) -> list[int]:
    """The shard of each bin, in the order given: always the emptiest."""
    out = []
    for x in sizes:
        out.append(int(np.argmin(load)))
        load[out[-1]] += x
    return out


class _Tables:
    """Tables in the shared folder, each written once and removed when the next of its kind is."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/shards-{uuid.uuid4()}", 0
        self.last: dict[str, str] = {}

    def put(self, df: DataFrame, kind: str) -> DataFrame:
        path, self.n = f"{self.folder}/{self.n}", self.n + 1
        df.write.parquet(path)
        self.drop(kind)
        self.last[kind] = path
        return self.spark.read.parquet(path)

    def drop(self, kind: str) -> None:
        if kind in self.last:
            remove_folder(self.spark, self.last.pop(kind))


def _loads(cells: DataFrame, shards: int) -> np.ndarray:
    load = np.zeros(shards)
    for r in cells.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect():
        load[r.shard] = r.bytes
    return load


def _moved(cells: DataFrame, to: Column) -> DataFrame:
    return cells.select("key", to.alias("shard"), "n", "bytes").groupBy("key", "shard").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))


def propagate(cells: DataFrame, shards: int, base: np.ndarray, capacity: float, rounds: int, tables: _Tables) -> tuple[DataFrame, np.ndarray]:
    """Rounds of label propagation over cells (key, shard, n, bytes); base: bytes that are in the shards already. Cells and loads after it."""
    load = base + _loads(cells, shards)
    for k in range(rounds):
        tie, has_room = F.xxhash64("key", "shard", F.lit(k)), F.element_at(F.array(*(F.lit(bool(x < capacity)) for x in load)), F.col("shard") + 1)
        favourite = cells.groupBy("key").agg(F.max(F.struct(has_room, "n", tie, "shard")).alias("best"), F.count("*").alias("places")).filter("places > 1")
        favourite = favourite.select("key", F.col("best.shard").alias("to"), bins(QUOTA_BINS, "key", F.lit(k)).alias("bin"))
        wishes = np.zeros((shards, shards, QUOTA_BINS))
        for r in cells.join(favourite, "key").filter("shard != to").groupBy("shard", "to", "bin").agg(F.sum("bytes").alias("bytes")).collect():
            wishes[r.shard, r.to, r.bin] = r.bytes
        open_ = admitted(load, wishes, capacity)
        if not any(wishes[:, t, : open_[t]].sum() for t in range(shards)):
            break
        admits = F.col("bin") < F.element_at(F.array(*(F.lit(int(x)) for x in open_)), F.col("to") + 1)
        cells = tables.put(_moved(cells.join(favourite, "key", "left"), F.when(admits, F.col("to")).otherwise(F.col("shard"))), "cells")
        load = base + _loads(cells, shards)
    return cells, load


def _evened(cells: DataFrame, load: np.ndarray, capacity: float, tables: _Tables) -> tuple[DataFrame, np.ndarray]:
    """Bins of cells leave shards that are too full, the largest first, for the emptiest."""
    at = [F.col("shard"), magnitude("bytes").alias("class"), bins(QUOTA_BINS, "key").alias("bin")]
    leave = []
    for r in sorted(cells.groupBy(*at).agg(F.sum("bytes").alias("bytes")).collect(), key=lambda r: (-r["bytes"], r["shard"], r["class"], r["bin"])):
        t = int(np.argmin(load))
        if load[r["shard"]] - r["bytes"] >= load[t] + r["bytes"] and load[r["shard"]] > capacity:
            leave.append((r["shard"], r["class"], r["bin"], t))
            load[r["shard"]] -= r["bytes"]
            load[t] += r["bytes"]
    if leave:
        moves = cells.sparkSession.createDataFrame(leave, "shard int, class int, bin int, to int")
        joined = cells.withColumns({"class": at[1], "bin": at[2]}).join(F.broadcast(moves), ["shard", "class", "bin"], "left")
        cells = tables.put(_moved(joined, F.coalesce("to", "shard")), "cells")
    return cells, load


def balanced_shards(docs: DataFrame, shards: int = 16, key: Column | None = None, rounds: int = 10) -> DataFrame:
    """doc_id, size, text_crc32, key, shard and slot of every document. key: documents with equal values are linked (null: not linked)."""
    spark, tables, text = docs.sparkSession, _Tables(docs.sparkSession), F.coalesce(F.col("text").cast("string"), F.lit(""))
    number = F.monotonically_increasing_id()
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), (by_text() if key is None else key.cast("string").cast("binary")).alias("key"), number.alias("number"))
    # a document without a key is alone under its number
    rows = tables.put(rows.withColumn("key", F.coalesce("key", F.col("number").cast("string").cast("binary"))), "rows")
    first = bins(shards, "doc_id", "key", F.when(F.col("doc_id").isNull(), F.col("number")))
    cells = rows.groupBy("key", first.alias("shard")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    groups = tables.put(cells.groupBy("key").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.collect_list(F.struct("shard", "n", "bytes")).alias("cells")), "groups")
    total, many = (int(x or 0) for x in groups.agg(F.sum("bytes"), F.sum("n")).first())
    capacity, load = total / shards, np.zeros(shards)

    # large keys, at most 2 * LARGE * shards
    large = (F.col("n") > 1) & ((F.col("bytes") * (LARGE * shards) > total) | (F.col("n") * (LARGE * shards) > many))
    big = sorted(groups.filter(large).select("key", "n", "bytes").collect(), key=lambda r: (-r.bytes, bytes(r.key)))
    planned = {bytes(r.key): spread(r.n, r.bytes / r.n, load, capacity) for r in big}
    cut = [k for k, v in planned.items() if len(v) > 1]
    hot = [(k, -1, next(iter(v))) for k, v in planned.items() if len(v) == 1]
    deal = bins(SPLIT_BINS, "number")
    if cut:
        keys = F.broadcast(spark.createDataFrame([(k,) for k in cut], "key binary"))
        counted = rows.join(keys, "key").groupBy("key", deal.alias("bin")).agg(F.count("*").alias("n")).collect()
        for k in cut:
            left, done = list(planned[k].items()), 0
            for r in sorted((r for r in counted if bytes(r.key) == k), key=lambda r: r.bin):
                while len(left) > 1 and done + r.n / 2 > left[0][1]:
                    done -= left.pop(0)[1]
                hot.append((k, r.bin, left[0][0]))
                done += r.n
    hot = F.broadcast(spark.createDataFrame(hot, "key binary, bin int, shard int"))

    linked = groups.filter((F.col("n") > 1) & ~large).select("key", F.explode("cells").alias("c")).select("key", "c.shard", "c.n", "c.bytes")
    cells, load = propagate(tables.put(linked, "cells"), shards, load, SLACK * capacity, rounds, tables)
    if load.max() > capacity:
        cells, load = _evened(cells, load, capacity, tables)

    alone = (magnitude("bytes").alias("class"), bins(FILL_BINS, "key").alias("bin"))
    filled = sorted(groups.filter("n = 1").groupBy(*alone).agg(F.sum("bytes").alias("bytes")).collect(), key=lambda r: (-r["class"], -r["bytes"], r["bin"]))
    filled = [(r["class"], r["bin"], t) for r, t in zip(filled, fill(load, [r["bytes"] for r in filled]), strict=True)]
    filled = F.broadcast(spark.createDataFrame(filled, "class int, bin int, fill int"))

    # a key that is still in several shards deals its documents out by number; it has a row per shard, and no key here is large
    per = cells.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("at"))
    none = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("shard"))
    chosen = F.aggregate("at", none, lambda a, c: F.struct((a["seen"] + c["n"]).alias("seen"), F.coalesce(a["shard"], F.when(F.col("_own") <= a["seen"] + c["n"], c["shard"])).alias("shard")))["shard"]
    columns = ["doc_id", "size", "text_crc32", "key", "number"]
    in_hot = rows.join(hot, (rows["key"] == hot["key"]) & ((hot["bin"] == -1) | (hot["bin"] == deal))).select(*(rows[c] for c in columns), hot["shard"])
    others = rows.join(hot.select("key").distinct(), "key", "left_anti").join(per, "key", "left")
    others = others.withColumn("_own", F.row_number().over(Window.partitionBy("key").orderBy("number")))
    others = others.withColumns({"class": magnitude("size"), "bin": bins(FILL_BINS, "key")}).join(filled, ["class", "bin"], "left")
    others = others.select(*columns, F.when(F.col("at").isNull(), F.col("fill")).otherwise(chosen).alias("shard"))
    # buckets of a shard are numbered apart, behind those before them
    buckets = max(1, -(-many // (shards * NUMBERED)))
    placed = tables.put(in_hot.unionByName(others).withColumn("bucket", bins(buckets, "number", F.lit("slot"))), "placed")
    for kind in ("rows", "groups", "cells"):
        tables.drop(kind)
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("_n")).select("shard", "bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("number"))
    return placed.withColumn("_own", own).join(starts, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "key", "shard", (F.col("_start") + F.col("_own") - 1).alias("slot"))


def outside(sharded: DataFrame) -> DataFrame:
    """Documents that are linked, and those of them outside the shard that has most of their key's documents."""
    per = sharded.groupBy("key", "shard").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    return per.filter("n > 1").agg(F.sum("n").alias("linked"), F.sum(F.col("n") - F.col("most")).alias("outside"))


def op13_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = balanced_shards(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
