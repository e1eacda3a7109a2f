"""Small helpers that the operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a doc_id that is null: it sorts after all others.
NULL_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where none is set, one of our own, but only on a single machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if sc.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store Spark has it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: A key with more than one of so many rows joins by broadcast (so many keys at most), as its rows would meet in one task.
SPREAD = 1000


def spread_join(rows: DataFrame, one_each: DataFrame, key: str, total: int) -> DataFrame:
    """rows with the one row that one_each has for their key. one_each.n tells how many rows have the key, total how many there are (at least)."""
    large = F.col("n") * SPREAD > total
    hot = F.broadcast(one_each.filter(large).drop("n"))
    rest = rows.join(hot.select(key), key, "left_anti").join(one_each.filter(~large).drop("n"), key)
    return rows.join(hot, key).unionByName(rest)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text that a shuffle partition is planned for, and buckets that it is cut into (a bucket is held in memory as a whole).
PART_BYTES, BUCKETS = 64 << 20, 4


def give_back() -> None:
    """Freed memory goes back to the machine: Python workers are used again by later stages and would keep their largest need."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the usual C library of Linux has it
        ctypes.CDLL(None).malloc_trim(0)


def layout(docs: DataFrame) -> tuple[int, int]:
    """How many shuffle partitions and buckets the texts of docs take, so that neither grows with the corpus."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    parts = max(partitions(docs.sparkSession), -(-size // PART_BYTES))
    return parts, BUCKETS * parts


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column without a copy, and each row's start in them (one more for the end). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_large_binary(column.type) else "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ids(column: pa.Array) -> np.ndarray:
    """An id column as int64, null as NULL_ID."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(pc.fill_null(column.cast(pa.int64()), NULL_ID).to_numpy(zero_copy_only=False), np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection), so that any bits of them can be used."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of equal length, one after the other, as one value of a shuffled row."""
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def unpack(blobs: list[bytes], dtypes: list[str]) -> list[np.ndarray]:
    """What pack() made, of many rows, put together again."""
    width = sum(np.dtype(d).itemsize for d in dtypes)
    parts: list[list[np.ndarray]] = [[] for _ in dtypes]
    for blob in blobs:
        n, at = len(blob) // width, 0
        for k, d in enumerate(dtypes):
            parts[k].append(np.frombuffer(blob, d, n, at))
            at += n * np.dtype(d).itemsize
    return [np.concatenate(p) if p else np.zeros(0, d) for p, d in zip(parts, dtypes, strict=True)]


def split_by(bucket: np.ndarray, columns: list[np.ndarray]) -> list[tuple[int, bytes]]:
    """(bucket, packed rows) for each bucket; within one, rows keep their order."""
    if not len(bucket):
        return []
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    ends = np.r_[cuts[1:], len(bucket)]
    return [(int(bucket[a]), pack([c[a:b] for c in columns])) for a, b in zip(cuts, ends, strict=True)]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, as maximal runs in order (touching ones join)."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, far = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.r_[True, starts[1:] > far[:-1]])
    return starts[new], far[np.r_[new[1:] - 1, len(far) - 1]]
