"""Exact substring dedup by a distributed suffix sort.

Only suffixes that can repeat are sorted: those whose window of ``length`` bytes shares a seed with another one (see
repeats.py, which decides no repeats). Suffixes stand by seed, the leading bytes of the suffix at the anchor, and ranges
of them are dealt over partitions by splitters that Spark samples (repartitionByRange), places included, so that a hot
seed spreads over several. A bucket sorts its suffixes by multikey quicksort, eight bytes a character: first the runs of
neighbouring suffixes that have one anchor as one string, which leaves one of equal runs, then each suffix of the runs
that are left. Suffixes below the seeds at a bucket's ends can go on in the next one: the first of each such string is
compared across boundaries by its 128-bit hash.

Nulls and empty texts give n_bytes 0. Rows with one doc_id and one text are one document; with other texts they are
ordered by a hash of the text. A null doc_id counts as larger than all others. Other columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.llm import repeats as R
from assetlens.llm.common import checkpoint, layout, mix, partitions, table, utf8

SEED = 32
#: Windows that are sorted at once, for bounded memory.
AT_ONCE = 1 << 17
#: Bytes of suffixes that a bucket sorts.
BUCKET_BYTES = 16 << 20


def multikey_order(words: np.ndarray, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of strings of 64-bit characters (a row each), apart for each part: the sorted order, and each place's group of equal strings.

    A range of strings that agree up to a depth is split by one character, three ways, at the median of its first,
    middle and last string's; the lesser and greater go on at that depth, the equal ones at the next. All ranges are
    split at once, and those of a single string leave."""
    n, depth = words.shape
    order = np.arange(n) if part is None else np.argsort(part, kind="stable")
    group = np.arange(n)
    if not n:
        return order, group
    heads = np.zeros(1, np.int64) if part is None else np.flatnonzero(np.r_[True, np.diff(part[order]) != 0])
    sizes, level = np.diff(np.r_[heads, n]), np.zeros(len(heads), np.int64)
    while True:
        keep = (sizes > 1) & (level < depth)
        done = (sizes > 1) & (level == depth)
        if done.any():
            at = np.repeat(heads[done] - np.r_[0, np.cumsum(sizes[done])[:-1]], sizes[done]) + np.arange(sizes[done].sum())
            group[at] = np.repeat(heads[done], sizes[done])
        heads, sizes, level = heads[keep], sizes[keep], level[keep]
        if not len(heads):
            return order, group
        before = np.r_[0, np.cumsum(sizes)[:-1]]
        at = np.repeat(heads - before, sizes) + np.arange(sizes.sum())
        row = order[at]
        value = words[row, np.repeat(level, sizes)]
        a, b, c = value[before], value[before + sizes // 2], value[before + sizes - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), sizes)
        sides, counts = [value < pivot, value == pivot, value > pivot], []
        for side in sides:
            counts.append(np.add.reduceat(side, before, dtype=np.int64))
        starts = [heads, heads + counts[0], heads + counts[0] + counts[1]]
        for side, count, start in zip(sides, counts, starts, strict=True):
            move = np.flatnonzero(side)
            order[np.repeat(start - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(len(move))] = row[move]
        heads, sizes = np.concatenate(starts), np.concatenate(counts)
        level = np.concatenate([level, level + 1, level])
        left = np.argsort(heads[sizes > 0], kind="stable")
        heads, sizes, level = (x[sizes > 0][left] for x in (heads, sizes, level))


def as_words(strings: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of big-endian 64-bit characters, filled with zeros."""
    n, width = strings.shape
    out = np.zeros((n, -(-width // 8) * 8), np.uint8)
    out[:, :width] = strings
    return out.view(">u8").astype(np.uint64)


def string_hash(words: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.full(len(words), salt, np.uint64)
        for k in range(words.shape[1]):
            h = mix(h ^ words[:, k]) + np.uint64(k + salt)
        return h


def _batches(seed: np.ndarray, place: np.ndarray) -> Iterator[np.ndarray]:
    """Rows (of windows, by seed) in sets of about AT_ONCE that hold all windows of a seed with one place of the anchor."""
    if not len(seed):
        return
    order = np.lexsort((place, seed))
    cuts = np.flatnonzero(np.r_[True, (np.diff(seed[order]) != 0) | (np.diff(place[order]) != 0)])
    last = 0
    for a, b in zip(cuts, np.r_[cuts[1:], len(order)], strict=True):
        if b - last > AT_ONCE and a > last:
            yield order[last:a]
            last = a
    yield order[last:]


def sorted_bucket(whole: pa.Table, length: int, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The suffixes of a bucket: spans (doc, sub, start, end) of those that repeat in it, and of the seeds at its ends the first
    window of each string, as (low, high, doc, sub, start)."""
    seeds, _ = utf8(whole["seed"])
    raw, offsets = utf8(whole["bytes"])
    windows, anchor = (whole[c].to_numpy().astype(np.int64) for c in ("windows", "anchor"))
    doc, sub, start = whole["doc"].to_numpy(), whole["sub"].to_numpy().view(np.uint64), whole["start"].to_numpy()
    width = int(np.diff(offsets).max())
    raw = np.r_[raw, np.zeros(width, np.uint8)]
    spans: list[list[np.ndarray]] = []
    edges: list[list[np.ndarray]] = []
    # suffixes by seed; those that agree as far as they go, in the place of their anchor too, are one string many times
    order, group = multikey_order(as_words(seeds.reshape(-1, seed)))
    of_seed = np.empty(len(order), np.int64)
    of_seed[order] = group
    ends = {int(of_seed[order[0]]), int(of_seed[order[-1]])}
    stays: list[np.ndarray] = []
    cuts = np.flatnonzero(np.r_[True, np.diff(group) != 0])
    last = 0
    for a, b in zip(cuts, np.r_[cuts[1:], len(order)], strict=True):
        if b < len(order) and b - last < AT_ONCE // 4:
            continue
        rows = order[last:b]
        last = b
        text = np.lib.stride_tricks.sliding_window_view(raw, width)[offsets[rows]]
        text[np.arange(width) >= np.diff(offsets)[rows, None]] = 0
        own, same = multikey_order(np.c_[(of_seed[rows] << 16 | windows[rows] << 8 | anchor[rows]).astype(np.uint64), as_words(text)])
        again, _, repeat, stay = R.firsts([same], doc[rows[own]], sub[rows[own]], start[rows[own]], False)
        gone = rows[own[again[repeat]]]
        spans.append([doc[gone], sub[gone], start[gone], start[gone] + windows[gone] - 1 + length])
        stays.append(rows[own[again[stay]]])
    left = np.concatenate(stays)
    several = np.bincount(of_seed[left], minlength=len(order))[of_seed[left]] > 1
    inside = np.isin(of_seed[left], list(ends))
    left = left[several | inside]  # one run of suffixes holds no string twice below one seed
    view = np.lib.stride_tricks.sliding_window_view(raw, length)
    ctx = np.repeat(left, windows[left])
    t = np.arange(len(ctx)) - np.repeat(np.cumsum(windows[left]) - windows[left], windows[left])
    for pick in _batches(of_seed[ctx], anchor[ctx] - t):
        c, p = ctx[pick], t[pick]
        words = as_words(view[offsets[c] + p])
        own, same = multikey_order(words, np.unique(of_seed[c] * length + anchor[c] - p, return_inverse=True)[1])
        c, p = c[own], p[own]
        again, _, repeat, stay = R.firsts([same], doc[c], sub[c], start[c] + p, False)
        gone = again[repeat]
        spans.append(R.runs(doc[c[gone]], sub[c[gone]], (start[c] + p)[gone], length))
        edge = again[stay]
        edge = edge[np.isin(of_seed[c[edge]], list(ends))]
        if len(edge):
            w = words[own[edge]]
            edges.append([string_hash(w, 1), string_hash(w, 2), doc[c[edge]], sub[c[edge]], (start[c] + p)[edge]])
    join = lambda parts: [np.concatenate(x) for x in zip(*parts, strict=True)]
    return join(spans), join(edges) if edges else []


def repeated_byte_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_units (bytes), spans (maximal removed runs), kept (the other bytes)."""
    seed = min(SEED, length)
    shape = parts, n_docs = layout(docs)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = checkpoint(R.find(docs, R.Bytes, length, seed, False, shape))
    docs_z = R.texts(docs, n_docs)
    ddl = "seed binary, doc bigint, sub bigint, start bigint, windows int, anchor int, bytes binary"
    schema = pa.schema([("seed", pa.binary()), ("doc", pa.int64()), ("sub", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("anchor", pa.int32()), ("bytes", pa.binary())])

    def cut(column, doc, sub, row, start, windows, anchor, crowded):
        raw, offsets = utf8(column)
        raw, a = raw.tobytes(), offsets[row] + start
        seeds = [raw[x : x + seed] for x in (a + anchor).tolist()]
        strings = [raw[x:y] for x, y in zip(a.tolist(), (a + windows - 1 + length).tolist(), strict=True)]
        return [pa.RecordBatch.from_arrays([pa.array(seeds, pa.binary()), pa.array(doc[row]), pa.array(sub[row].view(np.int64)), pa.array(start), pa.array(windows, pa.int32()), pa.array(anchor, pa.int32()), pa.array(strings, pa.binary())], schema=schema)]

    def sort(batches):
        whole = pa.Table.from_batches(list(batches), schema).combine_chunks()
        if not whole.num_rows:
            return
        spans, edges = sorted_bucket(whole, length, seed)
        yield R.spans(*spans, n_docs)
        if edges:
            yield R.widened(R._rows(R.packed_classes(*edges, n_docs)), R.SPANS_SCHEMA)

    # bytes of all open suffixes: a run of them has 23 bytes in found, and about six times as many of text
    size = found.filter(F.col("kind") == R.OPEN).agg(F.sum(F.length("rows"))).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), -(-size * 6 // BUCKET_BYTES))
    cut_out = R.with_open(docs_z, found, cut, schema, ddl, parts)
    sorted_ = cut_out.repartitionByRange(buckets, "seed", "doc", "sub", "start").mapInArrow(sort, R.SPANS)
    closed = R.close(sorted_, length, False, shape)

    def row(text: bytes, starts: list[int], ends: list[int]) -> tuple[int, bytes]:
        return len(text), b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)], strict=True))

    return R.finish(docs_z, closed, row, parts)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = repeated_byte_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return spans.select("doc_id", F.col("n_units").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
