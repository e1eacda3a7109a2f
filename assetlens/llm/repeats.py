"""What both substring operators need: which places can repeat at all, their texts, and what is left without the repeats.

Every window of ``window`` units (bytes or words) holds an *anchor*: the unit at which the seed of ``seed`` units with
the smallest hash starts. Equal windows have their anchor at the same place, so a window can repeat only if its seed
occurs again. Neighbouring windows with one anchor form a *context*.

``find`` decides nothing about repeats: it opens the contexts whose seed (a hash of it) occurs more than once, which
loses none. ``with_open`` cuts open contexts from the texts; comparing them is up to the operator: seed_extend.py and
suffix_dedup.py. ``finish`` takes the spans that these found out of the texts.

A hot seed doesn't meet in one task: a batch opens its own contexts of a seed with more than ``HOT`` of them at once,
and sends one as a witness.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assetlens.llm.common import give_back, ids, merged, mix, pack, split_by, unpack, utf8

CHUNK = 1 << 20
#: Contexts of one seed from which on a batch, and the whole corpus, calls it crowded.
HOT, CROWD = 16, 4096
CONTEXT, DONE, OPEN, CLASS = 0, 1, 2, 3
CONTEXT_TYPES = ["<u4", "<i8", "<u8", "<u4", "u1", "u1", "u1"]  # seed, doc, sub, start, windows, anchor, whether its batch opened the seed
CLASS_TYPES = ["<u8", "<u8", "<i8", "<u8", "<u4"]  # string (128 bits), doc, sub, start
OPEN_TYPES = ["<i8", "<u8", "<u4", "u1", "u1", "u1"]  # doc, sub, start, windows, anchor, whether the seed is crowded
PACKED = "bucket int, kind int, rows binary"
PACKED_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("rows", pa.binary())])
#: A span (DONE) as a row of its own, by its document's bucket; or packed rows (CLASS).
SPANS = f"{PACKED}, doc bigint, sub bigint, start bigint, end bigint"
SPANS_SCHEMA = pa.schema([*PACKED_SCHEMA, ("doc", pa.int64()), ("sub", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_LOW = np.uint64((1 << 21) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_random = np.random.default_rng(20240229)
BYTE = _random.integers(0, 2**64, 256, dtype=np.uint64)
_BASES = [int(x) * 2 + 1 for x in _random.integers(2**61, 2**62, 2, dtype=np.uint64)]
_UP = [_powers(b, CHUNK + 4096) for b in _BASES]
_DOWN = [_powers(pow(b, -1, 2**64), CHUNK + 4096) for b in _BASES]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


class Sums:
    """Hashes of any substring of ``units`` from running sums: equal strings hash alike wherever they are."""

    def __init__(self, units: np.ndarray, which: int = 0):
        self.which, n = which, len(units)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(units * _DOWN[which][:n], out=self.sums[1:])

    def __call__(self, start, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _UP[self.which][start])

    def all_of(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:-length]) * _UP[self.which][:n])


class Bytes:
    """A batch of texts as UTF-8 bytes."""

    def __init__(self, column):
        self.raw, self.offsets = utf8(column)

    def __call__(self, a: int, b: int) -> np.ndarray:
        return BYTE[self.raw[a:b]]


class Words:
    """A batch of texts as hashes of words ``[^\\x20\\x09-\\x0D]+``; start and end: where each word is in the bytes."""

    def __init__(self, column):
        self.raw, at = utf8(column)
        space = _SPACE[self.raw]
        edge = np.zeros(len(space), bool)
        edge[at[:-1][at[:-1] < len(space)]] = True  # no word goes over the end of a text
        first = ~space & (np.r_[True, space[:-1]] | edge) if len(space) else space
        last = ~space & np.r_[space[1:] | edge[1:], True] if len(space) else space
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.offsets = np.searchsorted(self.start, at).astype(np.int64)
        self.hashes = np.zeros(len(self.start), np.uint64)
        i = 0
        while i < len(self.start):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + CHUNK, "right")))
            lo, hi = self.start[i], self.end[j - 1]
            if hi - lo > CHUNK:  # one huge word
                self.hashes[i] = xxhash.xxh3_64_intdigest(self.raw[lo:hi])
            else:
                self.hashes[i:j] = Sums(BYTE[self.raw[lo:hi]])(self.start[i:j] - lo, self.end[i:j] - lo)
            i = j

    def __call__(self, a: int, b: int) -> np.ndarray:
        return self.hashes[a:b]


def chunks(offsets: np.ndarray, window: int) -> Iterator[tuple]:
    """Runs of whole documents of CHUNK units at most; longer documents in parts that share window - 1 units."""
    i, n = 0, len(offsets) - 1
    while i < n:
        if offsets[i + 1] - offsets[i] > CHUNK:
            for s in range(offsets[i], offsets[i + 1] - window + 1, CHUNK):
                e = min(s + CHUNK + window - 1, offsets[i + 1])
                yield s, e, np.array([0, e - s]), np.array([i]), np.array([s - offsets[i]])
            i += 1
        else:
            j = int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1
            yield offsets[i], offsets[j], offsets[i : j + 1] - offsets[i], np.arange(i, j), np.zeros(j - i, np.int64)
            i = j


def contexts(units, window: int, seed: int) -> list[np.ndarray]:
    """Of all contexts in the batch: document's row, first window, number of windows, anchor from there, and seed hash."""
    found: list[list[np.ndarray]] = []
    with np.errstate(over="ignore"):
        for lo, hi, offsets, docs, base in chunks(units.offsets, window):
            if hi - lo < window:
                continue
            sums = Sums(units(lo, hi))
            hashes = sums.all_of(seed)
            least = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
            width, span = 1, window - seed + 1
            while width * 2 <= span:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < span:
                least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
            lengths = np.diff(offsets)
            doc = np.repeat(np.arange(len(docs)), lengths)[: len(least)]
            at = np.flatnonzero(np.arange(len(least)) + window <= np.repeat(offsets[1:], lengths)[: len(least)])
            if not len(at):
                continue
            anchor, doc = (least[at] & _LOW).astype(np.int64), doc[at]
            cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
            start, end = at[cut], at[np.r_[cut[1:], len(at)] - 1]
            anchor, doc = anchor[cut], doc[cut]
            found.append([docs[doc], start - offsets[doc] + base[doc], end - start + 1, anchor - start, hashes[anchor]])
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]


def bucket_of(doc: np.ndarray, sub: np.ndarray, n: int) -> np.ndarray:
    return (mix(mix(doc.astype(np.int64).view(np.uint64)) ^ sub.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def firsts(keys: list[np.ndarray], doc, sub, start, by_doc: bool):
    """Sort by keys, then place. Returns the order, each row's group, and whether it is a repeat, and whether it stays.

    by_doc: only rows of a larger doc repeat the first, and all rows of the smallest doc stay; else all later places
    repeat it. A place that occurs twice counts once."""
    order = np.lexsort((start, sub, doc, *reversed(keys)))
    keys, doc, sub, start = [k[order] for k in keys], doc[order], sub[order], start[order]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    group = np.cumsum(new) - 1
    head = np.flatnonzero(new)[group]
    same = np.zeros(len(order), bool)
    same[1:] = ~new[1:] & (doc[1:] == doc[:-1]) & (sub[1:] == sub[:-1]) & (start[1:] == start[:-1])
    if by_doc:
        repeat = doc > doc[head]
        return order, group, repeat, ~repeat & ~same
    repeat = (doc != doc[head]) | (sub != sub[head]) | (start != start[head])
    return order, group, repeat, new


def _several(seed, doc, sub, start, witness, by_doc: bool):
    """Sorted by seed: the order, how many rows each one's seed has, and whether it has more than one place (or a witness of more)."""
    order = np.argsort(seed, kind="stable")
    seed, doc, sub, start, witness = (x[order] for x in (seed, doc, sub, start, witness))
    heads = np.flatnonzero(np.r_[True, seed[1:] != seed[:-1]][: len(seed)])
    sizes = np.diff(np.r_[heads, len(seed)])
    apart = np.repeat(np.maximum.reduceat(doc, heads) != np.minimum.reduceat(doc, heads), sizes)
    if not by_doc:
        first = np.repeat(heads, sizes)
        apart |= np.repeat(np.logical_or.reduceat((sub != sub[first]) | (start != start[first]), heads), sizes)
    return order, np.repeat(sizes, sizes), apart, np.repeat(np.logical_or.reduceat(witness != 0, heads), sizes)


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(PACKED_SCHEMA)], schema=PACKED_SCHEMA)


def _typed(columns: list[np.ndarray], types: list[str]) -> list[np.ndarray]:
    return [c.astype(t) for c, t in zip(columns, types, strict=True)]


def _opened(doc, sub, start, n, anchor, crowded, n_docs: int) -> list[tuple[int, int, bytes]]:
    return [(b, OPEN, r) for b, r in split_by(bucket_of(doc, sub, n_docs), _typed([doc, sub, start, n, anchor, crowded], OPEN_TYPES))]


def keys_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """doc and sub, a 64-bit hash of the text: two rows with one doc_id are two documents unless their texts are equal."""
    raw, offsets = utf8(batch.column(1))
    return ids(batch.column(0)), np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64)


def find(docs: DataFrame, units: type, window: int, seed: int, by_doc: bool, shape: tuple[int, int]) -> DataFrame:
    """Packed rows (OPEN), by document, of all contexts over docs (doc_id, text) whose seed occurs at another place; in another doc, if by_doc."""
    parts, n_docs = shape

    def scan(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, sub = keys_of(batch)
            row, start, n, anchor, seeds = contexts(units(batch.column(1)), window, seed)
            if not len(row):
                continue
            columns = [doc[row], sub[row], start, n, anchor]
            bucket, seeds = ((seeds >> np.uint64(32)) % np.uint64(n_docs)).astype(np.int64), seeds.astype(np.uint32)
            order, number, *_ = _several(seeds, *columns[:3], np.zeros(len(row), bool), by_doc)
            bucket, seeds, columns = bucket[order], seeds[order], [c[order] for c in columns]
            crowded = number > HOT
            send = ~crowded | np.r_[True, seeds[1:] != seeds[:-1]]
            out = [(b, CONTEXT, r) for b, r in split_by(bucket[send], _typed([c[send] for c in (seeds, *columns, crowded)], CONTEXT_TYPES))]
            yield _rows(out + _opened(*(c[crowded] for c in (*columns, crowded)), n_docs))
        give_back()

    def settle(batches):
        blobs = []
        for batch in batches:
            kind = batch.column(1).to_numpy()
            blobs += [batch.column(2)[int(i)].as_py() for i in np.flatnonzero(kind == CONTEXT)]
            rest = batch.filter(pa.array(kind != CONTEXT))
            if rest.num_rows:
                yield rest
        columns = unpack(blobs, CONTEXT_TYPES)
        blobs.clear()
        if not len(columns[0]):
            return
        order, number, apart, crowded = _several(*columns[:4], columns[6], by_doc)
        columns = [c[order] for c in columns]
        go = (apart | crowded) & (columns[6] == 0)  # a witness was opened by its batch
        if out := _opened(*(c[go] for c in columns[1:6]), (crowded | (number > CROWD))[go], n_docs):
            yield _rows(out)
        del columns
        give_back()

    return docs.mapInArrow(scan, PACKED).repartition(parts, "bucket").mapInArrow(settle, PACKED)


def texts(docs: DataFrame, n_docs: int) -> DataFrame:
    """docs (doc_id, text and any others, which stay) with compressed texts, for shuffles by bucket."""
    rest = docs.schema.fields[2:]

    def squeeze(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            doc, sub = keys_of(batch)
            z = zstandard.ZstdCompressor(level=1, write_content_size=True)
            packed = [z.compress(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            own = [pa.array(bucket_of(doc, sub, n_docs), pa.int32()), batch.column(0).cast(pa.int64()), pa.array(sub.view(np.int64)), batch.column(1).is_null(), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(own + batch.columns[2:], names=["bucket", "doc_id", "sub", "missing", "z", *(f.name for f in rest)])
        give_back()

    return docs.mapInArrow(squeeze, StructType([*StructType.fromDDL("bucket int, doc_id bigint, sub bigint, missing boolean, z binary"), *rest]))


def unsqueezed(left: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    z = zstandard.ZstdDecompressor()
    return ids(left["doc_id"]), left["sub"].to_numpy().view(np.uint64), pa.array([z.decompress(x.as_py()) for x in left["z"]], pa.large_binary())


def by_bucket(left: DataFrame, right: DataFrame, parts: int):
    """Both sides' rows of each bucket, one bucket in memory at a time."""
    return left.repartition(parts, "bucket").groupBy("bucket").cogroup(right.repartition(parts, "bucket").groupBy("bucket"))


def with_open(docs_z: DataFrame, found: DataFrame, cut: Callable, schema: pa.Schema, ddl: str, parts: int) -> DataFrame:
    """cut(column of texts, doc, sub, open contexts as (row, start, windows, anchor, crowded)) over the documents of each bucket that have open contexts."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        doc, sub, *columns = unpack(right["rows"].to_pylist(), OPEN_TYPES)
        have = {k: i for i, k in reversed(list(enumerate(zip(ids(left["doc_id"]).tolist(), left["sub"].to_numpy().view(np.uint64).tolist(), strict=True))))}
        row = np.array([have[k] for k in zip(doc.tolist(), sub.tolist(), strict=True)], np.int64)
        kept, local = np.unique(row, return_inverse=True)
        d, s, column = unsqueezed(left.take(pa.array(kept)))
        return pa.Table.from_batches(cut(column, d, s, local, *(c.astype(np.int64) for c in columns)), schema)

    return by_bucket(docs_z, found.filter(F.col("kind") == OPEN).select("bucket", "rows"), parts).applyInArrow(both, ddl)


def close(classes: DataFrame, window: int, by_doc: bool, shape: tuple[int, int]) -> DataFrame:
    """Windows that tasks found to be the first of their string (CLASS), compared over all tasks; DONE rows pass through."""
    parts, n_docs = shape

    def last(batches):
        blobs = []
        for batch in batches:
            kind = batch.column(1).to_numpy()
            blobs += [batch.column(2)[int(i)].as_py() for i in np.flatnonzero(kind == CLASS)]
            rest = batch.filter(pa.array(kind == DONE))
            if rest.num_rows:
                yield rest
        low, high, doc, sub, start = unpack(blobs, CLASS_TYPES)
        blobs.clear()
        if len(doc):
            order, _, repeat, _ = firsts([low, high], doc, sub, start, by_doc)
            pick = order[repeat]
            yield spans(*runs(doc[pick], sub[pick], start[pick].astype(np.int64), window), n_docs)

    return classes.repartition(parts, "bucket").mapInArrow(last, SPANS)


def runs(doc, sub, start, window: int) -> list[np.ndarray]:
    """Windows that start one after the other in a document, as one span."""
    if not len(doc):
        return [doc, sub, start, start]
    order = np.lexsort((start, sub, doc))
    doc, sub, start = doc[order], sub[order], start[order]
    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1]) | (start[1:] > start[:-1] + 1)])
    last = np.r_[cut[1:], len(doc)].astype(np.int64) - 1
    return [doc[cut], sub[cut], start[cut], start[last] + window]


def widened(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """The batch with the schema's other columns, null."""
    have = dict(zip(batch.schema.names, batch.columns, strict=True))
    return pa.RecordBatch.from_arrays([have.get(f.name, pa.nulls(batch.num_rows, f.type)) for f in schema], schema=schema)


def spans(doc, sub, start, end, n_docs: int, schema: pa.Schema = SPANS_SCHEMA) -> pa.RecordBatch:
    """Rows (DONE) of spans."""
    columns = [bucket_of(doc, sub, n_docs).astype(np.int32), np.full(len(doc), DONE, np.int32), doc.astype(np.int64), sub.astype(np.uint64).view(np.int64), start.astype(np.int64), end.astype(np.int64)]
    return widened(pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "kind", "doc", "sub", "start", "end"]), schema)


def packed_classes(low, high, doc, sub, start, n: int) -> list[tuple[int, int, bytes]]:
    return [(b, CLASS, r) for b, r in split_by((low % np.uint64(n)).astype(np.int64), _typed([low, high, doc, sub, start], CLASS_TYPES))]


def finish(docs_z: DataFrame, found: DataFrame, row: Callable, parts: int) -> DataFrame:
    """For every document: doc_id, n_units, the union of its spans, and what is kept; row(text as bytes, starts, ends) gives n_units and kept."""
    types = {"n_units": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "kept": pa.binary()}

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, sub, column = unsqueezed(left)
        d, s, start, end = (right[c].to_numpy() for c in ("doc", "sub", "start", "end"))
        s = s.view(np.uint64)
        order = np.lexsort((start, s, d))
        d, s, start, end = d[order], s[order], start[order], end[order]
        cuts = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (s[1:] != s[:-1])][: len(d)])
        at = {(int(d[a]), int(s[a])): (a, b) for a, b in zip(cuts, [*cuts[1:], len(d)][: len(cuts)], strict=True)}
        result = []
        for text, key in zip(column, zip(doc.tolist(), sub.tolist(), strict=True), strict=True):
            a, b = at.get(key, (0, 0))
            starts, ends = merged(start[a:b], end[a:b])
            n, kept = row(text.as_py(), starts.tolist(), ends.tolist())
            result.append((n, [{"start": x, "end": y} for x, y in zip(starts.tolist(), ends.tolist(), strict=True)], kept))
        return pa.table({"doc_id": left["doc_id"].combine_chunks()} | {name: pa.array([r[k] for r in result], kind) for k, (name, kind) in enumerate(types.items())})

    return by_bucket(docs_z, found.filter(F.col("kind") == DONE).select("bucket", "doc", "sub", "start", "end"), parts).applyInArrow(both, "doc_id bigint, n_units bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
