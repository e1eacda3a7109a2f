"""Substring dedup by seed and extend.

Winnowing picks seeds of ``SEED`` words so that every window of ``window`` words holds one at the same place in each
copy (repeats.py). Documents are joined on seeds: all places with one seed meet, with the words around it. There each
seed is extended both ways by comparing words: places are sorted by the words to the right of the seed's start, and by
the words to its left, read backwards, so that how far neighbours agree says which places agree for any number of words.
A window is l words to the left and the rest to the right; places of one class on both sides have it in common, without
listing pairs. Windows found in a smaller doc_id are repeats; overlapping and touching ones join into maximal repeats,
none shorter than the window.

Seeds of very many places (a passage that a large share of the documents holds) don't meet in one task: their places are
extended bucket by bucket of documents, and the first window of each class there meets the others' under a 128-bit hash
of its words.

Nulls and empty texts have no words and give n_words 0. Rows with one doc_id never repeat each other, nor do repeated
rows; a null doc_id counts as larger than all others. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.llm import repeats as R
from assetlens.llm.common import checkpoint, layout, table, unpack

SEED = 16
PLACE = pa.schema([*R.SPANS_SCHEMA, ("seed", pa.int64()), ("windows", pa.int32()), ("anchor", pa.int32()), ("words", pa.binary())])
PLACE_DDL = f"{R.SPANS}, seed bigint, windows int, anchor int, words binary"
#: A row of PLACE that is a place; others are spans and packed rows.
SEEDED = 9


def _agreeing(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by group, then words: the order, and how many leading words each row has in common with the one before (-1: another group)."""
    n, width = words.shape
    pairs = np.zeros((n, -(-width // 2) * 2), np.uint64)
    pairs[:, :width] = words
    pairs = (pairs[:, ::2] << np.uint64(32)) | pairs[:, 1::2]
    order = np.lexsort((*pairs.T[::-1], group))
    words, group = words[order], group[order]
    common = np.full(n, -1)
    if n > 1:
        differ = words[1:] != words[:-1]
        common[1:] = np.where(group[1:] != group[:-1], -1, np.where(differ.any(1), differ.argmax(1), width))
    return order, common


def extended(codes: np.ndarray, at: np.ndarray, end: np.ndarray, group: np.ndarray, doc, sub, start, windows, anchor, window: int):
    """Extend places below their seeds. codes: all words as numbers from 1; a place's own are codes[at:end], its seed starts at at + anchor.

    Returns windows as (place, first word of the place): those that repeat, and those that stay as the first of their class."""
    n = len(at)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.r_[codes, np.zeros(1, codes.dtype)]
    most_left, head = int(anchor.max()), at + anchor
    right = head[:, None] + np.arange(window)
    right = codes[np.where(right < end[:, None], right, len(codes) - 1)]
    left = head[:, None] - 1 - np.arange(max(most_left, 1))
    left = codes[np.where(left >= at[:, None], left, len(codes) - 1)]
    classes = []
    for words in (right, left):
        order, common = _agreeing(words, group)
        classes.append((order, common))
    place = np.repeat(np.arange(n), windows)
    t = np.arange(len(place)) - np.repeat(np.cumsum(windows) - windows, windows)
    l = anchor[place] - t  # noqa: E741
    keys = np.zeros((2, len(place)), np.int64)
    by_l = np.argsort(l, kind="stable")
    cuts = np.searchsorted(l[by_l], np.arange(most_left + 2))
    own = np.empty(n, np.int64)
    for k in range(most_left + 1):
        rows = by_l[cuts[k] : cuts[k + 1]]
        if len(rows):
            for side, length in ((0, window - k), (1, k)):
                order, common = classes[side]
                own[order] = np.cumsum(common < length)
                keys[side, rows] = own[place[rows]]
    order, _, repeat, stays = R.firsts([l, keys[0], keys[1]], doc[place], sub[place], start[place] + t, True)
    again, stay = order[repeat], order[stays]
    return place[again], t[again], place[stay], t[stay]


def _codes(units: R.Words, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The words of places as numbers from 1, by the words themselves; 0 for words outside of all places."""
    steps = np.zeros(len(units.start) + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, end, -1)
    inside = np.flatnonzero(np.cumsum(steps[:-1]))
    text, codes = units.raw.tobytes(), np.zeros(len(units.start), np.uint64)
    words = pa.array([text[a:b] for a, b in zip(units.start[inside].tolist(), units.end[inside].tolist(), strict=True)], pa.large_binary())
    codes[inside] = pc.dictionary_encode(words).indices.to_numpy().astype(np.uint64) + np.uint64(1)
    return codes


def _spans(place, t, doc, sub, start, window: int, n_docs: int, schema: pa.Schema = R.SPANS_SCHEMA) -> pa.RecordBatch:
    return R.spans(*R.runs(doc[place], sub[place], start[place] + t, window), n_docs, schema)


def repeated_word_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_units (words), spans (maximal repeats, as word numbers), kept (the other words, joined by a space)."""
    seed = min(SEED, window)
    shape = parts, n = layout(docs)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = checkpoint(R.find(docs, R.Words, window, seed, True, shape))
    docs_z = R.texts(docs, n)

    def cut(column, doc, sub, row, start, windows, anchor, crowded):
        """Places of seeds that meet elsewhere, with their words; and what the crowded ones find in this bucket already."""
        units = R.Words(column)
        at = units.offsets[row] + start
        end = at + windows - 1 + window
        seeds, low, high = (np.zeros(k, np.uint64) for k in (len(at), 0, 0))
        doc, sub = doc[row], sub[row]
        hot = np.flatnonzero(crowded)
        out: list[pa.RecordBatch] = []
        with np.errstate(over="ignore"):
            runs = [(lo, hi, R.Sums(units(lo, hi)), R.Sums(units(lo, hi), 1)) for lo, hi, *_ in R.chunks(units.offsets, window)]
            for lo, hi, sums, _ in runs:
                pick = np.flatnonzero((at + anchor >= lo) & (at + anchor + seed <= hi))
                seeds[pick] = sums(at[pick] + anchor[pick] - lo, at[pick] + anchor[pick] - lo + seed)
            if len(hot):
                again, t, stay, s = extended(_codes(units, at[hot], end[hot]), at[hot], end[hot], np.unique(seeds[hot], return_inverse=True)[1], doc[hot], sub[hot], start[hot], windows[hot], anchor[hot], window)
                out.append(_spans(hot[again], t, doc, sub, start, window, n, PLACE))
                stay = hot[stay]
                first = at[stay] + s
                low, high = np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint64)
                for lo, hi, *sums in runs:
                    pick = np.flatnonzero((first >= lo) & (first + window <= hi))
                    low[pick], high[pick] = (x(first[pick] - lo, first[pick] - lo + window) for x in sums)
                out.append(R.widened(R._rows(R.packed_classes(low, high, doc[stay], sub[stay], start[stay] + s, n)), PLACE))
        cold = np.flatnonzero(crowded == 0)
        raw = units.raw.tobytes()
        words = [b" ".join(raw[a:b].split()) for a, b in zip(units.start[at[cold]].tolist(), units.end[end[cold] - 1].tolist(), strict=True)]
        if len(cold):
            bucket = (seeds[cold] % np.uint64(n)).astype(np.int32)
            columns = {"bucket": bucket, "kind": np.full(len(cold), SEEDED, np.int32), "doc": doc[cold], "sub": sub[cold].view(np.int64), "start": start[cold], "seed": seeds[cold].view(np.int64), "windows": windows[cold].astype(np.int32), "anchor": anchor[cold].astype(np.int32)}
            out.append(R.widened(pa.RecordBatch.from_arrays([*map(pa.array, columns.values()), pa.array(words, pa.binary())], names=[*columns, "words"]), PLACE))
        return out

    def meet(rows: pa.Table) -> pa.Table:
        """Extends all places of a bucket's seeds word by word; closes its classes of crowded seeds; spans pass through."""
        kind = rows["kind"].to_numpy()
        out = [b.cast(R.SPANS_SCHEMA) for b in rows.filter(pa.array(kind == R.DONE)).select(R.SPANS_SCHEMA.names).to_batches()]
        low, high, doc, sub, start = unpack(rows.filter(pa.array(kind == R.CLASS))["rows"].to_pylist(), R.CLASS_TYPES)
        order, _, repeat, _ = R.firsts([low, high], doc, sub, start, True)
        pick = order[repeat]
        out.append(R.spans(*R.runs(doc[pick], sub[pick], start[pick].astype(np.int64), window), n))
        places = rows.filter(pa.array(kind == SEEDED))
        if places.num_rows:
            words = pc.split_pattern(places["words"].combine_chunks().cast(pa.large_string()), " ")
            codes = pc.dictionary_encode(words.flatten()).indices.to_numpy().astype(np.uint64) + np.uint64(1)
            offsets = words.offsets.to_numpy().astype(np.int64)
            seeds, doc, sub, start = (places[c].to_numpy() for c in ("seed", "doc", "sub", "start"))
            windows, anchor = (places[c].to_numpy().astype(np.int64) for c in ("windows", "anchor"))
            place, t, *_ = extended(codes, offsets[:-1] - offsets[0], offsets[1:] - offsets[0], np.unique(seeds, return_inverse=True)[1], doc, sub.view(np.uint64), start, windows, anchor, window)
            out.append(_spans(place, t, doc, sub.view(np.uint64), start, window, n))
        return pa.Table.from_batches(out, R.SPANS_SCHEMA)

    places = R.with_open(docs_z, found, cut, PLACE, PLACE_DDL, parts)
    spans = places.repartition(parts, "bucket").groupBy("bucket").applyInArrow(meet, R.SPANS)

    def row(text: bytes, starts: list[int], ends: list[int]) -> tuple[int, bytes]:
        words = text.split()
        n_words = len(words)
        for a, b in zip(reversed(starts), reversed(ends), strict=True):
            del words[a:b]
        return n_words, b" ".join(words)

    return R.finish(docs_z, spans, row, parts)


def op7_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = repeated_word_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return spans.select("doc_id", F.col("n_units").alias("n_words"), removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
