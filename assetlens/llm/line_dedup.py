"""Line dedup by a deletion-neighbourhood join.

Lines (between line feeds, white space at their ends aside) that an earlier line equals, or differs from by one edit (a
character inserted, deleted or replaced), are removed; earlier is by doc_id, then by line. Lines are judged on the
input, not on what is left, so the earliest line of a group always stays. Lines of white space stay and match nothing.
The bound is one edit for lines of every length.

Two lines are one edit apart where a deletion variant of one equals the other, or where variants of both, with the same
place deleted, are equal. So variants go out as hashed keys (one kind with the place, one without), equal ones meet, and
only the earliest line of a key has to be remembered: no pairs are listed. A removed line's partner is then verified by
edit distance. Keys are sums over characters, so that all variants of a line of L characters take time in L. Variants are sent only for lines that can have a partner: of two lines one edit apart, either the first
or the last half is equal (halves of the shorter one), and a 64-bit parity of characters differs in two bits at most.
That check loses no pair.

A null text has no lines, an empty one a single empty line. Rows with one doc_id and one text are one document; with
other texts they are ordered by a hash of the text. A null doc_id counts as larger than all others. Other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StructType

from assetlens.llm import repeats as R
from assetlens.llm.common import checkpoint, give_back, layout, mix, split_by, table, unpack

SPACE = " \t\n\v\f\r"
#: Lines of one half that a task compares one by one before it lets all of them pass; and that it sends of one half.
COMPARED, HOT = 64, 16
LINE, HALF = 4, 5
LINE_TYPES = ["<u8", "<u8", "<i8", "<u8", "<u4"]  # line (128 bits), doc, sub, number
HALF_TYPES = ["<u8", "<u8", "<u8", "<i8", "<u8", "<u4"]  # half, line, parity, doc, sub, number
PLACE_TYPES = ["<i8", "<u8", "<u4"]
VARIANT_TYPES = ["<u8", "<u8", "u1", "<i8", "<u8", "<u4"]  # variant (128 bits), role, doc, sub, number
VARIANT_BYTES = sum(np.dtype(t).itemsize for t in VARIANT_TYPES)
#: Bytes of variants that meet at once.
MEET_BYTES = 16 << 20
#: Roles below a variant: lines with this place deleted; whole lines; lines with any place deleted.
SAME_PLACE, WHOLE, SHORTER = 0, 1, 2
#: Characters whose variants are made at once.
AT_ONCE = 1 << 16
_random = np.random.default_rng(20240301)
_SALTS = _random.integers(0, 2**64, 2, dtype=np.uint64)
_BASES = [int(x) * 2 + 1 for x in _random.integers(2**61, 2**62, 2, dtype=np.uint64)]
_INVERSES = [np.uint64(pow(b, -1, 2**64)) for b in _BASES]
_POWERS = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(AT_ONCE, b, np.uint64)]) for b in _BASES]


def parity(line: str) -> int:
    """64 bits that say which characters (64 classes of them) occur an odd number of times."""
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return int(np.bitwise_xor.reduce(np.uint64(1) << ((c * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58))))


def halves(line: str) -> list[int]:
    """Four keys, one of which two lines share if they are one edit apart."""
    n, digest = len(line), xxhash.xxh64_intdigest
    out = []
    for m in (n - 1, n):  # the length of the shorter line
        a = m // 2
        out += [digest(line[:a].encode(), 2 * m), digest(line[n - (m - a) :].encode(), 2 * m + 1)]
    return out


def _sized(h: np.ndarray, length) -> np.ndarray:
    return mix(h + np.asarray(length).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _deletions(codes: np.ndarray, which: int, before, total, length, first: int) -> np.ndarray:
    """Keys of the strings without each of codes, which stand at first, ...; before, total: sums of what the line has before them and in all."""
    own = mix(codes ^ _SALTS[which]) * _POWERS[which][: len(codes)] * np.uint64(pow(_BASES[which], first, 2**64))
    upto = np.cumsum(own) + before
    return _sized(upto - own + (total - upto) * _INVERSES[which], length - 1)


def _codes(line: str) -> np.ndarray:
    return np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def variants(line: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys (low, high) and roles of all that the line sends: itself, and each deletion with and without its place; in parts."""
    codes, parts = _codes(line), range(0, len(line), AT_ONCE)
    with np.errstate(over="ignore"):
        sums = [[(mix(codes[a : a + AT_ONCE] ^ _SALTS[w]) * _POWERS[w][: len(codes[a : a + AT_ONCE])]).sum() * np.uint64(pow(_BASES[w], a, 2**64)) for a in parts] for w in (0, 1)]
        total = [np.add.reduce(np.array(x, np.uint64)) for x in sums]
        yield *(_sized(np.array([t]), len(line)) for t in total), np.array([WHOLE], np.uint8)
        before = [np.uint64(0), np.uint64(0)]
        for k, a in enumerate(parts):
            some = codes[a : a + AT_ONCE]
            shorter = [_deletions(some, w, before[w], total[w], np.uint64(len(line)), a) for w in (0, 1)]
            place = mix(np.arange(a + 1, a + len(some) + 1, dtype=np.uint64))
            same = [mix(h ^ place) for h in shorter]
            yield *(np.r_[x, y] for x, y in zip(shorter, same, strict=True)), np.repeat(np.array([SHORTER, SAME_PLACE], np.uint8), len(some))
            before = [x + sums[w][k] for w, x in enumerate(before)]


def one_edit(a: str, b: str) -> bool:
    """Whether the strings are exactly one edit apart, in time of their length."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    x, y = _codes(a), _codes(b)
    differ = np.flatnonzero(x != y[: len(x)])
    if len(a) == len(b):
        return len(differ) == 1
    k = int(differ[0]) if len(differ) else len(x)
    return bool((x[k:] == y[k + 1 :]).all())


def _passing(half, line, sig) -> np.ndarray:
    """Rows sorted by half that have a row of another line below it whose parity differs in two bits at most."""
    ok, n = np.zeros(len(half), bool), len(half)
    if not n:
        return ok
    heads = np.flatnonzero(np.r_[True, half[1:] != half[:-1]])
    sizes = np.diff(np.r_[heads, n])
    size, end = np.repeat(sizes, sizes), np.repeat(heads + sizes, sizes)
    distinct = np.add.reduceat(np.r_[True, (half[1:] != half[:-1]) | (line[1:] != line[:-1])].astype(np.int64), heads)
    ok[(size > COMPARED) & (np.repeat(distinct, sizes) > 1)] = True
    active, step = np.flatnonzero(size <= COMPARED), 1
    while len(active := active[active + step < end[active]]):
        a, b = active, active + step
        near = (np.bitwise_count(sig[a] ^ sig[b]) <= 2) & (line[a] != line[b])
        ok[a[near]] = ok[b[near]] = True
        step += 1
    return ok


def _places(doc, sub, number, kind: int, n: int) -> list[tuple[int, int, bytes]]:
    return [(b, kind, r) for b, r in split_by(R.bucket_of(doc, sub, n), R._typed([doc, sub, number], PLACE_TYPES))]


def _sort_halves(half, line, sig, doc, sub, number) -> list[np.ndarray]:
    """Sorted by half, line and place; of equal lines the first."""
    order = np.lexsort((number, sub, doc, line, half))
    columns = [c[order] for c in (half, line, sig, doc, sub, number)]
    first = np.r_[True, (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])][: len(order)]
    return [c[first] for c in columns]


def find(docs: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Packed rows, by document: lines that equal an earlier one (DONE), and first lines that can have a near one (OPEN)."""
    parts, n = shape

    def scan(batches):
        for batch in batches:
            doc, sub = R.keys_of(batch)
            whole, half = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for k, line in enumerate((text or "").split("\n")):
                    if line := line.strip(SPACE):
                        h = xxhash.xxh3_128_intdigest(line.encode(), 1)
                        whole.append((h & (2**64 - 1), h >> 64, i, k))
                        sig = parity(line)
                        half += [(x, h & (2**64 - 1), sig, i, k) for x in halves(line)]
            out = []
            if whole:
                low, high, i, k = (np.array(c, t) for c, t in zip(zip(*whole, strict=True), ("u8", "u8", "i8", "u4"), strict=True))
                order, _, repeat, stays = R.firsts([low, high], doc[i], sub[i], k, False)
                again, stay = order[repeat], order[stays]
                out += _places(doc[i][again], sub[i][again], k[again], R.DONE, n)
                out += [(b, LINE, r) for b, r in split_by((low[stay] % np.uint64(n)).astype(np.int64), R._typed([low[stay], high[stay], doc[i][stay], sub[i][stay], k[stay]], LINE_TYPES))]
            if half:
                x, h, sig, i, k = (np.array(c, t) for c, t in zip(zip(*half, strict=True), ("u8", "u8", "u8", "i8", "u4"), strict=True))
                x, h, sig, d, s, k = _sort_halves(x, h, sig, doc[i], sub[i], k)
                heads = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
                sizes = np.diff(np.r_[heads, len(x)])
                nth, crowded = np.arange(len(x)) - np.repeat(heads, sizes), np.repeat(sizes, sizes) > COMPARED
                out += _places(d[crowded], s[crowded], k[crowded], R.OPEN, n)
                send = ~crowded | (nth < COMPARED + 1)
                out += [(b, HALF, r) for b, r in split_by((x[send] % np.uint64(n)).astype(np.int64), R._typed([c[send] for c in (x, h, sig, d, s, k)], HALF_TYPES))]
            if out:
                yield R._rows(out)
        give_back()

    def settle(batches):
        lines, half = [], []
        for batch in batches:
            kind = batch.column(1).to_numpy()
            lines += [batch.column(2)[int(i)].as_py() for i in np.flatnonzero(kind == LINE)]
            half += [batch.column(2)[int(i)].as_py() for i in np.flatnonzero(kind == HALF)]
            rest = batch.filter(pa.array((kind == R.DONE) | (kind == R.OPEN)))
            if rest.num_rows:
                yield rest
        low, high, doc, sub, k = unpack(lines, LINE_TYPES)
        order, _, repeat, _ = R.firsts([low, high], doc, sub, k, False)
        again = order[repeat]
        out = _places(doc[again], sub[again], k[again], R.DONE, n)
        x, h, sig, doc, sub, k = _sort_halves(*unpack(half, HALF_TYPES))
        go = _passing(x, h, sig)
        out += _places(doc[go], sub[go], k[go], R.OPEN, n)
        if out:
            yield R._rows(out)
        give_back()

    return docs.mapInArrow(scan, R.PACKED).repartition(parts, "bucket").mapInArrow(settle, R.PACKED)


def near_lines(docs_z: DataFrame, found: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Packed DONE rows of lines that an earlier line of another text is one edit away from."""
    parts, n = shape
    opened = found.filter(F.col("kind") == R.OPEN).select("bucket", "rows")
    schema = pa.schema([("doc", pa.int64()), ("sub", pa.int64()), ("number", pa.int64()), ("line", pa.string())])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        places = sorted(set(zip(*(c.tolist() for c in unpack(right["rows"].to_pylist(), PLACE_TYPES)), strict=True)))
        doc, sub, column = R.unsqueezed(left)
        texts = {k: t for k, t in zip(zip(doc.tolist(), sub.tolist(), strict=True), column, strict=True)}
        split: dict = {}
        rows = []
        for d, s, k in places:
            if (d, s) not in split:
                split = {(d, s): texts[d, s].as_py().decode().split("\n")}
            rows.append((d, s - (s >> 63 << 64), k, split[d, s][k].strip(SPACE)))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    lines = checkpoint(R.by_bucket(docs_z, opened, parts).applyInArrow(cut, "doc bigint, sub bigint, number bigint, line string"))
    size = lines.agg(F.sum(2 * F.length("line") + 1)).first()[0] or 0
    buckets = max(parts, -(-size * VARIANT_BYTES // MEET_BYTES))

    def send(batches):
        for batch in batches:
            doc, sub, number = (batch.column(i).to_numpy() for i in range(3))
            made: list[tuple] = []
            rows = 0
            for i, line in enumerate(batch.column(3).to_pylist()):
                for low, high, role in variants(line):
                    made.append((np.full(len(low), i), low, high, role))
                    rows += len(low)
                    if rows > 1 << 18:
                        yield sent(made, doc, sub, number)
                        made, rows = [], 0
            if made:
                yield sent(made, doc, sub, number)

    def sent(made, doc, sub, number) -> pa.RecordBatch:
        at, low, high, role = (np.concatenate(c) for c in zip(*made, strict=True))
        packed = split_by((low % np.uint64(buckets)).astype(np.int64), R._typed([low, high, role, doc[at], sub[at].view(np.uint64), number[at]], VARIANT_TYPES))
        return R._rows([(b, R.CLASS, r) for b, r in packed])

    pairs_schema = pa.schema([("doc", pa.int64()), ("sub", pa.int64()), ("number", pa.int64()), ("to_doc", pa.int64()), ("to_sub", pa.int64()), ("to_number", pa.int64())])

    def meet(rows: pa.Table) -> pa.Table:
        low, high, role, doc, sub, number = unpack(rows["rows"].to_pylist(), VARIANT_TYPES)
        order = np.lexsort((number, sub, doc, role, high, low))
        low, high, role, doc, sub, number = (c[order] for c in (low, high, role, doc, sub, number))
        new = np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])]
        heads = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        out = []
        # a first line of each role below each key
        first = {r: np.full(len(heads), -1) for r in (SAME_PLACE, WHOLE, SHORTER)}
        for r, at in first.items():
            rows = np.flatnonzero(role == r)
            at[of[rows[::-1]]] = rows[::-1]
        for mine, other in ((SAME_PLACE, SAME_PLACE), (WHOLE, SHORTER), (SHORTER, WHOLE)):
            rows = np.flatnonzero(role == mine)
            to = first[other][of[rows]]
            rows, to = rows[to >= 0], to[to >= 0]
            later = (doc[to] < doc[rows]) | (doc[to] == doc[rows]) & ((sub[to] < sub[rows]) | (sub[to] == sub[rows]) & (number[to] < number[rows]))
            out.append((rows[later], to[later]))
        a, b = (np.concatenate(c) for c in zip(*out, strict=True))
        give_back()
        return pa.Table.from_arrays([pa.array(c[i].view(np.int64) if c is sub else c[i].astype(np.int64)) for i in (a, b) for c in (doc, sub, number)], schema=pairs_schema)

    def near(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series([one_edit(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    pairs = lines.mapInArrow(send, R.PACKED).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(meet, "doc bigint, sub bigint, number bigint, to_doc bigint, to_sub bigint, to_number bigint")
    pairs = pairs.groupBy("doc", "sub", "number").agg(F.min(F.struct("to_doc", "to_sub", "to_number")).alias("to")).select("doc", "sub", "number", "to.*")
    other = lines.select(F.col("doc").alias("to_doc"), F.col("sub").alias("to_sub"), F.col("number").alias("to_number"), F.col("line").alias("to_line"))
    verified = pairs.join(lines, ["doc", "sub", "number"]).join(other, ["to_doc", "to_sub", "to_number"]).filter(pandas_udf(near, "boolean")("line", "to_line"))

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                yield R._rows(_places(*(batch.column(i).to_numpy().view(t) for i, t in enumerate((np.int64, np.uint64, np.int64))), R.DONE, n))

    return verified.select("doc", "sub", "number").mapInArrow(place, R.PACKED)


def dedup_lines(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed, kept (the other lines, as they were) of every row; a null text stays null.

    carry: columns that go along, as fields of a column ``row``."""
    shape = parts, n = layout(docs)
    along = [F.struct(*map(docs.__getitem__, carry)).alias("row")] if carry else []
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *along)
    narrow = docs.select("doc_id", "text")
    found = checkpoint(find(narrow, shape))
    gone = found.unionByName(near_lines(R.texts(narrow, n), found, shape)).filter(F.col("kind") == R.DONE).select("bucket", "rows")

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, sub, column = R.unsqueezed(left)
        places: dict = {}
        for d, s, k in zip(*(c.tolist() for c in unpack(right["rows"].to_pylist(), PLACE_TYPES)), strict=True):
            places.setdefault((d, s), set()).add(k)
        rows = []
        for d, s, missing, text in zip(doc.tolist(), sub.tolist(), left["missing"].to_pylist(), column, strict=True):
            lines, out = [] if missing else text.as_py().decode().split("\n"), places.get((d, s), ())
            rows.append((len(lines), len(out), None if missing else "\n".join(x for k, x in enumerate(lines) if k not in out)))
        give_back()
        own = {name: pa.array([r[k] for r in rows], t) for k, (name, t) in enumerate((("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())))}
        return pa.table({"doc_id": left["doc_id"].combine_chunks()} | own | {name: left[name] for name in left.column_names[5:]})

    whole = R.texts(docs, n)
    schema = StructType([*StructType.fromDDL("doc_id bigint, n_lines bigint, n_removed bigint, kept string"), *whole.schema.fields[5:]])
    return R.by_bucket(whole, gone, parts).applyInArrow(both, schema)


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with their columns, texts without the lines that repeat; n_chars, where there is one, counts what is left.

    A document of which all lines go stays, with an empty text."""
    done = dedup_lines(docs, carry=docs.columns)
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return done.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dedup_lines(table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))
