"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has one or more words of 64 bits from XXH64 hashes of word shingles. Bits are grouped into parts so that
correlated bits stand together, and each part i gets its own threshold t_i, where the sum of (t_i + 1) is the bound + 1:
two fingerprints within the bound then differ by at most t_i in some part i. Dynamic programming picks the thresholds
(-1 leaves a part out) that make the estimated number of probes and candidates least, from statistics of all
fingerprints.

Distinct fingerprints are filed under their value of every part that counts, and probe the values within t_i of theirs;
of two fingerprints only the one whose first differing bit is set probes. Values that many fingerprints share, and keys
below which more than ``RUN`` rows meet, are split further by pieces of the bits, bound + 1 of them, of which one must be
equal. Candidates are verified below each key: those at most ``within`` bits apart link (the bound itself, unless a
larger number is given; then pairs between the two link where they meet). Of the links found a spanning forest of the
nearest goes on, so that a group of n fingerprints sends n rows and not n * n; and where one fingerprint of a long key
links to most others, only the rest is compared any further.

``one_of_each`` takes links for candidates only: a link counts if the texts' shingle sets have the similarity.

Nulls and texts without words have the fingerprint 0 and link like any other. Rows that repeat (also of one doc_id)
get the same fingerprint and component. A null doc_id is never a component's name unless no other is there (null
then). Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.llm.common import NULL_ID, checkpoint, give_back, mix, partitions, split_by, spread_join, table, unpack, utf8
from assetlens.llm.components import components

WORD = 64
#: Runs of candidates at least this long are first compared with a few of their fingerprints.
LONG_RUN, PIVOTS = 64, 4
#: Runs of candidates longer than this are split further, so many times at most.
RUN, LEVELS = 4096, 6
#: Costs of a probe and of a candidate, in units of the same time.
PROBE_COST, PAIR_COST = 40.0, 1.0
#: At most this many (part, value) pairs are hot: those with more than 1/HOT_SHARE of the fingerprints.
HOT_SHARE, HOT_LEAST = 4096, 4096


def shingle_hashes(text: bytes, size: int) -> list[int]:
    words = text.lower().split()  # of bytes: A-Z only, and white space as in [\x20\x09-\x0D]
    if not words:
        return []
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    line = b" ".join(words)
    starts = np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], 42) for a, b in zip(starts[: -size - 1].tolist(), (starts[size:] - 1).tolist(), strict=False)] + [digest(line[starts[-size - 1] :], 42)]


def fingerprint(text: bytes, size: int, words: int = 1) -> list[int]:
    """Words of 64 bits: the first from the hashes as they are, others from the hashes scrambled."""
    hashes = shingle_hashes(text, size)
    if not hashes:
        return [0] * words
    h, ones = np.array(hashes, "<u8"), np.zeros((words, WORD), np.int64)
    for a in range(0, len(h), 1 << 14):
        for w in range(words):
            own = h[a : a + (1 << 14)] if w == 0 else mix(h[a : a + (1 << 14)] ^ np.uint64(w))
            ones[w] += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), axis=1, bitorder="little").view("<u8")[:, 0].tolist()


def name(words: list[np.ndarray]) -> np.ndarray:
    """One number for each fingerprint: itself, if it has one word, else a hash of all."""
    out = words[0]
    for word in words[1:]:
        out = mix(mix(out) ^ word)
    return out


def words_of(bits: pa.Array) -> list[np.ndarray]:
    """A column of fingerprints (bigint, or binary of several words) as one array for each word."""
    if pa.types.is_int64(bits.type):
        return [bits.to_numpy(zero_copy_only=False).view(np.uint64)]
    rows = np.frombuffer(b"".join(bits.to_pylist()), "<u8").reshape(len(bits), -1)
    return [np.ascontiguousarray(rows[:, w]) for w in range(rows.shape[1])]


def fingerprints(docs: DataFrame, shingle: int = 4, words: int = 1) -> DataFrame:
    """doc_id and fp (bigint) of every row; with more than one word also bits (binary), and fp is their hash."""

    def each(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            raw = raw.tobytes()
            fps = np.array([fingerprint(raw[a:b], shingle, words) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], "<u8").reshape(-1, words)
            columns = [batch.column(0), pa.array(name([np.ascontiguousarray(fps[:, w]) for w in range(words)]).view(np.int64))]
            if words > 1:
                columns.append(pa.array([row.tobytes() for row in fps], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "bits"][: len(columns)])
        give_back()

    schema = "doc_id bigint, fp bigint" + (", bits binary" if words > 1 else "")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, schema)


def bit_statistics(nodes: DataFrame, n_bits: int = WORD) -> tuple[int, np.ndarray]:
    """The number of fingerprints and how often two bits are both set, over all of them; a task sends a row for each pair of bits at most."""

    def count(batches):
        total, n = np.zeros((n_bits, n_bits)), 0
        for batch in batches:
            words = words_of(batch.column(0))
            for a in range(0, len(words[0]), 1 << 14):
                bits = np.concatenate([(word[a : a + (1 << 14), None] >> np.arange(WORD, dtype=np.uint64)) & np.uint64(1) for word in words], axis=1).astype(np.float32)
                total += bits.T @ bits
                n += len(bits)
        i, j = np.triu_indices(n_bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[i * n_bits + j, -1]), pa.array(np.r_[total[i, j].astype(np.int64), n])], names=["cell", "n"])

    cells = dict(nodes.mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n")).collect())
    n = cells.pop(-1, 0)
    both = np.zeros((n_bits, n_bits))
    for cell, k in cells.items():
        both[cell // n_bits, cell % n_bits] = both[cell % n_bits, cell // n_bits] = k
    return n, both


def correlated_parts(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m parts of about equal width: each starts with the bit that correlates most with the free ones and takes its nearest."""
    p = np.diag(both) / max(n, 1)
    deviation = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    near = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(deviation, deviation)
    np.fill_diagonal(near, 0)
    free, parts = list(range(len(both))), []
    for k in range(m):
        width = (len(both) - sum(map(len, parts))) // (m - k)
        part = [free[int(near[np.ix_(free, free)].sum(1).argmax())]]
        free.remove(part[0])
        while len(part) < width:
            best = free[int(near[np.ix_(free, part)].sum(1).argmax())]
            part.append(best)
            free.remove(best)
        parts.append(sorted(part))
    return parts


def allocate(parts: list[list[int]], n: int, p: np.ndarray, bound: int) -> tuple[float, list[int]]:
    """Thresholds of the parts, -1 to bound, with the least estimated cost among those whose (t + 1) sum to bound + 1."""
    differ = 2 * p * (1 - p)
    costs = []
    for part in parts:
        within = np.zeros(bound + 1)
        within[0] = 1
        for b in part:  # how likely two fingerprints differ in k bits of the part
            within[1:] = within[1:] * (1 - differ[b]) + within[:-1] * differ[b]
            within[0] *= 1 - differ[b]
        cost, probes, near = [0.0], 0.0, 0.0
        for t in range(bound + 1):
            probes += float(np.prod([(len(part) - k) / (k + 1) for k in range(t)])) * (0.5 if t else 1)  # one side of a pair probes
            near += within[t]
            cost.append(n * probes * PROBE_COST + n * n * near * PAIR_COST)
        costs.append(cost)
    best = {0: (0.0, [])}
    for cost in costs:
        best = {s: min((c + cost[k], [*ts, k - 1]) for r, (c, ts) in best.items() for k in [s - r] if 0 <= k <= bound + 1) for s in range(bound + 2) if any(0 <= s - r <= bound + 1 for r in best)}
    return best[bound + 1]


def plan(n: int, both: np.ndarray, bound: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts that count."""
    p = np.diag(both) / max(n, 1)
    options = []
    for m in range(2, bound + 3):
        parts = correlated_parts(n, both, m)
        cost, thresholds = allocate(parts, n, p, bound)
        options.append((cost, [(part, t) for part, t in zip(parts, thresholds, strict=True) if t >= 0]))
    return min(options)[1]


def value_of(words: list[np.ndarray], bits: list[int]) -> np.ndarray:
    out = np.zeros(len(words[0]), np.uint64)
    for k, b in enumerate(bits):
        out |= ((words[b // WORD] >> np.uint64(b % WORD)) & np.uint64(1)) << np.uint64(k)
    return out


def keys(words: list[np.ndarray], parts: list[tuple[list[int], int]], bound: int, hot: list[np.ndarray]) -> Iterator[tuple[np.ndarray, bool, np.ndarray]]:
    """(key, whether it probes, which fingerprints send it) of all rows that the fingerprints send.

    A probe flips a set of bits whose first one is set: of two fingerprints that differ there, one has it set and finds the other."""
    for i, (bits, t) in enumerate(parts):
        own, rest = value_of(words, bits), [b for b in range(WORD * len(words)) if b not in bits]
        pieces = [rest[k :: bound + 1] for k in range(bound + 1)]
        for radius in range(t + 1):
            for flip in combinations(range(len(bits)), radius):
                value = own ^ np.uint64(sum(1 << k for k in flip))
                sends = np.ones(len(own), bool) if not flip else (own >> np.uint64(flip[0])) & np.uint64(1) == 1
                at = np.searchsorted(hot[i], value)
                is_hot = np.zeros(len(own), bool)
                is_hot[at < len(hot[i])] = hot[i][at[at < len(hot[i])]] == value[at < len(hot[i])]
                yield mix(mix(value) + np.uint64(i)), radius > 0, sends & ~is_hot
                if (sends & is_hot).any():
                    for k, piece in enumerate(pieces):
                        yield mix(mix(mix(value) + np.uint64(i)) ^ mix(value_of(words, piece) * np.uint64(16 + bound) + np.uint64(k + 1))), radius > 0, sends & is_hot


def forest(a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of links (a, b) those of a spanning forest with the least sums of bits apart."""
    nodes, flat = np.unique(np.r_[a, b], return_inverse=True)
    order = np.argsort(apart, kind="stable")
    x, y = flat[: len(a)][order], flat[len(a) :][order]
    label, chosen, alive = np.arange(len(nodes)), np.zeros(len(x), bool), np.arange(len(x))
    while len(alive := alive[label[x[alive]] != label[y[alive]]]):
        best = np.full(len(nodes), len(x))  # each tree's nearest link to another one
        np.minimum.at(best, label[x[alive]], alive)
        np.minimum.at(best, label[y[alive]], alive)
        pick = np.unique(best[best < len(x)])
        chosen[pick] = True
        tree = np.arange(len(nodes))  # of trees, by number
        u, v = label[x[pick]], label[y[pick]]
        while True:
            least = np.minimum(tree[u], tree[v])
            before = tree.copy()
            for at in (tree[u], tree[v], u, v):
                np.minimum.at(tree, at, least)
            while (tree[tree] != tree).any():
                tree = tree[tree]
            if (tree == before).all():
                break
        label = tree[label]
    return nodes[x[chosen]], nodes[y[chosen]], apart[order][chosen]


def majority(words: list[np.ndarray], rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Of each run of rows, the fingerprint of the bits that most of them have."""
    out = []
    for w in words:
        bits = np.unpackbits(w[rows].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out.append(np.packbits(2 * np.add.reduceat(bits, starts, axis=0, dtype=np.int64) > lengths[:, None], axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64))
    return out


def links_below(key: np.ndarray, words: list[np.ndarray], within: int, at_once: int = 1 << 18, long_run: int | None = None, most: float = math.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (a, b, bits apart) between rows of one key, at least one of which is filed there, as a forest of names; and the rows of runs
    that are too long (more than ``most``) to be compared here. A key's last bit is set in rows that probe.

    In a long run, rows near one of a few of its filed rows (the one nearest to the run's majority of bits among them) are linked to that one already;
    if they are most of the run, only the others are compared: filed ones with all rows, probing ones with all filed rows. In other runs
    rows are compared with the next one, the one after that, and so on, all at once."""
    long_run = LONG_RUN if long_run is None else long_run
    whole = np.arange(len(key))
    order = np.argsort(key, kind="stable")
    key, words = key[order], [w[order] for w in words]
    filed = key & 1 == 0
    heads = np.flatnonzero(np.r_[True, key[1:] >> 1 != key[:-1] >> 1])
    lengths = np.diff(np.r_[heads, len(key)])
    n_filed = np.add.reduceat(filed, heads, dtype=np.int64)
    head, end, stop = np.repeat(heads, lengths), np.repeat(heads + lengths, lengths), np.repeat(heads + n_filed, lengths)
    names, found, held = name(words), [], 0

    def bits(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        apart = np.zeros(len(i), np.uint16)
        for w in words:
            apart += np.bitwise_count(w[i] ^ w[j])
        return apart

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (bits(i, j) <= within) & (names[i] != names[j])

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal found, held
        for lo in range(0, len(i), at_once):
            a, b = i[lo : lo + at_once], j[lo : lo + at_once]
            apart = bits(a, b)
            ok = (apart <= within) & (names[a] != names[b])
            if ok.any():
                found.append((names[a[ok]], names[b[ok]], apart[ok]))
                held += int(ok.sum())
        if held > at_once:
            found = [forest(*(np.concatenate(z) for z in zip(*found, strict=True)))]
            held = len(found[0][0]) // 2

    long = np.flatnonzero((lengths >= long_run) & (n_filed > 0))
    by_core = np.zeros(len(key), bool)  # rows of runs that have a core
    core = np.zeros(len(key), bool)
    if len(long):
        rows = np.flatnonzero(np.repeat(np.isin(np.arange(len(heads)), long), lengths))
        starts = np.r_[0, np.cumsum(lengths[long])[:-1]]
        n_most, best = np.full(len(long), -1), np.zeros(len(long), np.int64)
        centre = majority(words, rows, starts, lengths[long])
        off = np.zeros(len(rows), np.int64)
        for w, c in zip(words, centre, strict=True):
            off += np.bitwise_count(w[rows] ^ np.repeat(c, lengths[long]))
        off = np.where(filed[rows], off, 1 << 20) * len(rows) + np.arange(len(rows))
        medoid = rows[np.minimum.reduceat(off, starts) % len(rows)]
        for k in range(-1, PIVOTS):
            pivot = medoid if k < 0 else heads[long] + n_filed[long] * k // PIVOTS
            n_near = np.add.reduceat(near(rows, np.repeat(pivot, lengths[long])), starts, dtype=np.int64)
            better = n_near > n_most
            n_most[better], best[better] = n_near[better], pivot[better]
        chosen = 2 * n_most > lengths[long]
        rows, pivots = rows[np.repeat(chosen, lengths[long])], np.repeat(best[chosen], lengths[long][chosen])
        by_core[rows] = True
        core[rows] = near(rows, pivots) | (rows == pivots)
        compare(rows, pivots)
    # what is left to compare in a run: rows outside its core with all, or all with all
    work = np.add.reduceat(~core, heads, dtype=np.int64) * lengths if len(heads) else lengths
    too_long = np.repeat((lengths > most) & (work > most * most / 2), lengths)
    by_core &= ~too_long
    whole = whole[too_long]
    active, step = np.flatnonzero(by_core & ~core), 0
    last = np.where(filed, end, stop)  # only one side of a pair probes, so a filed row meets probing rows in the core nowhere else
    while len(active := active[head[active] + step < last[active]]):
        compare(active, head[active] + step)
        step += 1
    active, step = np.flatnonzero(filed & ~by_core & ~too_long), 1
    while len(active := active[active + step < end[active]]):
        compare(active, active + step)
        step += 1
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint16), order[whole]
    return *forest(*(np.concatenate(z) for z in zip(*found, strict=True))), order[whole]


def split_keys(key: np.ndarray, words: list[np.ndarray], bound: int, level: int) -> Iterator[np.ndarray]:
    """Further keys of rows below one key: it, with each of bound + 1 pieces of all bits, which every level cuts in its own way."""
    n_bits = WORD * len(words)
    turn = np.random.default_rng(level).permutation(n_bits).tolist()
    for k in range(bound + 1):
        piece = value_of(words, turn[k :: bound + 1][:WORD])
        yield mix(mix(key) ^ mix(piece * np.uint64(2 * bound + 3) + np.uint64(k + 1)))


def pairs_across(key: np.ndarray, words: list[np.ndarray], own: list[np.ndarray], within: int, similarity: float, most: float, at_once: int = 1 << 18) -> Iterator[tuple[np.ndarray, ...] | np.ndarray]:
    """All pairs (a, b, bits apart) of rows of one key that are of different groups, at least one of which is filed there; last, the rows of
    runs that are too long. own: each row's number, its group, the size of its set and its sketch. Two sets share at most the smaller
    count in every cell of their sketches, so pairs that can't have the similarity are left out, and none that can."""
    order = np.argsort(key, kind="stable")
    key, words, (ids_, group, size, *cells) = key[order], [w[order] for w in words], [x[order] for x in own]
    sketch = np.stack(cells, axis=1).view("<u2")
    heads = np.flatnonzero(np.r_[True, key[1:] >> 1 != key[:-1] >> 1])
    lengths = np.diff(np.r_[heads, len(key)])
    end, long = np.repeat(heads + lengths, lengths), np.repeat(lengths > most, lengths)
    active, step = np.flatnonzero((key & 1 == 0) & ~long), 1
    while len(active := active[active + step < end[active]]):
        for lo in range(0, len(active), at_once):
            i = active[lo : lo + at_once]
            j = i + step
            ok = (group[i] != group[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]))
            i, j = i[ok], j[ok]
            apart = np.zeros(len(i), np.uint16)
            for w in words:
                apart += np.bitwise_count(w[i] ^ w[j])
            near = apart <= within
            for a in range(0, len(i), 1 << 14) if near.any() else ():
                part = np.flatnonzero(near[a : a + (1 << 14)]) + a
                u, v = i[part], j[part]
                shared, least = np.minimum(sketch[u], sketch[v]).sum(1, dtype=np.uint64), np.minimum(size[u], size[v])
                shared = np.where(shared == 65535 * CELLS, least, np.minimum(shared, least))
                near[part] = shared >= similarity * (size[u] + size[v] - shared)
            if near.any():
                yield ids_[i[near]], ids_[j[near]], apart[near]
        step += 1
    yield order[long]


def links(nodes: DataFrame, bound: int = 4, within: int | None = None, words: int = 1, long_run: int | None = None, across: float | None = None) -> DataFrame:
    """nodes (fp, distinct, and bits where fingerprints have several words) to links (a, b, apart) of fps, which connect all fingerprints within
    the bound of each other and none further than ``within`` (the bound, if not given) apart.

    With ``across`` (a similarity), nodes have a number, a group, a size and a sketch as well, fingerprints may repeat, and all pairs of
    numbers of different groups come out, once or several times, that meet below a key and whose sketches allow the similarity."""
    spark = nodes.sparkSession
    bits = nodes.select("fp" if words == 1 else "bits", *(["number", "group", "size", "sketch"] if across is not None else []))
    extra = 0 if across is None else 3 + CELLS // 4
    n, both = bit_statistics(bits.select(bits.columns[0]), WORD * words)
    if n < 2:
        return spark.createDataFrame([], "a bigint, b bigint, apart int")
    parts = plan(n, both, bound)
    n_buckets = 8 * partitions(spark)

    def values(batches):
        for batch in batches:
            own = words_of(batch.column(0))
            for i, (part, _) in enumerate(parts):
                v, k = np.unique(value_of(own, part), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(v.view(np.int64)), pa.array(k.astype(np.int64))], names=["part", "value", "n"])

    # no more than HOT_SHARE values of a part can have more than n / HOT_SHARE fingerprints; runs below other values are split where they meet
    crowded = bits.select(bits.columns[0]).mapInArrow(values, "part int, value bigint, n bigint").groupBy("part", "value").agg(F.sum("n").alias("n")).filter(F.col("n") > max(HOT_LEAST, n // HOT_SHARE)).collect()
    hot = [np.sort(np.array([r.value for r in crowded if r.part == i], np.int64).view(np.uint64)) for i in range(len(parts))]

    def packed(key: np.ndarray, probes: np.ndarray, own: list[np.ndarray]) -> list[tuple[int, bytes]]:
        # keys that only share their half bring more candidates together, all of which are verified
        half = ((key >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFFFFFE)) | probes
        return split_by((key % np.uint64(n_buckets)).astype(np.int64), [half, *own])

    def send(batches):
        for batch in batches:
            own = words_of(batch.column(0))
            if extra:
                own += [batch.column(1 + k).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for k in range(3)] + words_of(batch.column(4))
            for lo in range(0, len(own[0]), 1 << 13):
                some = [w[lo : lo + (1 << 13)] for w in own]
                sent = [(k[m], np.flatnonzero(m).astype(np.int32), p) for k, p, m in keys(some[:words], parts, bound, hot)]
                key, at = np.concatenate([k for k, _, _ in sent]), np.concatenate([i for _, i, _ in sent])
                probes = np.repeat(np.array([p for _, _, p in sent], np.uint32), [len(k) for k, _, _ in sent])
                rows = packed(key, probes, [w[at] for w in some])
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "rows"])
        give_back()

    found_schema = pa.schema([("bucket", pa.int32()), ("rows", pa.binary()), ("a", pa.int64()), ("b", pa.int64()), ("apart", pa.int32())])

    def verify(level: int):
        most, limit = RUN if level < LEVELS else math.inf, bound if within is None else within

        def found_below(key, own):
            if across is None:
                *found, left = links_below(key, own, limit, long_run=long_run, most=most)
                yield from (found, left)
            else:
                yield from pairs_across(key, own[:words], own[words:], limit, across, most)

        def each(batches):
            key, *own = unpack([x for batch in batches for x in batch.column(1).to_pylist()], ["<u4"] + ["<u8"] * (words + extra))
            if not len(key):
                return
            left = None
            for some in found_below(key, own):
                if isinstance(some, np.ndarray):
                    left = some
                    break
                a, b, apart = some
                yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.binary()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(apart.astype(np.int32))], schema=found_schema)
            for lo in range(0, len(left), 1 << 13):
                rows, mine = [], left[lo : lo + (1 << 13)]
                some = [w[mine] for w in own]
                for further in split_keys((key[mine] >> 1).astype(np.uint64), some[:words], bound, level):
                    rows += packed(further, key[mine] & np.uint32(1), some)
                none = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), none, none, pa.nulls(len(rows), pa.int32())], schema=found_schema)
            del key, own
            give_back()

        return each

    sent, out, level = bits.mapInArrow(send, "bucket int, rows binary"), None, 0
    while True:
        found = checkpoint(sent.repartition(n_buckets, "bucket").mapInArrow(verify(level), "bucket int, rows binary, a bigint, b bigint, apart int"))
        some = found.filter(F.col("a").isNotNull()).select("a", "b", "apart")
        out = some if out is None else out.unionByName(some)
        sent = found.filter(F.col("rows").isNotNull()).select("bucket", "rows")
        if level == LEVELS or sent.isEmpty():
            return out
        level += 1


def near_duplicates(docs: DataFrame, shingle: int = 4, bound: int = 4) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id linked, over any number of links) of every row."""
    fps = checkpoint(fingerprints(docs, shingle))
    # fp, first, n of distinct fingerprints; root of those that have links
    nodes = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    n_nodes, total = nodes.agg(F.count("*"), F.sum("n")).first()
    roots = components(links(nodes, bound))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    of_node = checkpoint(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"), F.col("node").isNotNull().alias("linked")))
    linked = of_node.filter("linked").select("fp", "first", F.col("n").alias("rows"), "root")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    named = spread_join(linked, least, "root", n_nodes).select("fp", "component_id", F.col("rows").alias("n"))
    named = named.unionByName(of_node.filter(~F.col("linked")).select("fp", F.col("first").alias("component_id"), "n"))
    return spread_join(fps, named, "fp", total or 0).select("doc_id", "fp", "component_id")


def similar_texts(docs: DataFrame, shingle: int, similarity: float, words: int, bound: int, within: int) -> DataFrame:
    """(hash, group) of texts (hash, text) that are linked to another one, over any number of links; of equal hashes any text.

    Fingerprints give candidates, of each key those of a spanning forest, and the similarity of all of them is taken from the texts.
    If all of them are similar, no other one can change a group. If one isn't, the forest may have hidden others that are: then all
    candidates between different groups are judged, in a second pass over the texts that have candidates. Sketches keep those away that
    cannot be similar."""
    fps = checkpoint(fingerprints(docs.select(F.col("hash").alias("doc_id"), "text"), shingle, words).groupBy("doc_id").agg(*(F.first(c).alias(c) for c in (["fp", "bits"] if words > 1 else ["fp"]))))
    nodes = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("hash"), *([F.first("bits").alias("bits")] if words > 1 else [])))
    between = links(nodes, bound, within, words, long_run=RUN)
    of = lambda side: nodes.select(F.col("fp").alias(side), F.col("hash").alias(f"{side}_text"))
    between = between.join(of("a"), "a").join(of("b"), "b").select(F.col("a_text").alias("a"), F.col("b_text").alias("b"), "apart")
    same = fps.join(nodes.select("fp", "hash"), "fp").filter(F.col("doc_id") != F.col("hash")).select(F.col("doc_id").alias("a"), F.col("hash").alias("b"), F.lit(0).alias("apart"))
    edges = between.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = checkpoint(edges)
    needed = edges.select(F.col("a").alias("hash")).unionByName(edges.select(F.col("b").alias("hash"))).distinct()
    texts = checkpoint(docs.select("hash", "text").join(needed, "hash", "left_semi").groupBy("hash").agg(F.first("text").alias("text")))
    judged = checkpoint(alike(edges, texts, shingle, similarity))
    good = judged.filter("alike").select("a", "b")
    groups = components(good)
    refused = judged.filter("not alike")
    if not refused.isEmpty():
        own = needed.select(F.col("hash").alias("number")).join(groups.select(F.col("node").alias("number"), F.col("root").alias("group")), "number", "left")
        rows = fps.select(F.col("doc_id").alias("number"), *(c for c in fps.columns if c != "doc_id")).join(own, "number")
        sizes = set_sizes(texts, shingle)
        rows = checkpoint(rows.join(sizes, "number").withColumn("group", F.coalesce("group", "number")))
        seen = judged.select("a", "b")
        further = links(rows, bound, within, words, across=similarity).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        more = checkpoint(alike(further.distinct().join(seen, ["a", "b"], "left_anti"), texts, shingle, similarity).filter("alike").select("a", "b"))
        if not more.isEmpty():
            # few groups join others; all of their texts take the new name
            label = rows.select(F.col("number"), "group")
            ends = more.join(label.withColumnsRenamed({"number": "a", "group": "ga"}), "a").join(label.withColumnsRenamed({"number": "b", "group": "gb"}), "b")
            to = components(ends.select(F.col("ga").alias("a"), F.col("gb").alias("b"))).select(F.col("node").alias("group"), "root")
            groups = label.join(to, "group", "left").select(F.col("number").alias("node"), F.coalesce("root", "group").alias("root"))
    return groups.select(F.col("node").alias("hash"), F.col("root").alias("group"))


#: Cells of a sketch: how many of a set's hashes fall into each, up to 65535.
CELLS = 256


def set_sizes(texts: DataFrame, shingle: int) -> DataFrame:
    """number (the hash), size (different word shingles) and sketch of texts. A sketch that a cell is too small for is full in all cells,
    which says nothing about the set."""

    def each(batches):
        for batch in batches:
            sets = [np.unique(np.array(shingle_hashes((t or "").encode(), shingle), "<u8")) for t in batch.column(1).to_pylist()]
            counts = [np.bincount((x % np.uint64(CELLS)).astype(np.int64), minlength=CELLS) for x in sets]
            cells = [np.full(CELLS, 65535, "<u2") if c.max() > 65535 else c.astype("<u2") for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([c.tobytes() for c in cells], pa.binary())], names=["number", "size", "sketch"])

    return texts.select("hash", "text").mapInArrow(each, "number bigint, size bigint, sketch binary")


#: Pairs of one text that meet in a task.
TOGETHER = 256


def alike(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """a, b and alike: whether the similarity (Jaccard) of their sets of word shingles is at least so much."""

    def with_text(rows: DataFrame, side: str) -> DataFrame:
        # texts with many pairs go to several places
        times = rows.groupBy(side).agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("times"))
        rows = rows.join(times, side).withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.col("times")).cast("int")).drop("times")
        own = texts.select(F.col("hash").alias(side), F.col("text").alias(f"text_{side}")).join(times, side).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("times") - 1))).drop("times")
        return rows.join(own, [side, "salt"]).drop("salt")

    def judge(batches):
        for batch in batches:
            left, right = ([set(shingle_hashes((t or "").encode(), shingle)) for t in batch.column(k).to_pylist()] for k in (2, 3))
            shared = [len(x & y) for x, y in zip(left, right, strict=True)]
            ok = [k >= similarity * (len(x) + len(y) - k) for k, x, y in zip(shared, left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "alike"])
        give_back()

    both = with_text(with_text(pairs, "a"), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(judge, "a bigint, b bigint, alike boolean")


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, words: int = 2, bound: int = 17, within: int = 25) -> DataFrame:
    """docs with their columns, one row of each group of near-duplicates: the smallest doc_id's.

    Texts link if the similarity of their shingle sets is high enough, so nothing below it goes but over other links. Pairs
    with fingerprints within the bound always come to be compared; of those further apart, up to ``within``, most do
    (one part within its threshold is enough). A null doc_id counts as larger than all others. Of rows with that doc_id one
    stays, by the hash of its text."""
    own = F.struct(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("hash")).alias("own")
    texts = docs.select(F.xxhash64(F.col("text").cast("string")).alias("hash"), F.col("text").cast("string").alias("text"))
    groups = similar_texts(texts, shingle, similarity, words, bound, within)
    # each task sends a row for each pair of an id and a text's hash, and a row for each group after the join
    rows = docs.select(own).groupBy("own").agg(F.lit(1).alias("one")).select("own", F.col("own.hash").alias("hash")).groupBy("hash").agg(F.min("own").alias("own"))
    stays = rows.join(groups, "hash", "left").groupBy(F.coalesce("group", "hash").alias("group")).agg(F.min("own").alias("own")).select("own.id", "own.hash")
    keyed = docs.select(F.struct("*").alias("row"), own).select("row", "own.id", "own.hash")
    left = keyed.join(stays, ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"])
    return left.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
