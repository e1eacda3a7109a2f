"""Exact top-k inner products by pivot elimination.

A pivot table holds every vector's distances to many pivots. Distances d(q, p) and d(x, p) differ by no more than
d(q, x), so the largest difference over the pivots is a lower bound of d(q, x) and gives an upper bound of the score,
(|q|^2 + |x|^2 - d(q, x)^2) / 2. It is used twice:

1. Rows stand in cells (nearest pivot, ring around it) and in blocks of a cell. A cell's ranges of pivot distances bound
   the scores of all its rows. A query goes to the block of its best cell first; its k-th best score there is a
   threshold, and it is then sent only to blocks whose cell can still reach it.
2. In a block, candidates are evaluated in the order of their own bounds until the k-th best score is above the next
   bound. Ties can't be lost, as equal bounds are still evaluated.

Rows go to their block once (for every ``QUERY_CHUNK`` queries); queries stream past the block in memory.

Vectors that are null, or hold null or non-finite components take no part; nor do rows without an id. All finite vectors
do: components are whole numbers of any size and scores are exact. Scores beyond 64 bits rank as what they are, and the
column ``score`` is null there. Scores are taken between vectors of one length. A query's own row is every row with its
id. An id that repeats asks once, with the shortest and then least of its vectors; repeated candidates count each. Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetlens.llm.common import checkpoint, partitions, table

SCALE = 1024
PIVOTS = 32
#: Rows that a block holds, queries that stream past one copy of it, and cells and vector lengths with statistics at most.
ROW_BLOCK, QUERY_CHUNK, CELLS, DIMS = 8192, 1 << 16, 4096, 16
#: Components from here on are kept as they came ("wide") and take part without bounds.
WIDE = 2.0**52
VECTOR = "vec_id bigint, dim int, wide boolean, v binary"
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("beyond", pa.int32()), ("score", pa.int64()), ("big", pa.binary())])
FOUND_DDL = "query_id bigint, vec_id bigint, beyond int, score bigint, big binary"


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, dim, wide, v (64-bit integers; of wide vectors the components as doubles) of the vectors that take part."""

    def each(batches):
        for batch in batches:
            rows = []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not x.is_valid or x.values.null_count:
                    continue
                x = np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)
                if np.isfinite(x).all():
                    wide = bool((np.abs(x) >= WIDE / SCALE).any())
                    rows.append((i, len(x), wide, (x if wide else np.floor(x * SCALE).astype("<i8")).tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.bool_(), pa.binary()), strict=True)], names=["vec_id", "dim", "wide", "v"])

    return embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").mapInArrow(each, VECTOR)


def whole_numbers(v: bytes, wide: bool) -> list[int]:
    if not wide:
        return np.frombuffer(v, "<i8").tolist()
    return [math.floor(x * SCALE) if abs(x) < 2.0**900 else int(x) * SCALE for x in np.frombuffer(v, "<f8").tolist()]


def choose_pivots(vectors: DataFrame, n: int = PIVOTS) -> dict[int, np.ndarray]:
    """n vectors of each of the DIMS most frequent lengths, chosen by a hash; vectors of other lengths have no bounds."""
    narrow = vectors.filter(~F.col("wide"))
    usual = [r.dim for r in narrow.groupBy("dim").count().orderBy(F.col("count").desc(), "dim").limit(DIMS).collect()]
    first = Window.partitionBy("dim").orderBy(F.xxhash64("v"), "v")
    rows = narrow.filter(F.col("dim").isin(usual)).select("dim", "v").withColumn("k", F.row_number().over(first)).filter(F.col("k") <= n).collect()
    return {d: np.stack([np.frombuffer(r.v, "<i8") for r in rows if r.dim == d]).astype(float) for d in {r.dim for r in rows}}


def pivot_table(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """vectors with far (distances to the pivots; none if there are no bounds), near (the least) and pivot (whose it is, or -1)."""

    def each(batches):
        for batch in batches:
            far, near, pivot = [], [], []
            for d, wide, v in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if wide or d not in pivots:
                    far.append(b"")
                    near.append(0.0)
                    pivot.append(-1)
                    continue
                x = np.sqrt(((pivots[d] - np.frombuffer(v, "<i8").astype(float)) ** 2).sum(1))
                far.append(x.astype("<f8").tobytes())
                pivot.append(int(x.argmin()))
                near.append(float(x[pivot[-1]]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far, pa.binary()), pa.array(near, pa.float64()), pa.array(pivot, pa.int32())], names=["vec_id", "dim", "wide", "v", "far", "near", "pivot"])

    return vectors.mapInArrow(each, f"{VECTOR}, far binary, near double, pivot int")


def in_cells(far: DataFrame, n: int) -> tuple[DataFrame, list]:
    """far with cell (a number), and the cells as (dim, pivot, number of rows); rings hold about equal numbers of rows."""
    per_ring = max(ROW_BLOCK, -(-n // (CELLS // 2)))
    groups = far.groupBy("dim", "pivot").agg(F.count("*").alias("n"), F.percentile_approx("near", [k / 64 for k in range(1, 64)], 1000).alias("cuts"))
    bounded = groups.filter(F.col("pivot") >= 0).collect()  # DIMS * PIVOTS rows at most
    edges, first, at = {}, {}, 1
    for r in sorted(bounded, key=lambda r: (r.dim, r.pivot)):
        rings = min(64, -(-r.n // per_ring))
        edges[r.dim, r.pivot] = [r.cuts[-(-64 * k // rings) - 1] for k in range(1, rings)]
        first[r.dim, r.pivot] = at
        at += rings

    def each(batches):
        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in (1, 5, 6)), strict=True)
            cell = [first[d, p] + int(np.searchsorted(edges[d, p], x)) if p >= 0 else -d for d, x, p in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], names=["vec_id", "dim", "wide", "v", "far", "near", "pivot", "cell"])

    return far.mapInArrow(each, f"{VECTOR}, far binary, near double, pivot int, cell bigint"), bounded


def cell_ranges(rows: DataFrame) -> dict[int, tuple]:
    """(dim, number of rows, largest squared norm, least and largest distance to each pivot) of cells; of those without bounds only how many rows there are.

    CELLS cells at most have bounds; the others are one for each vector length."""

    def each(batches):
        seen: dict[int, list] = {}
        for batch in batches:
            for d, wide, v, far, cell in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4, 7)), strict=True):
                if cell not in seen:
                    seen[cell] = [d, 0, 0.0, np.inf, -np.inf]
                s = seen[cell]
                s[1] += 1
                if cell > 0:
                    x = np.frombuffer(far, "<f8")
                    s[2] = max(s[2], float((np.frombuffer(v, "<i8").astype(float) ** 2).sum()))
                    s[3], s[4] = np.minimum(s[3], x), np.maximum(s[4], x)
        out = [(c, d, n, norm, k, float(a), float(b)) for c, (d, n, norm, lo, hi) in seen.items() for k, (a, b) in enumerate(zip(np.atleast_1d(lo), np.atleast_1d(hi), strict=True))]
        columns = list(zip(*out, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["cell", "dim", "n", "norm", "k", "lo", "hi"])

    per = rows.mapInArrow(each, "cell bigint, dim int, n bigint, norm double, k int, lo double, hi double")
    per = per.groupBy("cell", "k").agg(F.first("dim").alias("dim"), F.sum("n").alias("n"), F.max("norm").alias("norm"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    out: dict[int, tuple] = {}
    for r in sorted(per, key=lambda r: (r.cell, r.k)):
        if r.cell not in out:
            out[r.cell] = (r.dim, r.n, r.norm, [], [])
        out[r.cell][3].append(r.lo)
        out[r.cell][4].append(r.hi)
    return {c: (d, n, norm, np.array(lo), np.array(hi)) for c, (d, n, norm, lo, hi) in out.items()}


def bound_of(norms, least) -> np.ndarray:
    """The most that a score can be, from the sum of both squared norms and the least distance; with room for rounding."""
    return (norms - np.maximum(least * (1 - 1e-9) - 1e-6, 0) ** 2) / 2 + 1 + 1e-9 * norms


def products(rows: list[tuple[bytes, bool]], q: list[int]) -> list[int]:
    return [sum(a * b for a, b in zip(whole_numbers(*r), q, strict=True)) for r in rows]


class Block:
    """Rows of one block, all of one length."""

    def __init__(self, ids: list[int], wide: list[bool], v: list[bytes], far: list[bytes]):
        self.ids, self.rows = np.array(ids, np.int64), list(zip(v, wide, strict=True))
        self.bounded = bool(far) and all(far)
        if self.bounded:
            x = np.stack([np.frombuffer(b, "<i8") for b in v])
            self.most, self.x, self.far = float(np.abs(x).max(initial=0)), x.astype(float), np.stack([np.frombuffer(b, "<f8") for b in far])
            self.norms = (self.x**2).sum(1)

    def top(self, q_id: int, v: bytes, wide: bool, far: bytes, k: int, least: float, at_once: int = 64) -> tuple[list[tuple[int, int]], int]:
        """The best k (score, id) that reach ``least``, and how many products that took."""
        q = whole_numbers(v, wide)
        if not (self.bounded and far):
            other = np.flatnonzero(self.ids != q_id)
            scores = products([self.rows[i] for i in other], q)
            return sorted(zip([-s for s in scores], self.ids[other].tolist(), strict=True))[:k], len(other)
        qf = np.array(q, float)
        bound = bound_of(float(qf @ qf) + self.norms, np.abs(self.far - np.frombuffer(far, "<f8")).max(1, initial=0))
        order = np.flatnonzero((self.ids != q_id) & (bound >= least))
        order = order[np.argsort(-bound[order], kind="stable")]
        exact = self.most * float(np.abs(qf).max(initial=0)) * max(1, len(q)) < 2.0**53  # then sums of doubles are whole numbers
        best: list[tuple[int, int]] = []
        a = 0
        while a < len(order):
            if len(best) == k and -best[-1][0] > bound[order[a]]:
                break
            some = order[a : a + at_once]
            scores = (self.x[some] @ qf).astype(np.int64).tolist() if exact else products([self.rows[i] for i in some], q)
            best = sorted(best + [(-s, i) for s, i in zip(scores, self.ids[some].tolist(), strict=True)])[:k]
            a, at_once = a + at_once, min(2 * at_once, 1024)
        return best, a


def _found(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    """Rows (query, id, score): scores beyond 64 bits as bytes that sort like them."""
    beyond = [0 if -(2**63) <= s < 2**63 else 1 if s > 0 else -1 for _, _, s in rows]
    columns = [[r[0] for r in rows], [r[1] for r in rows], beyond, [s if b == 0 else 0 for (_, _, s), b in zip(rows, beyond, strict=True)], [(s + (1 << 2400)).to_bytes(301, "big") if b else None for (_, _, s), b in zip(rows, beyond, strict=True)]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)


def meet(rows: DataFrame, queries: DataFrame, k: int, parts: int) -> DataFrame:
    """The best k of each block for each query sent to it. rows, queries: block, vec_id, wide, v, far; queries also least."""

    def each(batches) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for batch in batches:
            columns = batch.to_pydict()
            found: list[tuple[int, int, int]] = []
            for b, kind, i, wide, v, far, least in zip(*(columns[c] for c in ("block", "kind", "vec_id", "wide", "v", "far", "least")), strict=True):
                if b != at:
                    at, held, block = b, [], None
                if kind == 0:
                    held.append((i, wide, v, far))
                elif held:
                    block = block or Block(*map(list, zip(*held, strict=True)))
                    found += [(i, x, -s) for s, x in block.top(i, v, wide, far, k, least)[0]]
            if found:
                yield _found(found)

    both = rows.select("block", F.lit(0).alias("kind"), "vec_id", "wide", "v", "far", F.lit(0.0).alias("least"))
    both = both.unionByName(queries.select("block", F.lit(1).alias("kind"), "vec_id", "wide", "v", "far", "least"))
    return both.repartition(parts, "block").sortWithinPartitions("block", "kind").mapInArrow(each, FOUND_DDL)


def ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("beyond").desc(), F.col("score").desc(), F.col("big").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def top_k(embeddings: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for every query (vec_id divisible by ``every``)."""
    vectors = checkpoint(integer_vectors(embeddings))
    asks = F.pmod("vec_id", F.lit(every)) == 0
    n, n_queries = vectors.agg(F.count("*"), F.count(F.when(asks, 1))).first()
    rows, _ = in_cells(pivot_table(vectors, choose_pivots(vectors)), n)
    rows = checkpoint(rows)
    ranges = cell_ranges(rows)
    cells = sorted(ranges)
    blocks = [max(1, -(-ranges[c][1] // ROW_BLOCK)) for c in cells]
    first_block = dict(zip(cells, accumulate(blocks, initial=0), strict=False))
    n_blocks, chunks = sum(blocks), max(1, -(-n_queries // QUERY_CHUNK))
    of_cell = dict(zip(cells, blocks, strict=True))
    names = [*VECTOR.replace(",", "").split()[::2], "far"]

    def placed(batches):
        """Rows with their block."""
        for batch in batches:
            block = [first_block[c] + i % of_cell[c] for c, i in zip(batch.column(7).to_pylist(), batch.column(8).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(block, pa.int64())], names=[*names, "block"])

    def sent(first: bool):
        """Queries with the block of their best cell; or with each block, but that one, whose cell can reach their least score."""
        of_dim = {}
        for d in {r[0] for r in ranges.values()}:
            own = [c for c in cells if ranges[c][0] == d and c > 0]
            lo, hi = (np.stack([ranges[c][j] for c in own]) if own else None for j in (3, 4))
            of_dim[d] = (own, lo, hi, np.array([ranges[c][2] for c in own]), [c for c in cells if ranges[c][0] == d and c <= 0])

        def each(batches):
            for batch in batches:
                take, to = [], []
                columns = batch.to_pydict()
                for row, (i, d, wide, v, far) in enumerate(zip(*(columns[c] for c in names), strict=True)):
                    own, lo, hi, norms, open_ = of_dim[d]
                    bound = np.full(len(own), np.inf)
                    if own and far:
                        x = np.frombuffer(far, "<f8")
                        gap = np.maximum(np.maximum(lo - x, x - hi).max(1), 0)
                        bound = bound_of(norms + float((np.frombuffer(v, "<i8").astype(float) ** 2).sum()), gap)
                    best = own[int(bound.argmax())] if own else open_[0]
                    home = first_block[best] + abs(i) % of_cell[best]
                    if first:
                        reach = [home]
                    else:
                        near = [c for c, b in zip(own, bound, strict=True) if b >= columns["least"][row]] + open_
                        reach = [b for c in near for b in range(first_block[c], first_block[c] + of_cell[c]) if b != home]
                    take += [row] * len(reach)
                    to += reach
                    if len(to) > 50_000:
                        yield part(batch, take, to)
                        take, to = [], []
                yield part(batch, take, to)

        def part(batch, take, to):
            out = batch.take(pa.array(take, pa.int64()))
            return pa.RecordBatch.from_arrays([*out.columns, pa.array(to, pa.int64())], names=[*batch.schema.names, "block"])

        return each

    ddl = f"{VECTOR}, far binary"
    chunk = lambda c: F.col("block") * chunks + c
    mine = chunk(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)))
    numbered = rows.withColumn("number", F.monotonically_increasing_id())  # rows are checkpointed, so a lost task gives the same numbers
    in_blocks = numbered.mapInArrow(placed, f"{ddl}, block bigint").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("block", chunk(F.col("c")))
    first = Window.partitionBy("vec_id").orderBy("dim", "v")
    queries = rows.filter(asks).withColumn("nth", F.row_number().over(first)).filter("nth = 1").select(*names)
    parts = max(partitions(embeddings.sparkSession), -(-n_blocks * chunks // 4))
    at_home = queries.mapInArrow(sent(True), f"{ddl}, block bigint").withColumn("least", F.lit(float("-inf"))).withColumn("block", mine)
    begun = checkpoint(ranked(meet(in_blocks, at_home, k, parts), k).drop("rank"))
    # the k-th best score so far, where there are k; rounded down
    least = begun.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"), F.min(F.when(F.col("beyond") == 0, F.col("score").cast("double")).when(F.col("beyond") < 0, float("-inf"))).alias("least"))
    least = least.filter(F.col("n") >= k).select("vec_id", (F.col("least") - 1 - F.abs("least") * 1e-9).alias("least"))
    further = queries.join(least, "vec_id", "left").select(*names, F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    further = further.mapInArrow(sent(False), f"{ddl}, least double, block bigint").withColumn("block", mine)
    found = ranked(begun.unionByName(meet(in_blocks, further, k, parts)), k)
    return found.select("query_id", "rank", "vec_id", F.when(F.col("beyond") == 0, F.col("score")).alias("score"))


def op3_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))
