import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlens.llm import balanced_sharding as B


def run(spark, docs, **more):
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"shard": F.lit("x"), "size": F.lit(1), "key": F.lit(2), "number": F.lit(3), "bin": F.lit(4)})
    out = B.balanced_shards(frame.repartition(5), **more)
    rows = out.collect()
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in rows) == sorted(str((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for i, t in docs)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return rows, out


def loads(rows, shards=16):
    found = Counter()
    for r in rows:
        found[r.shard] += r.size
    return [found[k] for k in range(shards)]


def cut(rows):
    """Keys by the number of shards they are in, largest first."""
    where = defaultdict(Counter)
    for r in rows:
        where[bytes(r.key)][r.shard] += 1
    return sorted(((sum(c.values()), len(c)) for c in where.values()), reverse=True)


def test_sf(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows, out = run(spark, docs)
    by = loads(rows)
    assert max(by) <= max(sum(by) / 16 * 1.01, max(r.size for r in rows) * 1.01)
    assert all(places == 1 for _, places in cut(rows))
    assert B.outside(out).first().outside == 0
    again, _ = run(spark, docs)
    assert {r.doc_id: r.shard for r in rows if r.doc_id is not None} == {r.doc_id: r.shard for r in again if r.doc_id is not None}


def test_pairs_without_any_other_document(spark):
    docs = [(i, f"text {i // 2} " + "w " * ((i // 2) % 61)) for i in range(6000)]
    rows, _ = run(spark, docs)
    by = loads(rows)
    assert max(by) < 1.03 * sum(by) / 16 and min(by) > 0.97 * sum(by) / 16
    split = sum(places > 1 for _, places in cut(rows))
    assert split < 0.1 * 3000, "a hash alone splits 2,800 of the 3,000 pairs"


@pytest.mark.parametrize("null", [False, True])
def test_hot_group(spark, null):
    docs = [(None if null else i, None if null and i % 2 else "" if null else "a notice on every page") for i in range(5_000)]
    docs += [(10_000 + i, f"document {i} " + "x" * (i % 50)) for i in range(8_000)] + [(30_000 + i, f"copied {i % 500}") for i in range(2_000)]
    rows, _ = run(spark, docs)
    by, groups = loads(rows), cut(rows)
    assert max(by) < 1.01 * sum(by) / 16
    assert groups[0][0] == 5_000
    need = groups[0][0] * (1 if null else 23) / (sum(by) / 16)
    assert groups[0][1] <= np.ceil(need) + 1
    assert all(places == 1 for _, places in groups[1:])


def test_one_document_larger_than_a_shard(spark):
    rows, _ = run(spark, [(1, "y" * 500_000), (2, "y" * 500_000), *((i, f"t{i}") for i in range(3, 400))])
    big = [r.shard for r in rows if r.size > 1000]
    assert len(big) == 2
    assert len({r.shard for r in rows if r.size < 1000} - set(big)) == 14


def test_small_and_empty(spark):
    assert run(spark, [])[0] == []
    rows, _ = run(spark, [(None, None), (None, None), (3, ""), (4, "a"), (4, "a")])
    assert len(rows) == 5
    rows, _ = run(spark, [(i, f"{i}") for i in range(100)], shards=3, key=F.col("doc_id") % 10)
    assert all(0 <= r.shard < 3 for r in rows) and sum(p > 1 for _, p in cut(rows)) <= 3


def test_quotas():
    load, wishes = np.array([10.0, 10.0, 4.0]), np.zeros((3, 3, 4))
    wishes[0, 1] = wishes[1, 0] = 2
    wishes[0, 2] = 3
    open_ = B.admitted(load, wishes, 10)
    flow = np.array([[wishes[s, t, : open_[t]].sum() for t in range(3)] for s in range(3)])
    assert (load + flow.sum(0) - flow.sum(1) <= 10).all() and flow[0, 2] == 6 and flow.sum() > 6


def test_buckets_of_a_shard(spark, monkeypatch):
    monkeypatch.setattr(B, "NUMBERED", 7)
    run(spark, [(i, f"t{i % 900}") for i in range(2_000)])
