import re
from collections import defaultdict

import numpy as np
import pytest

from assetlens.llm import pivotal_mixing as M


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, total = {}, sum(sizes.values())
    free = set(order)
    while True:
        rest = total - sum(target.values())
        w = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / w > 3 * sizes[s]] if w else []
        if not over:
            return target | {s: rest * weight[s] / w for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            free.remove(s)


def check(rows, docs):
    sizes, largest = defaultdict(int), defaultdict(int)
    for _, s, t in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] += n
        largest[s] = max(largest[s], n)
    target, taken = brute_targets(sizes), defaultdict(int)
    assert sorted((str(r.doc_id), str(r.source), r.size) for r in rows) == sorted((str(d), str(s), len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, s, t in docs)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source], rel=1e-12)
        want = r.target / r.source_size if r.source_size else 0
        assert np.floor(want) <= r.copies <= np.ceil(want) <= 3
        taken[r.source] += r.copies * r.size
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s] + 1e-6


def test_sf(spark, sf, monkeypatch):
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    for part in (20_000, 7):
        monkeypatch.setattr(M, "PART", part)
        monkeypatch.setattr(M, "FAN_IN", 3)
        first = M.mix_sources(frame).collect()
        check(first, docs)
        assert sorted(first) == sorted(M.mix_sources(frame.repartition(3)).collect())


def test_cases(spark):
    docs = [(1, "a", "x y"), (1, "a", "x y"), (None, "a", "z"), (2, None, "q " * 50), (3, None, None), (4, "empty", ""), (5, "é", "w " * 9), (6, "Z", "w\x0bw\tw w")]
    frame = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    check(M.mix_sources(frame).collect(), docs)
    assert M.mix_sources(frame.limit(0)).collect() == []
    only = [(1, "a", ""), (2, "b", None)]
    assert {r.copies for r in M.mix_sources(spark.createDataFrame(only, "doc_id bigint, source string, text string")).collect()} == {0}


def test_rounding_keeps_words_and_expectations():
    sizes, fractions = np.array([50, 20, 20, 7, 5, 1]), np.array([0.3, 0.5, 0.25, 0.9, 0.4, 0.6])
    seen = []
    for seed in range(4000):
        out, carry = M.pivotal(sizes, fractions, np.random.default_rng(seed))
        assert out @ sizes == pytest.approx(fractions @ sizes)
        assert sum(f not in (0.0, 1.0) for f in out) <= 1 and (carry < 0 or out[carry] not in (0.0, 1.0))
        seen.append(out)
    assert np.mean(seen, axis=0) == pytest.approx(fractions, abs=0.04)
