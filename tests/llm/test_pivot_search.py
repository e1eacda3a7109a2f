import math
from fractions import Fraction

import numpy as np

from assetlens.llm import pivot_search as P


def brute(rows, k=10, every=100):
    ok = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, [math.floor(1024 * float(x)) for x in v]))
    out = []
    for q, v in ok:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in P.op3_pivot_topk(spark, sf).collect()) == brute(rows)


def test_cases(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (101, rows[3][1]), (102, None), (103, [None] * 6), (104, [float("nan")] * 6), (105, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (None, rows[5][1]), (110, [1.0, 2.0]), (120, [0.5, -2.0]), (130, []), (200, [3e9, 1.0, 0.0, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, q string")
    want = brute([(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 4, 10)
    assert sorted(tuple(r) for r in P.top_k(frame, 4, 10).collect()) == want
    monkeypatch.setattr(P, "QUERY_CHUNK", 3)
    monkeypatch.setattr(P, "ROW_BLOCK", 10)
    monkeypatch.setattr(P, "DIMS", 1)
    assert sorted(tuple(r) for r in P.top_k(frame, 4, 10).collect()) == want
    assert P.top_k(frame.limit(0)).collect() == []


def test_any_finite_vector(spark, monkeypatch):
    monkeypatch.setattr(P, "ROW_BLOCK", 4)
    rng = np.random.default_rng(3)
    edge = [2.0**31, -(2.0**31), 2.0**21, 2.0**52 / 1024, 1e300, -1e300, 1.7e308, 5e-324, -0.3, 2.0**53 + 2, 0.0]
    rows = [(i, rng.choice(edge, 4).tolist()) for i in range(30)] + [(i, rng.normal(size=4).tolist()) for i in range(30, 60)]
    # scores of 2^63 - 1024, 2^63, -2^63 and -2^63 - 1024
    rows += [(60, [2.0**21, 1.0, 0.0, 0.0]), (61, [2.0**22, -1.0 / 1024, 0.0, 0.0]), (62, [2.0**22, 0.0, 0.0, 0.0]), (63, [-(2.0**22), 0.0, 0.0, 0.0]), (64, [-(2.0**22), -1.0 / 1024, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")

    def exact(v):
        return [math.floor(Fraction(x) * 1024) for x in v]

    want = []
    for q, v in rows:
        if q % 10 == 0:
            scores = sorted((-sum(a * b for a, b in zip(exact(v), exact(w), strict=True)), i) for i, w in rows if i != q)[:20]
            want += [(q, r, i, -s if -(2**63) <= -s < 2**63 else None) for r, (s, i) in enumerate(scores, 1)]
    assert any(w[3] is None for w in want)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in P.top_k(frame, 20, 10).collect()) == sorted(want)


def test_elimination_stops_early():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.05, (300, 8)) for c in (0, 3, -3, 6)])
    x = np.floor(x * 1024).astype("<i8")
    pivots = x[::60].astype(float)
    far = lambda v: np.sqrt(((v.astype(float) - pivots) ** 2).sum(1)).tobytes()
    block = P.Block(list(range(1000, 2200)), [False] * len(x), [v.tobytes() for v in x], [far(v) for v in x])
    evaluated = 0
    for i, q in enumerate(x[:5] + 3000):
        best, n = block.top(i, q.tobytes(), False, far(q), 10, -np.inf)
        assert best == sorted(zip((-(x @ q)).tolist(), range(1000, 2200), strict=True))[:10]
        evaluated += n
    assert evaluated < 5 * len(x)


def test_queries_go_only_where_they_can_reach(spark, monkeypatch):
    monkeypatch.setattr(P, "ROW_BLOCK", 50)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 8)) * 50
    rows = [(i, (centres[i % 20] + rng.normal(size=8)).tolist()) for i in range(2000)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    sent = []
    plain = P.meet
    monkeypatch.setattr(P, "meet", lambda rows, queries, k, parts: (sent.append(queries.count()), plain(rows, queries, k, parts))[1])
    assert sorted(tuple(r) for r in P.top_k(frame).collect()) == brute(rows)
    assert sent[0] == 20 and sent[1] < 20 * 20  # of 40 blocks or more each
