"""Both substring operators against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from assetlens.llm import repeats as R
from assetlens.llm.seed_extend import op7_seed_extend, repeated_word_spans
from assetlens.llm.suffix_dedup import multikey_order, op10_suffix_dedup, repeated_byte_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_words(docs, window):
    first = {}
    texts = [(d, WORD.findall(t or "")) for d, t in docs]
    for d, w in texts:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def brute_bytes(docs, length):
    first = {}
    texts = [(d, (t or "").encode()) for d, t in docs]
    for d, b in texts:
        for i in range(len(b) - length + 1):
            k = b[i : i + length]
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (d, i):
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


def corpus(seed, n=120):
    r = random.Random(seed)
    vocab = ["a", "the", "ab", "é", "x" * 30, *(f"w{i}" for i in range(40))]
    passage = [[r.choice(vocab) for _ in range(r.randint(10, 80))] for _ in range(6)]
    docs = []
    for i in range(n):
        w = []
        for _ in range(r.randint(0, 5)):
            w += r.choice(passage) if r.random() < 0.6 else [r.choice(vocab) for _ in range(r.randint(1, 60))]
            if r.random() < 0.3 and w:
                w[r.randrange(len(w))] = "edit"
        docs.append((i * 3, r.choice([" ", "\n", "  "]).join(w)))
    docs += [(1000, None), (1001, ""), (1002, "go " * 300), (1003, "go " * 200), (1004, docs[5][1]), (1005, "ab" * 400), (1006, "ab" * 300)]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, bucket string").repartition(5)


@pytest.mark.parametrize("seed,chunk", [(1, None), (2, 512)])
def test_words(spark, seed, chunk, monkeypatch):
    docs = corpus(seed)
    got = repeated_word_spans(frame(spark, docs), window=20).collect()
    assert sorted((r.doc_id, r.n_units, sum(s["end"] - s["start"] for s in r.spans), bytes(r.kept).decode()) for r in got) == brute_words(docs, 20)


@pytest.mark.parametrize("seed", [3, 4])
def test_bytes(spark, seed):
    docs = corpus(seed)
    got = repeated_byte_spans(frame(spark, docs), length=50).collect()
    assert sorted((r.doc_id, r.n_units, sum(s["end"] - s["start"] for s in r.spans), len(r.spans), bytes(r.kept)) for r in got) == brute_bytes(docs, 50)


def test_hot_seeds_and_repeated_rows(spark):
    shared = " ".join(f"s{i}" for i in range(40))
    docs = [(i, f"l{i} k{i} {shared} r{i} q{i}") for i in range(300)]
    got = repeated_word_spans(frame(spark, docs), window=20).collect()
    assert sorted((r.doc_id, r.n_units, sum(s["end"] - s["start"] for s in r.spans), bytes(r.kept).decode()) for r in got) == brute_words(docs, 20)
    got = repeated_byte_spans(frame(spark, docs), length=60).collect()
    assert sorted((r.doc_id, r.n_units, sum(s["end"] - s["start"] for s in r.spans), len(r.spans), bytes(r.kept)) for r in got) == brute_bytes(docs, 60)
    twice = repeated_word_spans(frame(spark, docs[:1] + docs[:1]), window=20).collect()
    assert [len(r.spans) for r in twice] == [0, 0]
    # a null doc_id is later than all others
    got = {r.doc_id: len(r.spans) for r in repeated_word_spans(frame(spark, [(None, docs[0][1]), (7, docs[0][1])]), window=20).collect()}
    assert got == {None: 1, 7: 0}


def test_long_texts_in_parts(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(R, "CHUNK", 300)
    r = random.Random(9)
    texts = ["".join(r.choice("abc") for _ in range(2000)), "x" * 50, "".join(r.choice("abc") for _ in range(290))]
    row, start, n, anchor, seeds = R.contexts(R.Bytes(pa.array(texts)), 60, 16)
    seen = {(int(d), int(p) + i) for d, p, k in zip(row, start, n, strict=True) for i in range(k)}
    assert seen == {(d, p) for d, t in enumerate(texts) for p in range(len(t) - 59)}
    assert (np.asarray(n) > 0).all()


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert repeated_word_spans(none).collect() == [] and repeated_byte_spans(none).collect() == []


def test_queries(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    digest = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
    got = sorted(tuple(r) for r in op7_seed_extend(spark, sf).collect())
    assert got == [(d, n, g, digest(k)) for d, n, g, k in brute_words(docs, 50)]
    got = sorted(tuple(r) for r in op10_suffix_dedup(spark, sf).collect())
    assert got == [(d, n, g, s, digest(k)) for d, n, g, s, k in brute_bytes(docs, 100)]


def test_multikey_order():
    import numpy as np

    r = np.random.default_rng(3)
    for n, depth, letters in ((0, 2, 3), (1, 2, 3), (500, 3, 2), (3000, 4, 5), (400, 2, 2**60)):
        words, part = r.integers(0, letters, (n, depth)).astype(np.uint64), r.integers(0, 3, n)
        order, group = multikey_order(words, part)
        rows = [(int(part[k]), *words[k].tolist()) for k in order]
        assert rows == sorted(rows) and sorted(order.tolist()) == list(range(n))
        assert all((group[i] == group[i - 1]) == (rows[i] == rows[i - 1]) for i in range(1, n))


def test_crowded_seeds_meet_by_extension(spark, monkeypatch):
    monkeypatch.setattr(R, "HOT", 2)
    monkeypatch.setattr(R, "CROWD", 3)
    for seed in (5, 6):
        docs = corpus(seed)
        got = repeated_word_spans(frame(spark, docs), window=20).collect()
        assert sorted((r.doc_id, r.n_units, sum(s["end"] - s["start"] for s in r.spans), bytes(r.kept).decode()) for r in got) == brute_words(docs, 20)


def test_find_decides_no_repeat(spark):
    docs = frame(spark, corpus(7)).select("doc_id", "text")
    for units, window, by_doc in ((R.Words, 20, True), (R.Bytes, 50, False)):
        kinds = {r.kind for r in R.find(docs, units, window, 16, by_doc, (4, 32)).select("kind").collect()}
        assert kinds == {R.OPEN}


def test_ids_that_are_all_null_or_equal(spark):
    docs = [(i, t) for i, (_, t) in enumerate(corpus(8, 40))]
    got = repeated_word_spans(frame(spark, [(None, t) for _, t in docs]), window=20).collect()
    assert all(not r.spans for r in got) and len(got) == len(docs)
    got = repeated_byte_spans(frame(spark, [(4, t) for _, t in docs]), length=50).collect()
    want = brute_bytes(docs, 50)
    # which of two texts of one id is earlier is up to a hash
    assert len(got) == len(docs) and {r.doc_id for r in got} == {4} and any(r.spans for r in got)
    assert sum(r.n_units for r in got) == sum(w[1] for w in want)
