import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from assetlens.llm import best_fit_packing as B


def verify(rows, docs, most):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d, text in docs:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        cuts = [0, len(ids)] if len(ids) <= most else [0, *range(len(ids) % most or most, len(ids) + 1, most)]
        want += [(d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= most
    total = sum(r.length for r in rows)
    return len(bins), -(-total // most)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n, least = verify(B.op4_best_two_fit(spark, sf).collect(), docs, 2048)
    assert n <= least + 2


def test_cases(spark, monkeypatch):
    docs = [(1, None), (1, None), (2, ""), (None, "abc"), (3, "a" * 500), (4, "word " * 300), (5, "<|endoftext|> é 😀 \n\n  x's"), (6, "w" * 63 + " \t"), (7, "it's 12 ok.  " * 40)]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, length int")
    for block in (20_000, 3):
        monkeypatch.setattr(B, "BLOCK", block)
        verify(B.pack_documents(frame, 16).collect(), docs, 16)
    assert B.pack_documents(frame.limit(0), 16).collect() == []
    kept = {(r.doc_id, r.piece): bytes(r.ids) for r in B.pack_documents(frame, 16, keep_ids=True).collect()}
    assert all(zlib.crc32(kept[r.doc_id, r.piece]) == r.ids_crc32 for r in B.pack_documents(frame, 16).collect() if r.doc_id not in (1, None))


def test_added_tokens_of_the_queries(spark, tmp_path):
    """Both queries give the ids of the tokenizers file at its defaults, added tokens and all."""
    import corpus_pipeline

    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n  y", " <|endoftext|>  <|endoftext|", "<|ENDOFTEXT|> <|<|endoftext|>|>", "plain é 😀", "", None]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {x.content: k for k, x in t.get_added_tokens_decoder().items()} == B.SPECIAL
    assert t.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    want = {k: zlib.crc32(np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for k, x in enumerate(texts)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.ids_crc32 for r in B.op4_best_two_fit(spark, str(tmp_path)).collect()} == want
    assert {r.doc_id: r.ids_crc32 for r in corpus_pipeline.packing(spark, docs, str(tmp_path)).collect()} == want


def test_ids_of_random_texts():
    r = random.Random(4)
    t, known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), B.tokens()
    parts = ["<|endoftext|>", "<|", "|>", "endoftext", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\u3000", "\u00a0", "it's", "'S", "word", "Wörter", "日本語", "😀", "é", "e\u0301", "123", "1", "_", "...", "\x00", "\u200d"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert np.frombuffer(known.of(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_full_pieces_are_sequences_of_their_own(spark):
    docs = spark.createDataFrame([(i, "a b c d e f g h " * 10) for i in range(30)], "doc_id bigint, text string")
    rows = B.pack_documents(docs, 8, block=10).collect()
    full = [r.sequence_id for r in rows if r.length == 8]
    assert len(full) == len(set(full)) == 300 and not set(full) & {r.sequence_id for r in rows if r.length < 8} and {r.offset for r in rows if r.length == 8} == {0}
    verify(rows, [(i, "a b c d e f g h " * 10) for i in range(30)], 8)


def test_best_two_fit():
    assert sorted(map(sorted, B.best_two_fit(np.array([6, 5, 3, 2, 2]), 10))) in ([[2, 2, 6], [3, 5]], [[2, 3, 5], [2, 6]])
    rng = np.random.default_rng(1)
    for most, n in ((10, 50), (100, 3000), (2048, 5000)):
        lengths = rng.integers(1, most + 1, n)
        bins = list(B.best_two_fit(lengths, most))
        assert sorted(x for b in bins for x in b) == sorted(lengths.tolist()) and max(map(sum, bins)) <= most
        assert len(bins) <= sum(lengths > most // 2) + max(0, (lengths.sum() - most * (lengths > most // 2).sum()) / most) + n * 0.02 + 2
