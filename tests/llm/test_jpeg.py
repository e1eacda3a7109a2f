import hashlib
import random
import zlib

import numpy as np
import pytest

from assetlens.llm import jpeg_media as J


def pad(t):
    b = (t or "").encode()
    return b + b" " * (-len(b) % 192 if b else 192)


def check(rows, docs):
    want = sorted((str(d), len((t or "").encode()), len(p := pad(t)), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])) for d, t in docs)
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    for r in rows:
        assert r.media_bytes >= r.payload_bytes and len(r.media_sha256) == 64 and r.feature


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = J.op5_jpeg_media(spark, sf).collect()
    check(rows, docs)
    of, text = {}, dict(docs)
    for r in rows:
        assert of.setdefault(text[r.doc_id], (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_cases(spark, tmp_path):
    docs = [(1, None), (1, ""), (None, " "), (2, "“quotes” – \x00\x01" * 50), (3, "é" * 96), (4, "x" * 192), (5, "y" * 193), (6, "\x00" * 400), (7, "z" * 50_000)]
    frame = spark.createDataFrame([(d, t, b"m") for d, t in docs], "doc_id bigint, text string, media binary")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    check(J.op5_jpeg_media(spark, str(tmp_path)).collect(), docs)
    assert J.read(J.store(frame.limit(0))).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_any_bytes_round_trip(seed, monkeypatch):
    r = random.Random(seed)
    payloads = [bytes(r.choice((128, 128, 0, r.randrange(256))) if r.random() < share else 65 for _ in range(192 * r.randint(1, 30))) for share in (0, 0.01, 0.3, 0.9, 1.0)]
    payloads.append(bytes([128]) * 192 * 5)
    for payload, (head, c) in zip(payloads, J.decode([J.encode(p) for p in payloads]), strict=True):
        assert (c + 128).astype(np.uint8).tobytes()[: len(payload)] == payload
        first = np.frombuffer(payload, np.uint8).reshape(-1, 192)[:, 0].astype(int) - 128
        pixels = J.thumbnail(head, c).ravel()[: len(first)]
        assert (pixels == np.clip(first // 8 + 128, 0, 255)).all()


def test_predicted_dc_and_longer_intervals():
    """A grey image written without restarts: DC coefficients are coded as differences."""
    dc = [5, -3, 100, 100, 0, -128]
    acc, n, before = 1, 0, 0
    for v in dc:
        for code, length in (J._coefficient(v - before, J.DC_CODES), J.AC_CODES[0]):
            acc, n = acc << length | code, n + length
        before = v
    pad = -n % 8
    acc = acc << pad | (1 << pad) - 1
    data = (acc ^ 1 << (n + pad)).to_bytes((n + pad) // 8, "big").replace(b"\xff", b"\xff\x00")
    head = b"\xff\xd8" + J._segment(0xDB, bytes([0] + [16] * 64)) + J._segment(0xC4, J._tables(0, J.DC_SYMBOLS)) + J._segment(0xC4, J._tables(0x10, J.AC_SYMBOLS))
    media = head + J._segment(0xC0, bytes([8, 0, 16, 0, 24, 1, 1, 0x11, 0])) + J._segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + data + b"\xff\xd9"
    [(found, c)] = J.decode([media])
    assert c[:, 0, 0].tolist() == dc and J.thumbnail(found, c).shape == (2, 3)
    with pytest.raises(ValueError):
        J.parse(media.replace(b"\xff\xc0", b"\xff\xc2"))
