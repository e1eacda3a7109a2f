"""Payloads in baseline JPEG files, and what can be read from such files without an inverse transform.

A payload of 192-byte units is stored as quantised coefficients: a unit is one 4:4:4 MCU, 64 bytes for each of Y, Cb and
Cr in zigzag order, a byte b as the coefficient b - 128. The quantisers are 1 and every MCU is a restart interval. The
Huffman tables give most coefficients eight bits. An image is about as wide as high; units that fill it up are zeros,
and a comment segment tells the payload's length.

The reader takes baseline files with restart intervals and any tables: it parses the markers and decodes all intervals
of many files side by side in numpy. The luminance thumbnail has a pixel for each block, from its DC coefficient alone.

A null text is stored like an empty one (192 spaces). Repeated rows give equal files. Other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.llm.common import table, utf8

UNIT = 192
AT_ONCE = 1 << 22
#: (symbols of code length 1, 2, ...). AC symbols are run * 16 + category.
DC_SYMBOLS = [[7], [6], [5], [4], [3], [2], [1], [8], [0], [9, 10, 11]] + [[]] * 6
AC_SYMBOLS = [[7], [6], [5], [4], [3], [2], [1]] + [[]] * 6 + [[0x00, 0xF0, 0x08, *(16 * r + s for r in range(1, 16) for s in range(1, 9))]] + [[]] * 2


def codes(symbols: list[list[int]]) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: symbol to (code, length)."""
    out, code = {}, 0
    for length, group in enumerate(symbols, 1):
        for s in group:
            out[s] = (code, length)
            code += 1
        code <<= 1
    return out


def _coefficient(v: int, table: dict[int, tuple[int, int]], run: int = 0) -> tuple[int, int]:
    size = abs(v).bit_length()
    code, length = table[run * 16 + size]
    return code << size | (v if v > 0 else v + (1 << size) - 1 if size else 0), length + size


DC_CODES, AC_CODES = codes(DC_SYMBOLS), codes(AC_SYMBOLS)
_EIGHT = np.array([_coefficient(b - 128, AC_CODES)[0] if b not in (0, 128) else 0 for b in range(256)], np.uint8)
assert all(_coefficient(b - 128, DC_CODES) == _coefficient(b - 128, AC_CODES) == (int(_EIGHT[b]), 8) for b in range(256) if b not in (0, 128))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _tables(kind: int, symbols: list[list[int]]) -> bytes:
    return bytes([kind, *map(len, symbols), *(s for group in symbols for s in group)])


_HEAD = b"\xff\xd8" + _segment(0xDB, bytes([0] + [1] * 64)) + _segment(0xC4, _tables(0x00, DC_SYMBOLS)) + _segment(0xC4, _tables(0x10, AC_SYMBOLS)) + _segment(0xDD, struct.pack(">H", 1))
_SCAN = _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))


def _unit_bits(unit: bytes) -> bytes:
    """One MCU, coefficient by coefficient; for those that hold bytes 0 or 128."""
    acc, n = 1, 0
    for c in range(0, UNIT, 64):
        tokens, run = [_coefficient(unit[c] - 128, DC_CODES)], 0
        for b in unit[c + 1 : c + 64]:
            if b == 128:
                run += 1
                continue
            while run > 15:
                tokens.append(AC_CODES[0xF0])
                run -= 16
            tokens.append(_coefficient(b - 128, AC_CODES, run))
            run = 0
        if run:
            tokens.append(AC_CODES[0x00])
        for code, length in tokens:
            acc, n = acc << length | code, n + length
    pad = -n % 8
    acc = acc << pad | (1 << pad) - 1
    return (acc ^ 1 << (n + pad)).to_bytes((n + pad) // 8, "big").replace(b"\xff", b"\xff\x00")


_ZERO_UNIT = _unit_bits(bytes([128]) * UNIT)


def encode(payload: bytes) -> bytes:
    """A payload of whole units as a JPEG file."""
    n = len(payload) // UNIT
    wide = min(8191, -(-n // 1) if n < 3 else int(np.ceil(np.sqrt(n))))
    high = -(-n // wide)
    head = _HEAD + _segment(0xC0, struct.pack(">BHHB", 8, high * 8, wide * 8, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])) + _segment(0xFE, b"payload=%d" % len(payload)) + _SCAN
    units = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    odd = np.flatnonzero(((units == 0) | (units == 128)).any(1))
    total = wide * high
    out = np.empty((n, UNIT + 2), np.uint8)
    out[:, :UNIT] = _EIGHT[units]
    out[:, UNIT] = 0xFF
    out[:, UNIT + 1] = 0xD0 + np.arange(n) % 8
    if not len(odd) and n == total:
        return head + out.tobytes()[:-2] + b"\xff\xd9"
    body, last = [], 0
    for i in odd.tolist():
        body += [out[last:i].tobytes(), _unit_bits(units[i].tobytes()), bytes([0xFF, 0xD0 + i % 8])]
        last = i + 1
    body.append(out[last:n].tobytes())
    body += [_ZERO_UNIT + bytes([0xFF, 0xD0 + i % 8]) for i in range(n, total)]
    return head + b"".join(body)[:-2] + b"\xff\xd9"


def parse(media: bytes) -> dict:
    """Marker segments of a baseline file: size, components, tables, restart interval, comment, and the scan's bytes."""
    if media[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    out, at = {"dht": {}, "dqt": {}, "restart": 0, "comment": b""}, 2
    while True:
        marker, length = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
        body = media[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xC0:
            _, out["height"], out["width"], n = struct.unpack(">BHHB", body[:6])
            out["components"] = [tuple(body[6 + 3 * i : 9 + 3 * i]) for i in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker != 0xC4:
            raise ValueError("only baseline files are read")
        elif marker == 0xC4:
            while body:
                counts = body[1:17]
                n = sum(counts)
                out["dht"][body[0]] = (counts, body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDB:
            out["dqt"][body[0] & 15] = body[1:65]
        elif marker == 0xDD:
            out["restart"] = int.from_bytes(body, "big")
        elif marker == 0xFE:
            out["comment"] = body
        elif marker == 0xDA:
            out["scan"] = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            end = len(media) - 2 if media[-2:] == b"\xff\xd9" else len(media)
            return out | {"data": media[at:end]}


@lru_cache(64)
def lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For the next 16 bits: symbol and code length (0: no code)."""
    symbol, length, code, k = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8), 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            a, b = code << 16 - n, code + 1 << 16 - n
            symbol[a:b], length[a:b] = symbols[k], n
            code, k = code + 1, k + 1
        code <<= 1
    return symbol, length


@lru_cache(64)
def lookup_values(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For the next 16 bits: value and bits used of a coefficient without a run, where both fit; else 0 bits."""
    symbol, length = lookup(counts, symbols)
    size = (symbol & 15).astype(np.int64)
    length = length.astype(np.int64)
    ok = (length > 0) & (symbol >> 4 == 0) & (size > 0) & (length + size <= 16)
    bits = np.arange(1 << 16) >> np.clip(16 - length - size, 0, 16) & (1 << size) - 1
    value = np.where(bits >> np.clip(size - 1, 0, 16) > 0, bits, bits - (1 << size) + 1)
    return np.where(ok, value, 0).astype(np.int16), np.where(ok, length + size, 0).astype(np.int64)


def _intervals(data: bytes) -> list[bytes]:
    """The scan's restart intervals, without stuffed zeros."""
    raw = np.frombuffer(data, np.uint8)
    at = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7)).tolist()
    return [data[a:b].replace(b"\xff\x00", b"\xff") for a, b in zip([0, *(x + 2 for x in at)], [*at, len(data)], strict=True)]


class _Bits:
    """Many bit streams read side by side."""

    def __init__(self, streams: list[bytes]):
        lengths = np.fromiter(map(len, streams), np.int64, len(streams))
        raw = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
        self.window = np.ndarray((len(raw) - 8,), ">u8", raw, strides=(1,))
        self.at = np.r_[0, np.cumsum(lengths)[:-1]] * 8

    def peek(self, lanes=slice(None)) -> np.ndarray:
        at = self.at[lanes]
        return self.window[np.minimum(at >> 3, len(self.window) - 1)].astype(np.uint64) << (at & 7).astype(np.uint64)

    def symbol(self, table, lanes) -> tuple[np.ndarray, np.ndarray]:
        """The next symbol, and the value of the bits that follow it (as many as its low half says)."""
        x = self.peek(lanes)
        code = (x >> np.uint64(48)).astype(np.int64)
        symbol, length = table[0][code], table[1][code].astype(np.uint64)
        if (length == 0).any():
            raise ValueError("broken Huffman code")
        size = (symbol & 15).astype(np.uint64)
        bits = (((x << length) >> np.uint64(1)) >> (np.uint64(63) - size)).astype(np.int64)
        n = size.astype(np.int64)
        value = np.where((n > 0) & (bits < (1 << np.maximum(n - 1, 0))), bits - (1 << n) + 1, bits)
        self.at[lanes] += (length + size).astype(np.int64)
        return symbol, np.where(n > 0, value, 0)


def decode_intervals(streams: list[bytes], dc: list[tuple[bytes, bytes]], ac: list[tuple[bytes, bytes]], mcus: int) -> np.ndarray:
    """Coefficients (stream, MCU, block, zigzag place) of restart intervals that have one structure."""
    lanes, blocks = len(streams), len(dc)
    bits, out = _Bits(streams), np.zeros((mcus * blocks * 64, lanes), np.int16)
    before = np.zeros((blocks, lanes), np.int64)
    for m in range(mcus):
        for c in range(blocks):
            base = (m * blocks + c) * 64
            _, diff = bits.symbol(lookup(*dc[c]), slice(None))
            before[c] += diff
            out[base] = before[c]
            values, used = lookup_values(*ac[c])
            k = 1
            while k < 64:  # as long as no stream has a run
                code = (bits.peek() >> np.uint64(48)).astype(np.int64)
                step = used[code]
                if not step.all():
                    break
                out[base + k] = values[code]
                bits.at += step
                k += 1
            if k == 64:
                continue
            active, place = np.arange(lanes), np.full(lanes, k)
            while len(active):
                symbol, value = bits.symbol(lookup(*ac[c]), active)
                place[active] += symbol >> 4
                coded = (symbol & 15) > 0
                out[base + np.minimum(place[active[coded]], 63), active[coded]] = value[coded]
                place[active] += 1
                place[active[symbol == 0]] = 64
                active = active[place[active] < 64]
    return out.T.reshape(lanes, mcus, blocks, 64)


def decode(files: list[bytes]) -> list[tuple[dict, np.ndarray]]:
    """(marker segments, coefficients (MCU, block, zigzag place)) of each file; components are sampled alike."""
    heads, groups = [parse(f) for f in files], defaultdict(list)
    for i, h in enumerate(heads):
        if any(s != 0x11 for _, s, _ in h["components"]):
            raise ValueError("components must be sampled alike")
        n = -(-h["width"] // 8) * -(-h["height"] // 8)
        every = h["restart"] or n
        streams = _intervals(h["data"])
        tables = tuple((h["dht"][t >> 4], h["dht"][0x10 | t & 15]) for _, t in h["scan"])
        for j, s in enumerate(streams):
            groups[tables, min(every, n - j * every)].append((i, j * every, s))
        h["mcus"] = n
    out = [np.zeros((h["mcus"], len(h["scan"]), 64), np.int16) for h in heads]
    for (tables, mcus), rows in groups.items():
        for a in range(0, len(rows), 1 << 15):
            part = rows[a : a + (1 << 15)]
            found = decode_intervals([s for *_, s in part], [t[0] for t in tables], [t[1] for t in tables], mcus)
            of = np.fromiter((r[0] for r in part), np.int64, len(part))
            start = np.fromiter((r[1] for r in part), np.int64, len(part))
            cuts = np.r_[0, np.flatnonzero(np.diff(of)) + 1, len(part)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                out[of[x]][start[x] : start[y - 1] + mcus] = found[x:y].reshape(-1, *found.shape[2:])
    return list(zip(heads, out, strict=True))


def thumbnail(head: dict, coefficients: np.ndarray) -> np.ndarray:
    """One pixel for each 8 x 8 block of the first component."""
    quantiser = head["dqt"][head["components"][0][2]][0]
    pixels = np.clip(coefficients[:, 0, 0].astype(np.int64) * quantiser // 8 + 128, 0, 255).astype(np.uint8)
    return pixels.reshape(-(-head["height"] // 8), -(-head["width"] // 8))


def average_hash(pixels: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 grid over the pixels are lighter than their mean."""
    rows, columns = (np.arange(n) * 8 // n if n >= 8 else np.arange(n) * 8 // 8 for n in pixels.shape)
    cell = (rows[:, None] * 8 + columns).ravel()
    n = np.bincount(cell, minlength=64)
    mean = np.bincount(cell, pixels.ravel(), 64) / np.maximum(n, 1)
    light = (mean > pixels.mean()) & (n > 0)
    return f"{sum(1 << int(k) for k in np.flatnonzero(light)):016x}"


def padded(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT if text else UNIT)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text as a JPEG file."""

    def each(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            raw, cuts = raw.tobytes(), [0, *_cuts(np.diff(offsets))]
            for a, b in zip(cuts, cuts[1:], strict=False):
                media = [encode(padded(raw[x:y])) for x, y in zip(offsets[a:b].tolist(), offsets[a + 1 : b + 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets[a : b + 1])), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, "doc_id bigint, n_bytes bigint, media binary")


def _cuts(sizes: np.ndarray) -> list[int]:
    """Where to cut rows into runs of about AT_ONCE bytes."""
    if not len(sizes):
        return []
    run = (np.cumsum(sizes) - sizes) // AT_ONCE
    return [*(np.flatnonzero(np.diff(run)) + 1).tolist(), len(sizes)]


def read(media: DataFrame) -> DataFrame:
    """media of store() to width, height, thumbnail, its hashes, and the payload's digests."""

    def each(batches):
        for batch in batches:
            files = batch.column(2)
            cuts = [0, *_cuts(np.diff(utf8(files)[1]))]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = files.slice(a, b - a).to_pylist()
                rows = []
                for media, (head, coefficients) in zip(part, decode(part), strict=True):
                    payload = (coefficients + 128).astype(np.uint8).tobytes()[: int(head["comment"].partition(b"=")[2])]
                    pixels = thumbnail(head, coefficients)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), head["width"], head["height"], pixels.tobytes(), average_hash(pixels), f"{zlib.crc32(pixels.tobytes()):08x}"))
                columns = [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *columns], names=NAMES)

    return media.mapInArrow(each, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, width bigint, height bigint, thumbnail binary, average_hash string, thumbnail_crc32 string")


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "width", "height", "thumbnail", "average_hash", "thumbnail_crc32"]


def op5_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(store(table(spark, sf_dir, "documents")))
    feature = F.concat_ws(":", F.concat_ws("x", "width", "height"), "average_hash", "thumbnail_crc32")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
