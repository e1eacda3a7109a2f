"""Main text of web pages by a recurrent block labeller.

A page is the sequence of its leaf blocks (html_blocks.py). Each has a vector of its tag path (tags, classes and ids,
hashed with their place in the path), a vector of hashed words, and a few plain numbers. A bidirectional LSTM in numpy
reads the whole sequence both ways, so that each block is classified in the context of the document; blocks of the
article are joined by a space.

The weights are learned when first needed, from ``pages`` made-up pages of many layouts (html_corpus.py) whose blocks
are known; a seed makes them the same everywhere. No page of the input is learned from.

A null page is an empty one, its text is empty. Scripts, styles and comments are never blocks. Repeated rows get the
same text. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from assetlens.llm.common import table
from assetlens.llm.html_blocks import Block, Path, blocks
from assetlens.llm.html_corpus import Maker

PATH, WORDS, PLAIN, HIDDEN = 192, 96, 12, 28
WIDTH = PATH + WORDS + PLAIN
#: Made-up pages to learn from, passes over them, and their seed.
PAGES, PASSES, SEED = 3600, 4, 11
#: Blocks that are held as vectors at once.
AT_ONCE = 1 << 12
_WORD = re.compile(r"\w+")


@lru_cache(1 << 16)
def _bucket(key: str, n: int) -> int:
    return zlib.crc32(key.encode()) % n


def _keys(tag: str, names: tuple[str, ...], mark: str = "") -> int:
    """Bits of the places of a tag and its words."""
    bits = 1 << _bucket(f"t{mark} {tag}", PATH)
    for w in names:
        bits |= 1 << _bucket(f"c{mark} {w}", PATH)
    return bits


@lru_cache(1 << 14)
def _places(bits: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(PATH // 8, "little"), np.uint8), bitorder="little"))


def _path_places(path: Path | None) -> np.ndarray:
    """Places of all tags of a path, and of the two innermost by where they are. Every node keeps the bits of all tags around it."""
    if path is None:
        return np.zeros(0, np.int64)
    new, node = [], path
    while node is not None and node.cache is None:
        new.append(node)
        node = node.up
    for node in reversed(new):
        bits = _keys(node.tag, node.names) | (node.up.cache[0] if node.up else 0)
        near = bits | _keys(node.tag, node.names, "0") | (_keys(node.up.tag, node.up.names, "1") if node.up else 0)
        node.cache = (bits, near)
    return _places(path.cache[1])


def vectors(found: list[Block], start: int = 0, stop: int | None = None) -> np.ndarray:
    """A row for each block of a page, or for those from start to stop."""
    n = len(found)
    x = np.zeros(((n if stop is None else stop) - start, WIDTH), np.float32)
    for row, b in enumerate(found[start:stop]):
        i = start + row
        x[row, _path_places(b.path)] = 1
        text = b.text
        words = _WORD.findall(text.lower())
        counts = np.bincount([zlib.crc32(w.encode()) % WORDS for w in words], minlength=WORDS) if words else np.zeros(WORDS)
        x[row, PATH : PATH + WORDS] = counts / max(1.0, np.sqrt(len(words)))
        size, k = len(text), len(words)
        x[row, PATH + WORDS :] = (
            np.log1p(size) / 6, np.log1p(k) / 4, b.linked / size, size < 30, sum(map(text.count, ".,!?;")) / (k + 1),
            text[-1] in ".!?:", "©" in text, text[0].isupper(), i / n, (n - i) / n, 1 / (1 + i), (b.path.depth if b.path else 0) / 8,
        )
    return x


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    w = {}
    for d in ("f", "b"):
        w[f"x{d}"] = rng.normal(0, WIDTH**-0.5, (WIDTH, 4 * HIDDEN))
        w[f"h{d}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
        w[f"a{d}"] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]
    w["out"], w["bias"] = rng.normal(0, 0.1, 2 * HIDDEN), np.zeros(1)
    return {k: v.astype(np.float32) for k, v in w.items()}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _scan(x: np.ndarray, mask: np.ndarray, wx, wh, a, keep: list | None, state: tuple | None = None) -> tuple[np.ndarray, tuple]:
    """Hidden states (time, page, unit) of one direction, and the last state; x is (time, page, feature). keep: gets what the way back needs."""
    steps, pages, _ = x.shape
    z_all = x.reshape(steps * pages, -1) @ wx + a
    z_all = z_all.reshape(steps, pages, -1)
    h, c = state or (np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32))
    out = np.empty((steps, pages, HIDDEN), np.float32)
    for t in range(steps):
        z = z_all[t] + h @ wh
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t, :, None]
        new_c = m * (f * c + i * g) + (1 - m) * c
        tanh_c = np.tanh(new_c)
        new_h = m * (o * tanh_c) + (1 - m) * h
        if keep is not None:
            keep.append((h, c, i, f, o, g, tanh_c, m))
        h, c = new_h, new_c
        out[t] = h
    return out, (h, c)


def forward(x: np.ndarray, mask: np.ndarray, w: dict, keep: dict | None = None) -> np.ndarray:
    """Log-odds (time, page) that blocks belong to the article. Pages end in padding; the way back passes it unchanged."""
    sides = []
    for d in ("f", "b"):
        kept: list | None = None if keep is None else keep.setdefault(d, [])
        turn = slice(None) if d == "f" else slice(None, None, -1)
        sides.append(_scan(x[turn], mask[turn], w[f"x{d}"], w[f"h{d}"], w[f"a{d}"], kept)[0][turn])
    both = np.concatenate(sides, 2)
    if keep is not None:
        keep["both"] = both
    return both @ w["out"] + w["bias"][0]


def in_pieces(page: list[Block], w: dict) -> np.ndarray:
    """Log-odds of one long page: both ways carry their state from piece to piece, so that only one piece is held as vectors."""
    n, sums = len(page), np.full(len(page), w["bias"][0])
    for k, d in enumerate(("f", "b")):
        state = None
        starts = range(0, n, AT_ONCE) if d == "f" else reversed(range(0, n, AT_ONCE))
        turn = slice(None) if d == "f" else slice(None, None, -1)
        for a in starts:
            x = vectors(page, a, min(n, a + AT_ONCE))[:, None][turn]
            h, state = _scan(x, np.ones(x.shape[:2], np.float32), w[f"x{d}"], w[f"h{d}"], w[f"a{d}"], None, state)
            sums[a : a + AT_ONCE] += (h @ w["out"][k * HIDDEN : (k + 1) * HIDDEN])[:, 0][turn]
    return sums


def gradients(x: np.ndarray, mask: np.ndarray, y: np.ndarray, w: dict) -> dict[str, np.ndarray]:
    keep: dict = {}
    p = _sigmoid(forward(x, mask, w, keep))
    d_logit = ((p - y) * mask / mask.sum()).astype(np.float32)
    grads = {"out": np.tensordot(d_logit, keep["both"], ([0, 1], [0, 1])), "bias": d_logit.sum(keepdims=True).ravel()[:1]}
    d_both = d_logit[..., None] * w["out"]
    for k, d in enumerate(("f", "b")):
        turn = slice(None) if d == "f" else slice(None, None, -1)
        d_out, xs = d_both[turn][..., k * HIDDEN : (k + 1) * HIDDEN], x[turn]
        steps, pages = xs.shape[:2]
        d_z = np.empty((steps, pages, 4 * HIDDEN), np.float32)
        d_h, d_c, g_h = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32), np.zeros_like(w[f"h{d}"])
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, g, tanh_c, m = keep[d][t]
            whole = d_h + d_out[t]
            d_new, d_old = m * whole, (1 - m) * whole
            d_cell = d_new * o * (1 - tanh_c**2) + m * d_c
            d_z[t] = np.concatenate([d_cell * g * i * (1 - i), d_cell * c * f * (1 - f), d_new * tanh_c * o * (1 - o), d_cell * i * (1 - g**2)], 1)
            d_h = d_old + d_z[t] @ w[f"h{d}"].T
            d_c = d_cell * f + (1 - m) * d_c
            g_h += h.T @ d_z[t]
        flat = d_z.reshape(steps * pages, -1)
        grads |= {f"x{d}": xs.reshape(steps * pages, -1).T @ flat, f"h{d}": g_h, f"a{d}": flat.sum(0)}
    return grads


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x, mask = np.zeros((longest, len(pages), pages[0].shape[1]), np.float32), np.zeros((longest, len(pages)), np.float32)
    for k, v in enumerate(pages):
        x[: len(v), k], mask[: len(v), k] = v, 1
    return x, mask


def made_up(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of made-up pages."""
    maker, out = Maker(seed), []
    for _ in range(n):
        page, labels = maker.page()
        found = blocks(page)
        if len(found) == len(labels):
            out.append((vectors(found), np.array([y for _, y in labels], np.float32)))
    return out


@lru_cache(2)
def learned(pages: int = PAGES, passes: int = PASSES, seed: int = SEED) -> dict[str, np.ndarray]:
    """Weights after Adam steps over made-up pages."""
    rng = np.random.default_rng(seed)
    w, data = initial(rng), made_up(pages, seed)
    m, v, step = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    total = passes * -(-len(data) // 16)
    for _ in range(passes):
        order = rng.permutation(len(data))
        order = np.concatenate(sorted(np.array_split(order, max(1, len(order) // 256)), key=lambda part: part[0]))
        for a in range(0, len(order), 256):  # pages of about one length go together
            near = sorted(order[a : a + 256], key=lambda k: len(data[k][0]))
            for b in range(0, len(near), 16):
                part = near[b : b + 16]
                x, mask = padded([data[k][0] for k in part])
                x = x * (rng.random((1, len(part), WIDTH)) > 0.08)  # no single class or tag has to be there
                y, _ = padded([data[k][1][:, None] for k in part])
                step += 1
                rate = 0.006 * (1 - step / (total + 1)) + 1e-4
                for k, g in gradients(x.astype(np.float32), mask, y[..., 0], w).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


def label(pages: list[list[Block]], w: dict) -> list[np.ndarray]:
    """For each page, which blocks belong to the article. Pages of about one length go together."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
    part: list[int] = []
    for n, k in enumerate(order):
        part.append(k)
        # a part is closed before the page that would make it too large; a page that is too large alone goes in pieces
        if n == len(order) - 1 or (len(part) + 1) * len(pages[order[n + 1]]) > AT_ONCE:
            if len(pages[k]) > AT_ONCE:
                logits = in_pieces(pages[k], w)[:, None]
            else:
                logits = forward(*padded([vectors(pages[j]) for j in part]), w)
            for column, j in enumerate(part):
                out[j] = logits[: len(pages[j]), column] > 0
            part = []
    return out


def main_texts(pages: list[str | None], w: dict) -> list[str]:
    found = [blocks(p) if p else [] for p in pages]
    return [" ".join(b.text for b, keep in zip(bs, keeps, strict=True) if keep) for bs, keeps in zip(found, label(found, w), strict=True)]


def extractor(w: dict | None = None):
    """A column function: page to main text."""
    w = learned() if w is None else w

    @pandas_udf("string")
    def text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in parts:
            out: list[str] = []
            for a in range(0, len(pages), 256):
                out += main_texts(pages.iloc[a : a + 256].tolist(), w)
            yield pd.Series(out, dtype=object)

    return text


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", extractor()(F.col("html").cast("string")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("bigint"))
