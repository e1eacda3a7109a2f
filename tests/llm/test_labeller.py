import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from assetlens.llm import block_labeller as B
from assetlens.llm.html_blocks import blocks
from assetlens.llm.html_corpus import Maker
from tests.llm.page_families import FAMILIES, Pages

PROSE = "The river had been rising for three days, and nobody in the village slept. "


@pytest.fixture(scope="module")
def weights():
    return B.learned()


def test_blocks_decode_and_keep_order():
    page = "<p>a &amp;  b&#33;<!-- no --><br>c <b>d</b>\n</p><script>if (a < b) {}</script><div>x<p>y</div>z"
    assert [b.text for b in blocks(page)] == ["a & b! c d", "x", "y", "z"]
    assert blocks("") == [] and blocks("<style>p{}</style><!-- x") == []


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(1)
    w = {k: v.astype(np.float64) for k, v in B.initial(rng).items()}
    x, mask = rng.normal(size=(4, 2, B.WIDTH)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], float)
    y = rng.integers(0, 2, (4, 2)).astype(float)

    def loss(v):
        z = B.forward(x, mask, v)
        return float(((np.log1p(np.exp(z)) - y * z) * mask).sum() / mask.sum())

    grads = B.gradients(x, mask, y, w)
    for name in w:
        at = tuple(rng.integers(0, n) for n in w[name].shape)
        moved = {k: v.copy() for k, v in w.items()}
        moved[name][at] += 1e-4
        up = loss(moved)
        moved[name][at] -= 2e-4
        assert abs((up - loss(moved)) / 2e-4 - grads[name][at]) < 1e-4


def test_unseen_made_up_pages(weights):
    maker, right, total = Maker(12345), 0, 0
    for _ in range(150):
        page, labels = maker.page("named")
        found = blocks(page)
        assert [b.text for b in found] == [" ".join(B.blocks(t)[0].text.split()) if B.blocks(t) else "" for t, _ in labels if t.strip()]
        keep = B.label([found], weights)[0]
        right += int((keep == np.array([bool(y) for _, y in labels])).sum())
        total += len(labels)
    assert right / total > 0.99


@pytest.mark.parametrize("family", FAMILIES)
def test_layouts_that_training_has_not_seen(weights, sf, family):
    """Words of hand-written layouts (page_families.py): precision and recall of each layout."""
    prose = [" ".join(t.split()) for t in pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist() if t and 20 < len(t.split()) < 150]
    pages, right, found, real = Pages(5, prose), 0, 0, 0
    for _ in range(60):
        page, texts = getattr(pages, family)()
        got, want = Counter(B.main_texts([page], weights)[0].split()), Counter(" ".join(texts).split())
        right, found, real = right + (got & want).total(), found + got.total(), real + want.total()
    assert right / found >= 0.95 and right / real >= 0.95, (right / found, right / real)


def test_long_pages_take_bounded_memory(weights, monkeypatch):
    import tracemalloc

    short, long = f"<article>{f'<p>{PROSE}</p>' * 10}</article>", f"<article>{f'<p>{PROSE}</p>' * 100_000}</article>"
    found = [blocks(p) for p in [short] * 255 + [long]]
    tracemalloc.start()
    keep = B.label(found, weights)
    assert tracemalloc.get_traced_memory()[1] < 500e6 and len(keep[-1]) == 100_000 and keep[-1].mean() > 0.9
    tracemalloc.stop()
    # in pieces as at once
    page = blocks(f"<nav><a href=/>Home</a></nav><article>{f'<p>{PROSE}</p><p>x</p>' * 40}</article><footer>All rights reserved</footer>")
    at_once = B.forward(*B.padded([B.vectors(page)]), weights)[:, 0]
    monkeypatch.setattr(B, "AT_ONCE", 16)
    assert np.abs(B.in_pieces(page, weights) - at_once).max() < 1e-3


def test_query_on_odd_rows(spark, weights, tmp_path):
    page = (
        '<html><head><title>T</title></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/x">About</a></li></ul></nav>'
        f'<article><h1>Flood &amp; fire</h1><p>{PROSE * 3}</p><p>{PROSE * 2}</p></article>'
        '<section class="comments"><div class="comment"><p>First!</p></div></section><footer>&copy; 2020 Example Ltd</footer></body></html>'
    )
    rows = [(1, "u", page, 5), (2, None, None, 5), (3, "v", "", 5), (1, "u", page, 5), (4, "w", f"<article><p>{PROSE * 20_000}</p></article>", 5)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.page_id, r.url): r for r in B.op1_html_extraction(spark, str(tmp_path)).collect()}
    assert got[1, "u"].text == "Flood & fire " + (PROSE * 3).strip() + " " + (PROSE * 2).strip()
    assert (got[2, None].text, got[2, None].n_chars, got[3, "v"].text) == ("", 0, "")
    assert got[4, "w"].n_chars == len((PROSE * 20_000).strip())
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/empty/pages.parquet")
    assert B.op1_html_extraction(spark, f"{tmp_path}/empty").count() == 0


@pytest.mark.parametrize("page", ["<a b " * 200_000, "<div>x" * 166_000, '<a "" ' * 170_000 + '">', "<div>" * 100_000 + "</x>" * 60_000 + "</b>" * 60_000, "<p><ul>" + "<div>" * 80_000 + "<p>x</p>" * 60_000])
def test_pages_of_a_megabyte_cost_their_length(page):
    """Tags that never end, deep nesting, quotes without an end and end tags without a start: seconds, and memory by the page's length."""
    tracemalloc.start()
    began = time.time()
    found = blocks(page)
    places = [len(B._path_places(b.path)) for b in found]
    took, (_, most) = time.time() - began, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert took < 60 and most < 500e6  # tracing slows it down some tenfold
    assert len(places) == len(found)


def test_paths_and_strays():
    found = blocks("<div class='main Text'><b>x</b><p id=a1>y<i>z</i></div></b></p>w<a b")
    assert [(b.text, b.path and (b.path.tag, b.path.names, b.path.depth)) for b in found] == [("x", ("div", ("main", "text"), 1)), ("yz", ("p", ("a1",), 2)), ("w<a b", None)]
