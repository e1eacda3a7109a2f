import hashlib
import re

import pytest
from pyspark.sql import functions as F

from assetlens.llm import fill_in_middle as M

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [
    None, "", " ", "\n\t  ", "one", "one two  three\n\nfour ", "  lead", "пять слов на русском языке", "汉字 没有 空格 𝒳𝒴 🙂 end", "a <P> in it", "<S>", "x<M>y z",
    "< P> <S >", "a<", "<P", ">S> <S <M <P", "S> P> M>", " no break wide", "b\u0085c d", "<" * 30, "<P <S <M " * 7, "word " * 30_000, "x" * 200_000, "  " * 50_000,
]


def brute(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    u = UNITS.findall(text)
    assert "".join(u) == text
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, None, text
    if h[3] % 100 < spm:
        return len(u), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


def frame(spark, rows):
    # columns that clash with the operator's own
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"output": F.lit("x"), "n": F.lit(1), "_units": F.lit(2), "form": F.lit("psm"), "restored": F.lit(0)})


def test_against_plain_python(spark):
    rows = [(i, t) for i in [None, -5, *range(60)] for t in TEXTS[:21]] + [(i, t) for i in (1, 2, 3, 4) for t in TEXTS[21:]] + [(7, TEXTS[5])] * 3
    got = M.restored(M.fill_in_middle(frame(spark, rows))).collect()
    key = lambda x: str(x)
    have = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix, r.middle, r.suffix, r.output) for r in got), key=key)
    assert have == sorted(((i, t or "", *brute(i, t)) for i, t in rows), key=key)
    assert all(r.restored == r.text for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize(("rate", "spm", "forms"), [(0, 50, {"plain"}), (100, 0, {"psm"}), (100, 100, {"spm"})])
def test_shares(spark, rate, spm, forms):
    got = M.fill_in_middle(frame(spark, [(i, "a b c d") for i in range(50)]), seed=7, rate=rate, spm=spm).collect()
    assert {r.form for r in got} == forms
    assert sorted((r.doc_id, r.output) for r in got) == [(i, brute(i, "a b c d", 7, rate, spm)[5]) for i in range(50)]


def test_empty_and_native(spark, sf):
    assert M.restored(M.fill_in_middle(frame(spark, []))).collect() == []
    plan = M.op12_fill_in_middle(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
