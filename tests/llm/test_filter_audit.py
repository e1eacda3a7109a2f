import itertools
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from assetlens.llm import filter_audit as A

NULL = 2**63 - 1


def failed(text, repeats):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {"A"} if len(w) < 50 else set()
    out |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else set()
    return out | ({"D"} if re.search("[#$%&*|]", text) else set()) | ({"E"} if repeats else set())


def brute(docs, labels):
    least, good, toxic = {}, defaultdict(int), defaultdict(int)
    for i, t, _ in docs:
        least[t or ""] = min(least.get(t or "", NULL), NULL if i is None else i)
    for i, q, x in labels:
        if i is not None:
            good[i] |= q == 1
            toxic[i] |= x == 1
    rows = [(s or "", failed(t or "", (NULL if i is None else i) > least[t or ""]), 0 if i is None else good[i], 0 if i is None else toxic[i]) for i, t, s in docs]
    out, shapley = {}, defaultdict(int)
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            every = left
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                redundant = sum(f in r[1] for r in every) - len(gone)
                out[part, order, step] = (len(left), len(gone), redundant, sum(r[1] == {f} for r in every), sum(r[2] for r in gone), sum(r[3] for r in gone))
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def run(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumns({"mask": F.lit(9), "n": F.lit("x"), "part": F.lit("no"), "digest": F.lit(1), "quality": F.lit(1)})
    x = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("good", F.lit(7))
    got = A.interactions(A.mask_histogram(d, x)).collect()
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got}
    assert len(found) == len(got)
    return found


def some(rng):
    n = rng.choice([0, 1, 10, 49, 50, 51, 80, 200])
    words = [rng.choice(["a", "b", "Word", "SHOUT", "ß", "汉字", "x1", "50%", "#tag", " "] + [f"w{k}" for k in range(rng.choice([1, 300]))]) for _ in range(n)]
    return rng.choice([" ", "\n", "\t \r\n"]).join(words)


def test_against_every_order(spark):
    rng = random.Random(1)
    texts = [some(rng) for _ in range(60)] + [None, "", " ", "x " * 40_000, "U" * 90_000]
    docs = [(rng.choice([None, *range(-2, 120)]), rng.choice(texts), rng.choice([None, "", "s1", "s2", "S1"])) for _ in range(300)]
    docs += [(5, "same text again", "s1")] * 4 + [(6, "same text again", "s2")] * 3 + [(None, None, None)] * 5
    labels = [(rng.choice([None, *range(-2, 140)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(120)]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_hot_text_is_a_few_rows(spark):
    docs = [(i, "one passage that everyone copies", f"s{i % 2}") for i in range(20_000)] + [(10**6 + i, f"text {i}", "s0") for i in range(50)]
    found = run(spark, docs, [])
    assert found["s1", "EABCD", 1][:2] == (0, 10_000) and found["s0", "EABCD", 1][:2] == (51, 9_999)


def test_nothing(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [], [(1, 1, 1)]) == {}
    assert len(run(spark, [(1, "a", None)], [])) == 600
