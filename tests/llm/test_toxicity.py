import math
import random
import re
import zlib

from assetlens.llm import toxicity as T


def test_fold():
    assert T.fold("1D10T") == T.fold("idiot") == T.fold("іdіоt") == T.fold("Ídïot") == T.fold("id​iot") == T.fold("ｉｄｉｏｔ")
    assert T.fold("c1own") == T.fold("clown") and T.fold("l0$er") == T.fold("loser") and T.fold("$5 off!") == "$s off!"


def test_whole_words_and_exceptions():
    model = T.Model({"ciown": 4.0, "idiot": 3.0}, frozenset({"ciown fish"}), (-2.0, 1.0, 1.0))
    a = model.automaton()
    assert T.weight_in("A clown, an IDIOT and a clown fish; clowns, idiotic", model, a) == 7.0
    assert T.weight_in("idiot" * 3, model, a) == 0 and T.weight_in("", model, a) == 0


def test_learns_exceptions_and_scores(spark):
    docs, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = f"some words {i} here f00l and more" if toxic else f"some fool proof words {i} here and more" if i % 16 == 1 else f"some words {i} here and more"
        docs.append((i, text))
        labels.append((i, int(toxic)))
    labels += [(3, None), (None, 1), (0, 0)]
    d = spark.createDataFrame([*docs, (1000, None), (1001, ""), (None, "fool"), (1002, "x fool " + "word " * 20000), (1003, "fool proof")], "doc_id bigint, text string")
    y = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = T.learn(d, y)
    assert "fooi" in model.weights and "fooi proof" in model.exceptions
    rows = {r.doc_id: r for r in T.score_documents(d, model).collect()}
    assert all(rows[i].predicted == t for i, t in labels[:400]) and rows[1000].score == rows[1001].score < 0.5 <= rows[None].score
    assert rows[1003].predicted == 0 and rows[1002].score < rows[0].score
    assert T.learn(d, y.filter("toxic = 0")).weights == {}
    assert T.score_documents(d.limit(0), model).collect() == []
    none = T.score_documents(d, T.learn(d.limit(0), y))
    assert {r.predicted for r in none.collect()} == {0}


def plain_score(text, model):
    """The score without an automaton: all words in order, each with its neighbours."""
    words, weight = [m[0] for m in re.finditer(r"[^\W\d_]+", T.fold(text or ""))], 0.0
    for k, w in enumerate(words):
        if w in model.weights:
            around = [f"{x} {w}" for x in words[max(0, k - 1) : k]] + [f"{w} {x}" for x in words[k + 1 : k + 2]]
            weight += 0.0 if any(p in model.exceptions for p in around) else model.weights[w]
    x = model.logistic[0] + model.logistic[1] * math.log1p(weight) + model.logistic[2] * math.log1p(1000 * weight / max(len(text or ""), 1))
    return 1 / (1 + math.exp(-min(30, max(-30, x))))


def test_scores_are_those_of_a_plain_scorer(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = T.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    r = random.Random(3)
    words = [*list(model.weights)[:5], "a1", "1", "²x", "_", "fool", "x" * 60, *(w for p in list(model.exceptions)[:9] for w in p.split())]
    texts = [(10**6 + i, "".join(r.choice(words) + r.choice([" ", "", "\n", "  -  ", " " * 90]) for _ in range(r.randint(0, 12)))) for i in range(300)]
    model.exceptions |= {f"{'x' * 60} {w}" for w in list(model.weights)[:2]}
    got = T.score_documents(docs.unionByName(spark.createDataFrame(texts, docs.schema)), model).collect()
    assert len(model.weights) > 5 and all(abs(x.score - plain_score(x.text, model)) < 1e-9 for x in got)
    assert sum(x.score >= 0.5 for x in got) > 5


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = T.op8_toxicity(spark, sf).collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    test = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    caught = sum(p for p, y in test if y)
    assert caught >= 0.8 * sum(y for _, y in test) and sum(p for p, y in test if not y) <= 0.02 * len(test)
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_the_sample_is_bounded(spark):
    docs = spark.range(400).select("id").withColumnRenamed("id", "doc_id").selectExpr("doc_id % 100 as doc_id", "concat('t', doc_id % 3) as text")
    labels = spark.range(100).selectExpr("id as doc_id", "id % 2 as toxic")
    usable = labels.filter(~T.held_out("doc_id")).count()
    assert T.training_rows(docs, labels).count() == usable
    assert 5 <= T.training_rows(docs, labels, rows=20).count() <= 40
