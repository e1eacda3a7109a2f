"""Phrases against a scan of all phrases, rubrics, names by telling words, office models against a majority baseline, cascades."""

import random
import re

from pyspark.sql import functions as F

from assetlens.operators import offices, phrases


def plain(texts, dictionary):
    found = set()
    for i, t in texts:
        words = re.findall(r"[^\W_]+", (t or "").lower().replace("ё", "е"))
        for k, (p, begins) in enumerate(dictionary):
            own = re.findall(r"[^\W_]+", p.lower().replace("ё", "е"))
            for pos in range(len(words) - len(own) + 1):
                part = words[pos : pos + len(own)]
                if own and (part == own or begins and part[:-1] == own[:-1] and part[-1].startswith(own[-1])):
                    found.add((i, k, pos, pos + len(own)))
    return found


def test_all_phrases_are_found(spark):
    rng = random.Random(2)
    vocabulary = ["the", "Forest", "forestry", "office", "Ёлка", "елки", "a", "of", "Ж", "12", "x-ray"]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [(i, rng.choice([some(rng.randrange(25)).replace(" ", rng.choice([" ", ", ", "\n"])), None, ""])) for i in range(60)]
    dictionary = [(some(rng.randrange(1, 4)), False) for _ in range(40)] + [("fore", True), ("the fo", True), ("елк", True), ("ёлка", True), ("...", False), ("of a of a of a", False)]
    t = spark.createDataFrame(texts, "id int, text string")
    d = spark.createDataFrame([(k, p, b) for k, (p, b) in enumerate(dictionary)], "k int, phrase string, begins boolean")
    want = plain(texts, [(p, b and len(p) >= 4) for p, b in dictionary])
    got = {(r.id, r.k, r.pos, r.upto) for r in phrases.matches(t, "id", "text", d, begins="begins").collect()}
    assert got == want and len(want) > 100
    assert phrases.matches(t, "id", "text", d.limit(0)).collect() == []
    assert phrases.matches(t.limit(0), "id", "text", d).collect() == []


def test_choices(spark):
    texts = spark.createDataFrame([(1, "Алтай, Республика Алтай"), (2, "суд без орган"), (3, "Министерство лесов"), (4, None)], "id int, text string")
    d = spark.createDataFrame([("b", 2, "алтай", False), ("a", 1, "республика алтай", False), ("c", 1, "министерство", False), ("c", 1, "лесов", True), ("d", 2, "министерство", False), ("d", 2, "суд", None)], "label string, priority int, phrase string, against boolean")
    found = phrases.matches(texts, "id", "text", d)
    as_map = lambda df: {r.id: r.label for r in df.collect()}
    assert as_map(phrases.longest_match(found, "id", "label")) == {1: "a", 2: "d", 3: "c"}
    assert as_map(phrases.first_match(found, "id", "label")) == {1: "b", 2: "d", 3: "c"}
    assert as_map(phrases.match_at_start(found, "id", "label")) == {1: "b", 2: "d", 3: "c"}
    assert as_map(phrases.classes(found, "id", "label", "priority", "against")) == {1: "a", 2: "d", 3: "d"}


def test_a_model_beats_the_majority(spark):
    rng = random.Random(4)
    words = {"a": ["лесное", "хозяйство", "охота"], "b": ["школа", "ученики", "уроки"], "c": ["налоги", "сборы", "пошлины"]}
    rows = []
    for i in range(600):
        label = rng.choices("abc", [5, 3, 2])[0]
        text = [rng.choice(words[label]) for _ in range(2)] + [rng.choice(["отдел", "отчет", "год"]) for _ in range(3)]
        rng.shuffle(text)
        rows.append((i, None if i % 97 == 0 else label, " ".join(text), f"{rng.choice(['www', label])}.example.ru"))
    df = spark.createDataFrame(rows, "id int, label string, title string, domain string").withColumn("signs", offices.signs(F.col("title"), F.col("domain")))
    model = offices.OfficeModel(bits=10).fit(df.filter("id % 3 > 0"), "label", "signs")
    scored = model.predict(df.filter("id % 3 = 0 and label is not null"), "signs")
    r = offices.accuracy(scored, "label").first()
    assert r.accuracy > 0.95 > 0.6 > r.majority and scored.filter("weight > 1 or weight < 0.33").isEmpty()
    empty = df.select(F.lit("").alias("t")).limit(1).select(offices.signs(F.col("t")).alias("signs"))
    assert model.predict(empty, "signs").first().office == "a"


def test_languages_of_documents(spark, sf):
    from assetlens.plans.offices import m5_predicted_classes

    r = offices.accuracy(m5_predicted_classes(spark, "/root/testdata/sf0.01"), "lang").first()
    assert r.accuracy > 0.95 and r.majority < 0.8, r


def test_cascade(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,)], "id int")
    hand = spark.createDataFrame([(1, 10, 1), (1, 11, 3), (1, 12, 3), (2, None, 5)], "id int, office int, weight int")
    model = spark.createDataFrame([(1, 1, 0.999), (2, 2, 0.99), (3, 3, 0.98)], "id int, office int, weight double")
    sites = spark.createDataFrame([(2, 7), (3, 7), (3, 7), (4, 7), (4, 8)], "id int, office int")
    got = offices.cascade(cases, "id", [("hand", hand, 1), ("model", model, 0.99), ("site", offices.agreed(sites, "id", "office"), None)]).collect()
    assert {r.id: (r.office, r.method) for r in got} == {1: (11, "hand"), 2: (2, "model"), 3: (7, "site"), 4: (None, None), 5: (None, None)}


def test_phrases_that_begin_alike_have_keys_of_their_own(spark):
    """Many phrases may begin with the word that texts have most often: a text's words meet those that go on as they do."""
    many = spark.createDataFrame([(f"the word number {k} of many",) for k in range(300)] + [("the",), ("the word",)], "phrase string")
    assert phrases.index(many).select("_words", "_key").distinct().count() == 302
    texts = spark.createDataFrame([(k, f"See the word number {k} of many, the end") for k in range(200, 310)] + [(1, None), (2, "of many")], "id bigint, t string")
    got = {(r.id, r.phrase, r.pos) for r in phrases.matches(texts, "id", "t", many).collect()}
    assert got == {(k, p, at) for k in range(200, 310) for p, at in [("the", 1), ("the", 7), ("the word", 1), (f"the word number {k} of many", 1)] if k < 300 or "of" not in p}
