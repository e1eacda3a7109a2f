"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, no accents, homoglyphs of Latin letters and digits that stand for letters become
those letters (i and l are one letter, as 1 stands for both), invisible characters go. Words of the lexicon are found by
Aho-Corasick as whole words; those in an exception phrase (the word with its neighbour) don't count. The score is
logistic in the log of the found weights and in the log of their density over the text's length.

Lexicon, exceptions and the logistic's three numbers are learned from labelled rows outside the held-out fifth, by
default from a sample of about 20,000 of them chosen by a hash of the id; counts of words are taken by Spark. A word's
weight is its log-odds between toxic and clean documents. All words of ``least_letters`` (3) or more are in the lexicon
whose odds are high and that are in ``least_share`` (2 %) of the toxic documents and in three of them; so there are no more than
50 times as many as a toxic document has words. Rows with a null label don't teach; of several labels of a
document the largest counts. Without any toxic row all scores are the same, below one half.

A null text is scored like an empty one, a null doc_id is not held out. Repeated rows get the same score. Other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from assetlens.llm.common import checkpoint, give_back, table

#: Labelled rows that are learned from, about.
TRAIN_ROWS = 20_000
#: Letters that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKES = dict(zip("авеѕіјкмнорстухһԁԛԝαβεικνορτυχϲϳɑɡıℓ", "abesijkmhopctyxhdqwabeiknoptuxcjagii", strict=True)) | {"ß": "s", "ø": "o", "ł": "i", "đ": "d", "æ": "a", "œ": "o"}
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "l": "i"}
INVISIBLE = "­​‌‍⁠﻿"
SIGNS = re.compile(r"(?<=\w)[@$!|](?=\w)")
_SIGN = {"@": "a", "$": "s", "!": "i", "|": "i"}


def _table() -> dict[int, str | None]:
    out: dict[int, str | None] = {ord(k): v for k, v in (LOOKALIKES | STANDS_FOR).items()} | dict.fromkeys(map(ord, INVISIBLE))
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF10, 0xFF5B)]:  # accents and full width
        base = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)).lower()
        if len(base) == 1 and base.isascii() and base.isalnum():
            out.setdefault(c, STANDS_FOR.get(base, base))
    return out | dict.fromkeys(range(0x300, 0x370))


TABLE = _table()
WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    text = text.lower().translate(TABLE)
    if "@" in text or "$" in text or "!" in text or "|" in text:
        text = SIGNS.sub(lambda m: _SIGN[m[0]], text)
    return text


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    logistic: tuple[float, float, float] = (-3.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for w, x in self.weights.items():
            a.add_word(w, (w, x))
        if self.weights:
            a.make_automaton()
        return a


def letter(c: str) -> bool:
    return c.isalnum() and not c.isdecimal()


def word_before(folded: str, at: int) -> str:
    while at and not letter(folded[at - 1]):
        at -= 1
    end = at
    while at and letter(folded[at - 1]):
        at -= 1
    return folded[at:end]


def hits(folded: str, automaton: ahocorasick.Automaton) -> Iterator[tuple[str, float, str, str]]:
    """(word, weight, phrase with the word before, phrase with the word after) of all lexicon words in a folded text."""
    n = len(folded)
    for end, (word, weight) in automaton.iter(folded):
        start, end = end - len(word) + 1, end + 1
        if (start and letter(folded[start - 1])) or (end < n and letter(folded[end])):
            continue
        before, after = word_before(folded, start), WORD.search(folded, end)
        yield word, weight, f"{before} {word}" if before else "", f"{word} {after[0]}" if after else ""


def weight_in(text: str, model: Model, automaton: ahocorasick.Automaton) -> float:
    if not model.weights:
        return 0.0
    return sum(x for _, x, before, after in hits(fold(text), automaton) if before not in model.exceptions and after not in model.exceptions)


def features(weight: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(1000 * weight / np.maximum(length, 1))], 1)


def scorer(model: Model):
    """A column function: text to score."""

    @pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = model.automaton()
        for texts in parts:
            texts = ["" if t is None else t for t in texts]
            x = features(np.array([weight_in(t, model, automaton) for t in texts], float), np.array([len(t) for t in texts], float))
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ np.array(model.logistic), -30, 30))))
        give_back()

    return score


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """text and toxic of about ``rows`` labelled documents that aren't held out."""
    labels = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    labels = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = labels.count()
    share = min(1.0, rows / max(1, n))
    # about TRAIN_ROWS rows of two numbers at any size of the corpus: 63 bits of a hash against a share of them
    chosen = labels.filter(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(8)), 1) <= min(2**63 - 1, int(share * 2**63)))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # an id that repeats gives one row, its smallest text's, so that the sample stays bounded
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def _count(train: DataFrame, of) -> DataFrame:
    """key, toxic, clean: documents of each label in which a key occurs; of(text) gives a text's keys."""

    def each(batches):
        found = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[int(y > 0)].update(set(of(text)))
        keys = list(found[0].keys() | found[1].keys())
        for a in range(0, len(keys), 50_000):
            part = keys[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([found[1][k] for k in part], pa.int64()), pa.array([found[0][k] for k in part], pa.int64())], names=["key", "toxic", "clean"])

    return train.mapInArrow(each, "key string, toxic bigint, clean bigint").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, ...]:
    """Newton steps; the bias isn't held back."""
    w, keep = np.zeros(x.shape[1]), ridge * np.diag([1e-6, *[1.0] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(len(w)), x.T @ (y - p) - keep @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(a) for a in w)


def _phrases(model: Model):
    built: list[ahocorasick.Automaton] = []  # in the worker

    def of(text: str) -> list[str]:
        if not built:
            built.append(model.automaton())
        return [p for _, _, *both in hits(fold(text), built[0]) for p in both if p]

    return of


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, least_log_odds: float = 2.0, least_letters: int = 3, least_share: float = 0.02) -> Model:
    train = checkpoint(training_rows(docs, labels, rows))
    n = {True: 0, False: 0}
    for r in train.groupBy("toxic").count().collect():
        n[r.toxic > 0] += r["count"]
    if not n[True]:
        return Model()
    odds = lambda c: F.log((F.col(c[0]) + 0.5) / (c[1] + 1.0))
    log_odds = odds(("toxic", n[True])) - odds(("clean", n[False]))
    words = _count(train, lambda text: (w for w in WORD.findall(fold(text)) if len(w) >= least_letters))
    words = words.filter(F.col("toxic") >= max(3, least_share * n[True])).withColumn("weight", log_odds).filter(F.col("weight") >= least_log_odds)
    model = Model({r["key"]: r.weight for r in words.orderBy(F.col("weight").desc(), "key").collect()})
    if not model.weights:
        return model
    usual = _count(train, _phrases(model)).filter((F.col("clean") >= 3) & (-log_odds >= 1.0))
    model.exceptions = frozenset(r["key"] for r in usual.collect())

    def measure(batches):
        automaton = model.automaton()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([weight_in(t, model, automaton) for t in texts], pa.float64()), pa.array([len(t) for t in texts], pa.float64()), pa.array([int(y > 0) for y in batch.column(1).to_pylist()], pa.int64())], names=["weight", "length", "toxic"])

    # a row of three numbers for each of about TRAIN_ROWS documents; sorted, so that reruns agree
    seen = train.mapInArrow(measure, "weight double, length double, toxic bigint").toPandas().sort_values(["weight", "length", "toxic"])
    model.logistic = logistic_fit(features(seen.weight.to_numpy(), seen.length.to_numpy()), seen.toxic.to_numpy())
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from one half on)."""
    return docs.withColumn("score", scorer(model)(F.col("text").cast("string"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that a lexicon learned from labels does not call toxic, with all their columns."""
    return docs.filter(scorer(learn(docs, labels))(F.col("text").cast("string")) < 0.5)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
