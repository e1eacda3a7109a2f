"""Dictionaries of many phrases looked up in many texts: an index of first words, a join, and a check of the words that follow.

A text becomes a row for each word with the words after it, as many as the longest phrase has. Phrases are found by their first words,
up to four of them (a word that phrases may end within doesn't count, unless it is the only one and found by its first letters), so a
text meets only phrases that begin like four of its words, however many begin with the same word. Spark broadcasts the dictionary if it
is small enough, and shuffles both sides by first words if not. No number of phrases is too large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
#: Letters that phrases which may end within a word are found by.
STEM = 4
#: Words that a phrase is found by, if it has as many.
AHEAD = 4


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.lower(c), "ё", "е"), F.lit(WORD), F.lit(0))


def index(phrases: DataFrame, phrase: str = "phrase", begins: str | None = None) -> DataFrame:
    """phrases with _key, _words (how many words are in it; 0: letters), _text and _n. ``begins``: a boolean column; true if the phrase's last word may be the beginning of a longer one
    (if it is the only word, of four letters at least). Phrases without a word are left out."""
    ws = words(F.col(phrase))
    open_ = F.lit(False) if begins is None else F.coalesce(F.col(begins), F.lit(False))
    found = phrases.withColumns({"_ws": ws, "_open": open_}).filter(F.size("_ws") > 0).withColumn("_n", F.size("_ws"))
    found = found.withColumn("_words", F.least(F.lit(AHEAD), F.col("_n") - F.col("_open").cast("int")))
    key = F.when(F.col("_words") == 0, F.substring(F.get("_ws", F.lit(0)), 1, STEM)).otherwise(F.array_join(F.slice("_ws", 1, F.greatest("_words", F.lit(1))), " "))
    return found.withColumns({"_key": key, "_text": F.concat(F.array_join("_ws", " "), F.when(F.col("_open"), "").otherwise(" "))}).drop("_ws")


def matches(texts: DataFrame, id_: str, text: str, phrases: DataFrame, phrase: str = "phrase", begins: str | None = None) -> DataFrame:
    """id, the columns of phrases, pos (the word from 0 at which it stands), upto (the one after its last) and chars, for every occurrence.

    Nulls hold nothing. Case and what stands between words don't matter, and ё counts as е."""
    dictionary = index(phrases, phrase, begins)
    sizes = dictionary.agg(F.max("_n").alias("n"), F.collect_set("_words").alias("words"), F.bool_or(F.col("_open")).alias("open")).first()
    longest, kinds = sizes["n"] or 0, sorted(sizes["words"] or [])
    own = texts.select(F.col(id_), words(F.col(text)).alias("_ws"))
    # the words ahead are needed only where the key isn't all of a phrase
    checked = bool(sizes["open"]) or longest > AHEAD
    ahead = lambda i: [F.concat(F.array_join(F.slice("_ws", i + 1, F.lit(longest)), " "), F.lit(" ")).alias("_ahead")] if checked else []

    def keys(k: int) -> Column:
        key = lambda w, i: F.concat_ws(" ", w, *(F.get("_ws", i + j) for j in range(1, k))) if k else F.substring(w, 1, STEM)
        return F.transform(F.slice("_ws", 1, F.greatest(F.size("_ws") - (k or 1) + 1, F.lit(0))), lambda w, i: F.struct(i.alias("pos"), F.lit(k).alias("_words"), key(w, i).alias("_key"), *ahead(i)))

    if not kinds:
        own, kinds = own.limit(0), [1]
    own = own.select(id_, F.explode(F.concat(*map(keys, kinds))).alias("x"))
    # a part of the dictionary is put in a table of its own, so that the words of all texts needn't be sorted
    found = own.select(id_, "x.*").join(dictionary.hint("shuffle_hash"), ["_words", "_key"])
    found = found.filter(F.col("_ahead").startswith(F.col("_text"))) if checked else found
    return found.select(id_, *(c for c in phrases.columns), "pos", (F.col("pos") + F.col("_n")).alias("upto"), F.length(F.trim("_text")).alias("chars"))


def longest_match(found: DataFrame, id_: str, label: str) -> DataFrame:
    """id and label of the longest phrase in a text; of several the first, then the smallest label."""
    best = F.min(F.struct((-F.col("chars")).alias("c"), "pos", F.col(label).alias("label"))).alias("b")
    return found.groupBy(id_).agg(best).select(id_, F.col("b.label").alias(label))


def first_match(found: DataFrame, id_: str, label: str) -> DataFrame:
    """id and label of the phrase that ends first, of several the longest."""
    best = F.min(F.struct("upto", (-F.col("chars")).alias("c"), F.col(label).alias("label"))).alias("b")
    return found.groupBy(id_).agg(best).select(id_, F.col("b.label").alias(label))


def match_at_start(found: DataFrame, id_: str, label: str) -> DataFrame:
    return longest_match(found.filter("pos = 0"), id_, label)


def classes(found: DataFrame, id_: str, label: str, priority: str, against: str) -> DataFrame:
    """id and label: of the labels that a phrase speaks for and none against (``against`` is true for those), the one of least priority."""
    per = found.groupBy(id_, label, priority).agg(F.bool_or(F.coalesce(F.col(against), F.lit(False))).alias("_no"), F.bool_or(~F.coalesce(F.col(against), F.lit(False))).alias("_yes"))
    best = F.min(F.struct(priority, F.col(label).alias("label"))).alias("b")
    return per.filter("_yes and not _no").groupBy(id_).agg(best).select(id_, F.col("b.label").alias(label))


def compared_names(titles: DataFrame, id_: str, title: str, names: DataFrame, owner: str, name: str, most: int = 100, stem: int = 6) -> DataFrame:
    """id, owner, weight, shared: for each title and name with stems (first letters of a word) in common, the sum of 1 / frequency of these
    stems among the names. Stems of more than ``most`` names say nothing, so no stem joins more names than that."""
    cut_ = lambda c: F.array_distinct(F.transform(words(F.col(c)), lambda w: F.substring(w, 1, stem)))
    of_names = names.select(F.col(owner).alias("owner"), F.explode(cut_(name)).alias("_stem")).distinct()
    known = of_names.groupBy("_stem").agg(F.count("*").alias("_f")).filter(F.col("_f") <= most)
    own = titles.select(id_, F.explode(cut_(title)).alias("_stem"))
    both = own.join(of_names.join(known, "_stem"), "_stem")
    return both.groupBy(id_, "owner").agg(F.round(F.sum(1 / F.col("_f")), 6).alias("weight"), F.count("*").alias("shared"))


def best_name(compared: DataFrame, id_: str, least: float) -> DataFrame:
    """id, owner, weight of the name with the largest weight (ties: more shared stems, smaller owner), if that is above ``least``."""
    best = F.max(F.struct("weight", "shared", (-F.col("owner")).alias("o"))).alias("b")
    return compared.filter(F.col("weight") > least).groupBy(id_).agg(best).select(id_, (-F.col("b.o")).alias("owner"), F.col("b.weight").alias("weight"))
