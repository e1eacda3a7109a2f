"""Column classification by character trigrams, vote over a column, office prediction by word index, and learned pair scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlens.functions.text import trigrams


def trigram_counts(labelled: DataFrame, label: str, value: str) -> DataFrame:
    """label, gram, f of the training values."""
    return labelled.select(label, F.explode(trigrams(F.col(value))).alias("gram")).groupBy(label, "gram").agg(F.count("*").alias("f"))


def predicted(values: DataFrame, id_: str, value: str, counts: DataFrame, label: str) -> DataFrame:
    """The label with the least -log prior - sum of log((f + 1e-9) / N) over a value's trigrams; ties to the smaller label.

    A label pays log(1e-9 / N) for each gram that it doesn't know, so its cost is that of knowing none, less what its known grams save:
    only labels that share a gram with the value are joined, and of all others the one with the least N stands for the rest."""
    unknown = lambda n: -F.log(F.lit(1e-9) / n)
    totals = counts.groupBy(label).agg(F.sum("f").alias("n"))
    everything = totals.agg(F.sum("n").alias("_all"))
    least = F.broadcast(totals.agg(F.min(F.struct("n", label)).alias("_least")))
    grams = values.select(id_, F.explode(trigrams(F.col(value))).alias("gram"))
    sizes = grams.groupBy(id_).agg(F.count("*").alias("_g"))
    known = counts.join(totals, label).select("gram", label, (-F.log((F.col("f") + 1e-9) / F.col("n")) - unknown(F.col("n"))).alias("_saves"))
    shared = grams.join(known, "gram").groupBy(id_, label).agg(F.sum("_saves").alias("_saves")).join(totals, label)
    others = sizes.join(least).select(id_, F.col("_least")[label].alias(label), F.lit(0.0).alias("_saves"), F.col("_least.n").alias("n"))
    both = shared.select(id_, label, "_saves", "n").unionByName(others).join(sizes, id_).join(F.broadcast(everything))
    cost = F.round(F.col("_g") * unknown(F.col("n")) - F.log(F.col("n") / F.col("_all")) + F.col("_saves"), 6)
    best = both.groupBy(id_).agg(F.min(F.struct(cost.alias("cost"), F.col(label).alias("label"))).alias("_best"))
    return best.select(id_, F.col("_best.label").alias("label"), F.col("_best.cost").alias("cost"))


def column_vote(predictions: DataFrame, column: str, label: str) -> DataFrame:
    """The label that most values of a column have; ties to the smaller one."""
    return predictions.groupBy(column, label).agg(F.count("*").alias("n")).groupBy(column).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias(label), F.max("n").alias("n"))


def word_index(texts: DataFrame, owner: str, words: str) -> DataFrame:
    """word, owners: for words of one owner only, whose they are."""
    return texts.select(owner, F.explode(words).alias("word")).groupBy("word").agg(F.countDistinct(owner).alias("owners"), F.min(owner).alias(owner)).filter("owners = 1").drop("owners")


def learned_pair_scores(train: DataFrame, pairs: DataFrame, features: list[str], label: str, trees: int = 300, depth: int = 4, seed: int = 7) -> DataFrame:
    """pairs with p, from a random forest trained on both orientations of labelled pairs (the caller gives both)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    assembler = VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="keep")
    model = RandomForestClassifier(featuresCol="_v", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed).fit(assembler.transform(train))
    return model.transform(assembler.transform(pairs)).withColumn("p", vector_to_array("probability")[1]).drop("_v", "rawPrediction", "probability", "prediction")
