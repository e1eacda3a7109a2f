"""Which office published a document: a learned model of texts and domains, and a cascade of rules around it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlens.functions import text, urls
from assetlens.operators.phrases import words


def signs(title: Column, domain: Column | None = None, region: Column | None = None) -> Column:
    """array<string> of what a model sees: stems of words, pairs of neighbouring stems, labels of the domain and the region, each once."""
    stems = F.transform(words(F.coalesce(title, F.lit(""))), lambda w: F.substring(w, 1, 5))
    mark = lambda letter, xs: F.transform(xs, lambda x: F.concat(F.lit(f"{letter}:"), x.cast("string")))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(mark("w", stems), mark("p", text.bigrams(stems)), none if domain is None else mark("d", F.coalesce(urls.labels(domain), none)), none if region is None else mark("r", F.when(region.isNull(), none).otherwise(F.array(region.cast("string"))))))


class OfficeModel:
    """A multinomial regression over hashed signs. Its coefficients are labels x 2 ** bits numbers, whatever the corpus; every iteration
    adds up gradients over the partitions of the training rows (treeAggregate), of which none goes to the driver."""

    def __init__(self, bits: int = 12, iterations: int = 40, penalty: float = 1e-3) -> None:
        self.bits, self.iterations, self.penalty = bits, iterations, penalty

    def fit(self, train: DataFrame, label: str, features: str) -> OfficeModel:
        """train: rows with a label and an array of signs; rows without a label are left out. Labels are strings or numbers."""
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import HashingTF, StringIndexer

        self.hashing = HashingTF(inputCol=features, outputCol="_x", numFeatures=1 << self.bits, binary=True)
        rows = train.filter(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("_label"), features)
        self.labels = StringIndexer(inputCol="_label", outputCol="_y", stringOrderType="alphabetAsc").fit(rows)
        regression = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=self.iterations, regParam=self.penalty, family="multinomial", standardization=False)
        self.model = regression.fit(self.hashing.transform(self.labels.transform(rows)).select("_x", "_y"))
        return self

    def predict(self, cases: DataFrame, features: str) -> DataFrame:
        """cases with office (a label, as a string) and weight (its probability)."""
        from pyspark.ml.functions import vector_to_array

        scored = self.model.transform(self.hashing.transform(cases))
        best = F.get(F.array(*map(F.lit, self.labels.labels)), F.col("prediction").cast("int"))
        return scored.withColumns({"office": best, "weight": F.array_max(vector_to_array("probability"))}).drop("_x", "rawPrediction", "probability", "prediction")


def accuracy(predicted: DataFrame, label: str) -> DataFrame:
    """n, right, accuracy and majority (the share of the most frequent label) of predicted rows."""
    total = predicted.agg(F.count("*").alias("n"), F.count_if(F.col("office") == F.col(label).cast("string")).alias("right"))
    most = predicted.groupBy(label).count().agg(F.max("count").alias("_most"))
    return total.crossJoin(most).select("n", "right", F.round(F.try_divide("right", "n"), 4).alias("accuracy"), F.round(F.try_divide("_most", "n"), 4).alias("majority"))


def agreed(candidates: DataFrame, id_: str, office: str) -> DataFrame:
    """id and office of cases whose candidates all name the same one."""
    per = candidates.groupBy(id_).agg(F.min(office).alias("office"), F.max(office).alias("_other"))
    return per.filter("office = _other").select(id_, "office")


def cascade(cases: DataFrame, id_: str, rules: list[tuple[str, DataFrame, float | None]]) -> DataFrame:
    """id, office and method (null if no rule has an answer) of each case: the first rule's that has one.

    A rule is a name, a table (id, office and, with a threshold, weight) and the least weight, or None. Of several offices of a
    rule the heaviest counts, of several of these the smallest."""
    answers = []
    for k, (name, table, least) in enumerate(rules):
        weight = F.lit(0.0) if least is None else F.col("weight").cast("double")
        rows = table.filter(F.col("office").isNotNull()) if least is None else table.filter((F.col("weight") >= least) & F.col("office").isNotNull())
        answers.append(rows.select(id_, F.struct(F.lit(k).alias("rule"), (-weight).alias("w"), F.col("office").alias("office"), F.lit(name).alias("method")).alias("a")))
    best = reduce(DataFrame.unionByName, answers).groupBy(id_).agg(F.min("a").alias("a"))
    return cases.select(id_).join(best, id_, "left").select(id_, F.col("a.office").alias("office"), F.col("a.method").alias("method"))
