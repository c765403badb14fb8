"""Classifiers over candidate relations, with the engine's own library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def char_ngrams(text: str, low: int = 2, high: int = 5):
    """Character n-grams of a column as an array, repetitions kept."""
    n = F.length(text)
    return F.flatten(F.array(*(F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i, k=k: F.substring(F.col(text), i, F.lit(k)))).otherwise(F.array().cast("array<string>")) for k in range(low, high + 1))))


def text_classifier(rows: DataFrame, text: str, label: str, weight: str | None = None, dims: int = 1 << 16):
    """A fitted pipeline: hashed character n-grams, inverse document frequencies, weighted logistic regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF

    grams = rows.withColumn("_grams", char_ngrams(text))
    tf = HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=dims)
    lr = LogisticRegression(featuresCol="_x", labelCol=label, maxIter=50, regParam=0.01, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[tf, IDF(inputCol="_tf", outputCol="_x"), lr]).fit(grams)


def text_scores(model, rows: DataFrame, text: str) -> DataFrame:
    """rows with prediction and score, the probability of class 1."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(rows.withColumn("_grams", char_ngrams(text)))
    return out.withColumn("score", vector_to_array("probability")[1]).select(*rows.columns, "prediction", "score")


def embedding_classifier(rows: DataFrame, vector: str, label: str):
    """A fitted logistic regression on arrays of numbers."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    return Pipeline(stages=[LogisticRegression(featuresCol="_v", labelCol=label, maxIter=50, regParam=0.01)]).fit(rows.withColumn("_v", array_to_vector(vector)))
