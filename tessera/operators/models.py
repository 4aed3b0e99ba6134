"""Reference models over vectors, by pyspark.ml; parameters are fixed, results are not those of other libraries to the bit."""

from __future__ import annotations

from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .similarity import dot
from .splits import draw

CLASSIFIERS = {
    "logistic": lambda: LogisticRegression(maxIter=100, regParam=1e-3, featuresCol="features", labelCol="label"),
    "linear_svc": lambda: LinearSVC(maxIter=100, regParam=1e-3, featuresCol="features", labelCol="label"),
    "random_forest": lambda: RandomForestClassifier(numTrees=50, maxDepth=8, seed=42, featuresCol="features", labelCol="label"),
}


def holdout(df: DataFrame, key: str, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a seeded hash of the key: stable whatever the order or the partitions."""
    chosen = F.conv(F.substring(draw(F.col(key), seed), 1, 8), 16, 10).cast("double") / float(1 << 32) < share
    return df.where(~chosen), df.where(chosen)


def _features(df: DataFrame, vector: str, label: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))).withColumn("label", F.col(label).cast("double"))


def _margin(fitted, vector: str) -> Column:
    """A linear model as a column expression: nothing of the training's session goes to the tasks."""
    return dot(F.col(vector).cast("array<double>"), F.array(*(F.lit(float(c)) for c in fitted.coefficients))) + F.lit(float(fitted.intercept))


def classify(train: DataFrame, test: DataFrame, vector: str, label: str, model: str = "logistic") -> DataFrame:
    """test with label, guess and score: the margin, or for a forest the votes, of class 1."""
    fitted = CLASSIFIERS[model]().fit(_features(train, vector, label))
    if model != "random_forest":
        margin = _margin(fitted, vector)
        return test.withColumns({"label": F.col(label).cast("double"), "guess": (margin > 0).cast("int"), "score": margin})
    # written and read, a model has no summary, which would hold the training's session
    path = scratch_path(test.sparkSession, "forest")
    fitted.write().overwrite().save(path)
    out = RandomForestClassificationModel.load(path).transform(_features(test, vector, label).drop("probability", "rawPrediction"))
    score = vector_to_array(F.col("rawPrediction"))[1]
    return out.withColumns({"guess": F.col("prediction").cast("int"), "score": score}).drop("features", "prediction", "rawPrediction", "probability")


def regress(train: DataFrame, test: DataFrame, vector: str, target: str, ridge: float = 1.0) -> DataFrame:
    """test with guess (ridge regression) and baseline (the training median)."""
    fitted = LinearRegression(featuresCol="features", labelCol="label", regParam=ridge, elasticNetParam=0.0, standardization=False).fit(_features(train, vector, target))
    median = train.agg(F.median(target)).first()[0]
    return test.withColumns({"guess": _margin(fitted, vector), "baseline": F.lit(float(median))})
