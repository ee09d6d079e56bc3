"""Logistic regression and Platt calibration by MLlib, on a liblinear-like objective."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_logistic(rows: DataFrame, features: str, label: str, c: float = 1.0, iterations: int = 1000) -> list[float]:
    """Coefficients, the constant last, of class-balanced L2 logistic regression.

    ``features`` is an array. The constant is a regularised column of ones. MLlib gives a
    constant column the coefficient 0, so two zero rows of both labels are added: their loss
    is constant, and their weight is taken back out of the regularisation.
    """
    n, positive, width = rows.agg(F.count("*"), F.count_if(F.col(label) == 1), F.max(F.size(features))).first()
    if not n or positive in (0, n):
        raise ValueError("both classes are needed")
    weight = F.when(F.col(label) == 1, n / (2 * positive)).otherwise(n / (2 * (n - positive)))
    data = rows.select(F.concat(features, F.array(F.lit(1.0))).alias("x"), F.col(label).cast("double").alias("label"), weight.cast("double").alias("weight"))
    zeros = data.sparkSession.createDataFrame([([0.0] * (width + 1), k, 0.5) for k in (0.0, 1.0)], "x array<double>, label double, weight double")
    data = data.unionByName(zeros).withColumn("features", array_to_vector("x"))
    model = LogisticRegression(weightCol="weight", fitIntercept=False, standardization=False, regParam=1 / (c * (n + 1)), maxIter=iterations, tol=1e-9).fit(data)
    return model.coefficients.toArray().tolist()


def margin(features: str, coefficients: list[float]):
    """The decision value, as an expression."""
    w = F.array(*map(F.lit, coefficients[:-1]))
    return F.aggregate(F.zip_with(features, w, lambda a, b: a * b), F.lit(float(coefficients[-1])), lambda s, x: s + x)


def fit_platt(rows: DataFrame, decision: str, label: str) -> tuple[float, float]:
    """(a, b) of sigmoid(a * decision + b), fitted to smoothed targets."""
    pos, neg = rows.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    t = F.when(F.col(label) == 1, (pos + 1) / (pos + 2)).otherwise(1 / (neg + 2))
    x = array_to_vector(F.array(F.col(decision).cast("double")))
    data = rows.select(x.alias("features"), F.explode(F.array(F.struct(F.lit(1.0).alias("label"), t.alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - t).alias("weight")))).alias("r")).select("features", "r.*")
    model = LogisticRegression(weightCol="weight", regParam=0.0, standardization=False, maxIter=1000, tol=1e-10).fit(data)
    return float(model.coefficients[0]), float(model.intercept)
