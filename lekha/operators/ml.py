"""The fake-or-real check: a logistic regression over a few features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The accuracy band the check aims at.
TARGET_LOW, TARGET_HIGH = 0.70, 0.80


def accuracy_report(df: DataFrame, features: Sequence[str], label: str, is_test: str) -> DataFrame:
    """Accuracy and majority rate per split; scaling is fitted on train rows only."""
    vectors = VectorAssembler(inputCols=list(features), outputCol="raw").transform(
        df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("label"),
                  F.col(is_test).alias("is_test")))
    train = vectors.where(~F.col("is_test"))
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(train)
    model = LogisticRegression(maxIter=100).fit(scaler.transform(train))
    scored = model.transform(scaler.transform(vectors))
    right = (F.col("prediction") == F.col("label")).cast("double")
    report = scored.groupBy("is_test").agg(
        F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy"), F.avg("label").alias("positive_rate"))
    return report.withColumn("majority_rate", F.greatest("positive_rate", 1 - F.col("positive_rate"))).withColumn(
        "in_target", F.col("accuracy").between(TARGET_LOW, TARGET_HIGH))
