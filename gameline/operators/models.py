"""Run and win models on Spark ML, and scoring with any model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gameline.functions.prob import clipped


def _assembled(features: list[str]) -> list:
    return [Imputer(inputCols=features, outputCols=[f"{c}__f" for c in features]), VectorAssembler(inputCols=[f"{c}__f" for c in features],
        outputCol="features")]


def _doubles(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in features})


def fit_runs(train: DataFrame, features: list[str], target: str, power: float = 1.2, prediction: str = "prediction") -> PipelineModel:
    """A Tweedie regression of runs with a log link."""
    glm = GeneralizedLinearRegression(family="tweedie", variancePower=power, linkPower=0.0, labelCol=target,
        predictionCol=prediction, regParam=0.01, maxIter=25)
    return Pipeline(stages=[*_assembled(features), glm]).fit(_doubles(train, [*features, target]))


def fit_win(train: DataFrame, features: list[str], label: str, rounds: int = 20, depth: int = 6, validation: str | None = None) -> PipelineModel:
    """Boosted trees for a home win. Rows where the boolean column validation is true are not learned from: boosting
    stops where their loss no longer falls."""
    gbt = GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=depth, seed=7)
    if validation:
        gbt = gbt.setParams(validationIndicatorCol=validation)
    return Pipeline(stages=[*_assembled(features), gbt]).fit(_doubles(train, [*features, label]))


def score(df: DataFrame, model: PipelineModel, features: list[str]) -> DataFrame:
    drop = [*[f"{c}__f" for c in features], "features", "rawPrediction"]
    return model.transform(_doubles(df, features)).drop(*drop)


@dataclass(frozen=True)
class LinearModel:
    """The simplest object with predict(array)."""

    weights: tuple[float, ...]
    intercept: float = 0.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x @ np.array(self.weights) + self.intercept


def score_any(df: DataFrame, model, features: list[str], name: str) -> DataFrame:
    """Scores of an object with predict(array), batch by batch on the executors."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(sent.value.predict(batch[features].to_numpy(dtype=float)))

    return df.withColumn(name, predict(F.struct(*[F.col(c).cast("double").alias(c) for c in features])))


def run_columns(df: DataFrame, home: str, away: str) -> DataFrame:
    """Predictions of at least 0.1 with their total and difference."""
    d = df.withColumns({"home_runs_pred": clipped(F.col(home), 0.1), "away_runs_pred": clipped(F.col(away), 0.1)})
    return d.withColumns({"total_runs_pred": F.col("home_runs_pred") + F.col("away_runs_pred"),
        "run_diff_pred": F.col("home_runs_pred") - F.col("away_runs_pred")})


def tree_importances(model: PipelineModel, features: list[str], df: DataFrame) -> DataFrame:
    gains = model.stages[-1].featureImportances.toArray()
    return df.sparkSession.createDataFrame([(c, float(g)) for c, g in zip(features, gains, strict=True)], "feature string, gain double")
