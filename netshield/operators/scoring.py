"""Scorers: a scorer is any function from a feature DataFrame to the same rows plus ``p``."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netshield.constants import FEATURES
from netshield.functions.moments import or_zero
from netshield.options import Options

Scorer = Callable[[DataFrame], DataFrame]


def fill_features(df: DataFrame, names: Sequence[str] = FEATURES) -> DataFrame:
    """Missing and NaN features become 0."""
    return df.withColumns({name: or_zero(F.col(name)) for name in names})


def logistic_scorer(weights: dict[str, float], bias: float) -> Scorer:
    """A fixed linear model as one column expression."""

    def score(df: DataFrame) -> DataFrame:
        total = F.lit(bias)
        for name, weight in weights.items():
            total = total + or_zero(F.col(name)) * weight
        return df.withColumn("p", 1 / (1 + F.exp(-total)))

    return score


def train_gbt(labelled: DataFrame, label: str, iterations: int = 20, depth: int = 5,
              seed: int = 42) -> PipelineModel:
    """Gradient-boosted trees on the 36 features."""
    stages = [
        VectorAssembler(inputCols=list(FEATURES), outputCol="features"),
        GBTClassifier(labelCol=label, maxIter=iterations, maxDepth=depth, seed=seed),
    ]
    return Pipeline(stages=stages).fit(fill_features(labelled))


def gbt_scorer(model: PipelineModel) -> Scorer:
    def score(df: DataFrame) -> DataFrame:
        scored = model.transform(fill_features(df))
        return scored.select(*df.columns, vector_to_array("probability")[1].alias("p"))

    return score


def load_gbt(path: str) -> Scorer:
    """A saved pipeline; its inputs must be the 36 features in their order."""
    model = PipelineModel.load(path)
    inputs = model.stages[0].getInputCols()
    if list(inputs) != list(FEATURES):
        raise ValueError(f"model expects other features: {inputs}")
    return gbt_scorer(model)


def booster_scorer(spark: SparkSession, model_path: str, metadata_path: str) -> Scorer:
    """An externally trained booster text file, when its library is installed.

    The metadata JSON names the feature order. Every task builds the booster once and scores Arrow
    batches on one thread, since tasks are already parallel.
    """
    try:
        import lightgbm
    except ImportError as error:
        raise RuntimeError("scoring with a booster file needs the lightgbm package") from error

    def text_of(path: str) -> str:
        return spark.read.text(path, wholetext=True).first()[0]

    metadata = json.loads(text_of(metadata_path))
    names = metadata["feature_names"]
    if list(names) != list(FEATURES):
        raise ValueError(f"model expects other features: {names}")
    model_text = spark.sparkContext.broadcast(text_of(model_path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        booster = lightgbm.Booster(model_str=model_text.value)
        for batch in batches:
            yield batch.assign(p=booster.predict(batch[list(names)].fillna(0), num_threads=1))

    def score(df: DataFrame) -> DataFrame:
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.mapInPandas(run, f"{columns}, p double")

    return score


def decide(scored: DataFrame, opts: Options = Options()) -> DataFrame:
    """Adds ``is_ddos`` and the probabilities of both classes."""
    return scored.withColumns({
        "is_ddos": F.col("p") >= opts.threshold,
        "ddos_probability": F.col("p"),
        "normal_probability": 1 - F.col("p"),
    })
