"""Matchers: gradient-boosted trees on the pair features, and a rule on the heuristic similarities."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import similarity
from lodestone.operators import features, sampling


def fit_gbt(train: DataFrame, iterations: int = 100, step: float = 0.1, seed: int = sampling.SEED) -> PipelineModel:
    """train: feature columns and an integer label."""
    trees = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=iterations, stepSize=step, maxDepth=5, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features.FEATURES, outputCol="vector"), trees]).fit(train)


def score_gbt(pairs: DataFrame, model: PipelineModel) -> DataFrame:
    return model.transform(pairs).withColumn("score", vector_to_array("probability")[1]).drop("vector", "rawPrediction", "probability", "prediction")


def save(model: PipelineModel, path: str, metadata: dict) -> None:
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(metadata, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/metadata").first()[0])


def rule_score():
    """3 x name Jaccard + 2 x address Jaccard of a_ and b_ columns."""
    return 3 * similarity.set_jaccard(F.col("a_nt"), F.col("b_nt")) + 2 * similarity.set_jaccard(F.col("a_at"), F.col("b_at"))
