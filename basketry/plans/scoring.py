"""From a history to ranked items: fit and keep a model with its encoding, read it again, score coming dates."""

from __future__ import annotations

import json

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.operators import items, learn
from basketry.plans import training

LABEL = "didBuy_target"


def _assembled(encoded: DataFrame, inputs: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error").transform(encoded.na.fill(0.0, inputs))


def fit(frame: DataFrame, trees: int = 20, validation: float = 0.1) -> tuple[GBTClassificationModel, dict]:
    """A model of a training frame, and the encoding that its inputs need. Training ends early by the loss on held-out rows."""
    encoding = training.fit_encoding(frame)
    rows = _assembled(training.encode(frame, encoding), encoding["inputs"])
    return learn.boosted_model(rows.select("features", F.col(LABEL).cast("double").alias("label")), trees, validation=validation), encoding


def save(spark: SparkSession, path: str, model: GBTClassificationModel, encoding: dict, dictionary: DataFrame | None = None) -> None:
    """The model, its encoding and the dictionary of items, each in a folder of its own below path."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(encoding),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/encoding")
    if dictionary is not None:
        dictionary.write.mode("overwrite").parquet(f"{path}/dictionary")


def load(spark: SparkSession, path: str) -> tuple[GBTClassificationModel, dict]:
    return GBTClassificationModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/encoding").first()[0])


def scores(model: GBTClassificationModel, encoding: dict, days: DataFrame, dates: DataFrame, weather: DataFrame | None = None) -> DataFrame:
    """(item_id, d, score) of every known item on each date, by the state of its history before."""
    ahead = training.prediction_frame(days, dates, weather)
    rows = _assembled(training.encode(ahead, encoding), encoding["inputs"])
    return model.transform(rows).select("item_id", "d", vector_to_array("probability")[1].alias("score"))


def ranked(scored: DataFrame, dictionary: DataFrame | None = None, top: int | None = None) -> DataFrame:
    """With each date's rank by score, then item; with names if there is a dictionary, and only the first `top` of a date if that is said (a top-k report)."""
    order = Window.partitionBy("d").orderBy(F.desc("score"), "item_id")
    out = scored.withColumn("rank", F.row_number().over(order).cast("long"))
    out = out if top is None else out.where(F.col("rank") <= top)
    return out if dictionary is None else items.with_names(out, dictionary)
