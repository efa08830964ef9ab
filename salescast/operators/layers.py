"""The two layers: will the customer buy, and then how much."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescast.functions.columns import combine_layers, refuse

SEED = 42


def assemble(df: DataFrame, features: list[str], gaps: str = "error") -> DataFrame:
    """One ``features`` vector per row. A NULL fails the job unless ``gaps="keep"``."""
    return VectorAssembler(
        inputCols=features, outputCol="features", handleInvalid=gaps
    ).transform(df)


def fit_buy_layer(
    df: DataFrame, features: list[str], label: str, **params
) -> GBTClassificationModel:
    """Boosted trees for the 0/1 label; rows without a label are left out."""
    rows = _training_rows(df, features, label)
    trees = GBTClassifier(labelCol="_label", predictionCol="buy_prediction", seed=SEED)
    trees.setProbabilityCol("buy_probability").setRawPredictionCol("buy_raw")
    return trees.setParams(**params).fit(rows)


def fit_amount_layer(
    df: DataFrame, features: list[str], label: str, **params
) -> GBTRegressionModel:
    """Boosted trees for the amount. Give it buyers only."""
    rows = _training_rows(df, features, label)
    trees = GBTRegressor(labelCol="_label", predictionCol="amount_prediction", seed=SEED)
    return trees.setParams(**params).fit(rows)


def _training_rows(df: DataFrame, features: list[str], label: str) -> DataFrame:
    labelled = df.filter(F.col(label).isNotNull()).select(
        *features, F.col(label).cast("double").alias("_label")
    )
    return assemble(labelled, features).select("features", "_label")


def score_buy_layer(
    df: DataFrame, model: GBTClassificationModel, features: list[str], threshold: float = 0.5
) -> DataFrame:
    """Add ``p_buy`` and ``buy_predicted``."""
    refuse(df, ["features", "buy_probability", "buy_prediction", "buy_raw", "p_buy", "buy_predicted"], "scoring")
    p = vector_to_array("buy_probability")[1]
    scored = model.transform(assemble(df, features)).select(*df.columns, p.alias("p_buy"))
    return scored.withColumn("buy_predicted", (F.col("p_buy") >= threshold).cast("int"))


def score_amount_layer(
    df: DataFrame, model: GBTRegressionModel, features: list[str]
) -> DataFrame:
    """Add ``amount_predicted``, the quantity expected of a customer who does buy."""
    refuse(df, ["features", "amount_prediction", "amount_predicted"], "scoring")
    scored = model.transform(assemble(df, features))
    return scored.select(*df.columns, F.col("amount_prediction").alias("amount_predicted"))


def score_two_layer(
    df: DataFrame,
    buy_layer: GBTClassificationModel,
    amount_layer: GBTRegressionModel,
    features: list[str],
    threshold: float = 0.5,
    amount_features: list[str] | None = None,
) -> DataFrame:
    """Add ``p_buy``, ``buy_predicted``, ``amount_predicted``, ``qty_gated``, ``qty_expected``.

    Row by row, without a shuffle. The second layer may have features of its own.
    """
    refuse(df, ["qty_gated", "qty_expected"], "scoring")
    bought = score_buy_layer(df, buy_layer, features, threshold)
    both = score_amount_layer(bought, amount_layer, amount_features or features)
    return both.select("*", *combine_layers("p_buy", "amount_predicted", threshold))


def feature_importance(
    model: GBTClassificationModel | GBTRegressionModel, names: list[str]
) -> DataFrame:
    """``feature, importance, rank``; importances add up to 1. One row per feature."""
    pairs = zip(names, model.featureImportances.toArray().tolist(), strict=True)
    ordered = sorted(pairs, key=lambda p: (-p[1], p[0]))
    return SparkSession.active().createDataFrame(
        [(name, value, i + 1) for i, (name, value) in enumerate(ordered)],
        "feature string, importance double, rank int",
    )
