import pytest
from pyspark.sql import functions as F

from salescast.functions import combine_layers
from salescast.operators.evaluate import accuracy, forecast
from salescast.operators.layers import (
    assemble,
    feature_importance,
    fit_amount_layer,
    fit_buy_layer,
    score_two_layer,
)

FEATURES = ["price", "cat", "brand"]


@pytest.fixture(scope="module")
def planted(spark):
    rows = spark.range(4000).select(
        "id",
        (F.col("id") % 10).alias("price"),
        (F.floor(F.col("id") / 10) % 2).alias("cat"),
        (F.floor(F.col("id") / 20) % 2).alias("brand"),
    )
    buy = ((F.col("price") < 5) & (F.col("cat") == 1)).cast("int")
    rows = rows.withColumn("buy", buy).withColumn(
        "qty", F.when(F.col("buy") == 1, F.when(F.col("brand") == 1, 3.0).otherwise(7.0))
    )
    train, test = rows.filter("id < 3000"), rows.filter("id >= 3000")
    first = fit_buy_layer(train, FEATURES, "buy", maxIter=5, maxDepth=3)
    second = fit_amount_layer(train.filter("buy = 1"), FEATURES, "qty", maxIter=5, maxDepth=3)
    return test, first, second


def test_planted_rule_is_found(planted):
    test, first, second = planted
    scored = score_two_layer(test, first, second, FEATURES)
    assert scored.count() == test.count()
    assert accuracy(scored, "buy", "buy_predicted").first().accuracy == 1.0
    buyers = scored.filter("buy = 1")
    assert buyers.filter(F.abs(F.col("amount_predicted") - F.col("qty")) > 1e-6).count() == 0
    assert scored.filter("p_buy < 0 or p_buy > 1").count() == 0
    assert scored.filter("qty_gated != 0 and qty_gated != amount_predicted").count() == 0
    other = score_two_layer(test, first, second, FEATURES, threshold=0.99)
    assert other.filter("qty_gated != 0 or buy_predicted != 0").count() == 0


def test_importance(planted):
    _, first, second = planted
    one = {r.feature: r for r in feature_importance(first, FEATURES).collect()}
    two = {r.feature: r for r in feature_importance(second, FEATURES).collect()}
    assert sum(r.importance for r in one.values()) == pytest.approx(1)
    assert one["brand"].importance == 0 and one["brand"].rank == 3
    assert two["brand"].importance == pytest.approx(1) and two["brand"].rank == 1


def test_gaps_in_features_are_loud(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "price double")
    with pytest.raises(Exception):
        assemble(df, ["price"]).collect()
    assert assemble(df, ["price"], gaps="keep").count() == 2


GIVEN = [(0.8, 5.0, 2.5), (0.3, 10.0, 1.0), (0.5, 4.0, 2.0)]


def test_combining(spark):
    df = spark.createDataFrame(GIVEN, "p double, amount double, price double")
    out = df.select("*", *combine_layers("p", "amount"))
    assert [(r.qty_gated, r.qty_expected) for r in out.collect()] == [
        (5.0, 4.0), (0.0, 3.0), (4.0, 2.0)
    ]
    total = forecast(out.withColumn("k", F.lit("all")), ["k"]).first()
    assert (total.n_rows, total.expected_qty, total.expected_revenue) == (3, 9.0, 17.0)


def test_forecast_without_prices(spark):
    rows = [("a", 20.0, 0.004), ("a", 5.0, None), ("b", 1.0, None)]
    df = spark.createDataFrame(rows, "k string, qty_expected double, price double")
    got = {r.k: tuple(r)[1:] for r in forecast(df, ["k"]).collect()}
    assert got == {"a": (2, 1, 25.0, 0.08), "b": (1, 1, 1.0, None)}


def test_accuracy(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (0, 1), (None, 1)], "y int, p int")
    row = accuracy(df, "y", "p").first()
    assert (row.n_rows, row.accuracy, row.majority_share) == (4, 0.5, 0.75)
    none = accuracy(df.filter("y > 7"), "y", "p").first()
    assert (none.n_rows, none.accuracy, none.majority_share) == (0, None, None)


def test_accuracy_agrees_with_spark(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    df = spark.range(100).select(
        (F.col("id") % 2).cast("double").alias("y"), (F.col("id") % 3 % 2).cast("double").alias("p")
    )
    theirs = MulticlassClassificationEvaluator(
        labelCol="y", predictionCol="p", metricName="accuracy"
    ).evaluate(df)
    assert accuracy(df, "y", "p").first().accuracy == theirs
