import json
import pathlib

import duckdb
import pytest
from pyspark.sql import functions as F

from salescast.operators.layers import assemble, fit_amount_layer, fit_buy_layer
from salescast.operators.trees import probability, tree_sql, tree_sum, trees_of

FEATURES = ["f0", "f1", "f2"]


@pytest.fixture(scope="module")
def rows(spark):
    made = spark.range(900).select(
        "id", (F.col("id") % 17).cast("double").alias("f0"), F.sin("id").alias("f1"), ((F.col("id") * 7) % 5 - 2.5).alias("f2")
    )
    return made.withColumns({"buy": ((F.col("f0") + 9 * F.col("f1") > 8) != (F.col("f2") > 0)).cast("int"), "qty": F.col("f0") * 2 + F.col("f1")})


def test_columns_equal_the_model(rows):
    first = fit_buy_layer(rows, FEATURES, "buy", maxIter=4, maxDepth=3)
    second = fit_amount_layer(rows, FEATURES, "qty", maxIter=4, maxDepth=4)
    scored = first.transform(assemble(rows, FEATURES)).select(*rows.columns, F.expr("buy_probability") .alias("p"))
    from pyspark.ml.functions import vector_to_array

    scored = scored.withColumn("p", vector_to_array("p")[1])
    amounts = second.transform(assemble(scored, FEATURES)).drop("features")
    both = amounts.select("p", "amount_prediction", probability(tree_sum(trees_of(first), FEATURES)).alias("q"), tree_sum(trees_of(second), FEATURES).alias("a"))
    found = both.collect()
    assert len(found) == 900 and len({r.p for r in found}) > 3
    for r in found:
        assert r.q == pytest.approx(r.p, abs=1e-12) and r.a == pytest.approx(r.amount_prediction, abs=1e-9)


def test_sql_equals_columns(rows):
    trees = trees_of(fit_amount_layer(rows, FEATURES, "qty", maxIter=3, maxDepth=3))
    assert json.loads(json.dumps(trees)) == trees
    got = {r.id: r.a for r in rows.select("id", tree_sum(trees, FEATURES).alias("a")).collect()}
    given = rows.toArrow()  # noqa: F841
    assert dict(duckdb.sql(f"SELECT id, {tree_sql(trees, FEATURES)} FROM given").fetchall()) == got


def test_fixed_layers_hold_real_trees():
    import salescast.plans

    path = pathlib.Path(salescast.plans.__file__).parent / "fixed_layers.json"
    layers = json.loads(path.read_text())
    assert set(layers) == {"features", "buy", "amount"} and all(len(layers[k]) > 1 for k in ("buy", "amount"))
