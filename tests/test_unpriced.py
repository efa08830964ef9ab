from salescast.operators.evaluate import forecast
from salescast.operators.features import attach_items
from salescast.plans.catalog import unpriced_forecast


def test_query_reads_all_items(spark):
    plan = unpriced_forecast(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "% 3" in line]


def test_unlisted_items_are_counted(spark):
    rows = spark.createDataFrame([(1, 1, 2.0), (2, 2, 3.0)], "row long, item long, qty_expected double")
    listed = spark.createDataFrame([(1, 5.0)], "item long, price double")
    got = {r.item: r.n_unpriced for r in forecast(attach_items(rows, listed, "item", ["row"]), ["item"]).collect()}
    assert got == {1: 0, 2: 1}
