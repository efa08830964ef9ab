"""Every query against its SQL, run by another engine over the same files."""


import duckdb
import pytest

import __spark_entry__ as driver
from salescast.plans.catalog import QUERIES
from salescast.plans.oracle import ORACLE as SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = """region nation customer supplier part orders lineitem events documents
embeddings pages benchmark labels conversations""".split()



@pytest.fixture(scope="module")
def other_engine():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def ordered(rows):
    return sorted(rows, key=lambda row: [(v is None, str(type(v)), 0 if v is None else v) for v in row])


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, other_engine, name):
    got = QUERIES[name](spark, FOLDER)
    found = other_engine.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(columns)
    want = found.fetchall()
    assert want
    assert ordered(map(tuple, got.select(columns).collect())) == ordered(want)


def test_only_models_lack_sql():
    assert set(QUERIES) - set(SQL) == {
        "buy_layer", "amount_layer", "two_layer_scores", "feature_importance"
    }


def test_two_layer_scores(spark):
    scores = QUERIES["two_layer_scores"](spark, FOLDER).collect()
    assert len(scores) == QUERIES["scan_score_rows"](spark, FOLDER).count()
    for r in scores:
        assert 0 <= r.p_buy <= 1
        assert r.qty_gated == (r.amount if r.p_buy >= 0.5 else 0.0)
        assert r.qty_expected == pytest.approx(r.p_buy * r.amount)


def test_all_are_registered():
    assert set(QUERIES) <= set(driver.queries()) and set(SQL) <= set(driver.oracle_sql())


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_plans_have_no_product_and_no_python(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().toString()
    for word in ("CartesianProduct", "NestedLoop", "Python", "ArrowEval"):
        assert word not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["scan_score_rows"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "In(event_type" in plan and "GreaterThanOrEqual(ts" in plan
    plan = QUERIES["price_change"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "struct<l_partkey:bigint,l_quantity:double,l_extendedprice:double,l_shipdate" in plan
