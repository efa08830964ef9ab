import pytest
from pyspark.sql import functions as F

from salescast.operators import joins
from salescast.operators.joins import fits_broadcast, heavy_keys, lookup_join, salted_join
from salescast.sources import stage


@pytest.fixture
def skewed(spark):
    """3000 rows, a third of them of key 0, some without a key."""
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 != 1, F.col("id") % 97 + 1)
    return spark.range(3000).select("id", key.cast("long").alias("k"))


def test_few_keys_can_be_heavy(spark, skewed):
    counts = stage(skewed.groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    rows = heavy_keys(counts, ["k"], "n").collect()
    slices = joins.slices_of(skewed)
    assert len(rows) <= slices
    assert sum(r["_salts"] for r in rows) <= 2 * slices
    assert [r.k for r in rows] == [0]
    assert rows[0]["_salts"] == -(-1000 * slices // 3000)


def test_lookup_keeps_every_row(spark, skewed, join_way):
    table = stage(
        skewed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    )
    out = lookup_join(skewed, table, ["k"], "n", row_id=["id"])
    assert out.columns == ["id", "k", "top"]
    want = skewed.groupBy("k").agg(F.max("id").alias("want"))
    checked = out.join(want.withColumnRenamed("k", "q"), F.col("k").eqNullSafe(F.col("q")))
    assert checked.count() == 3000
    assert checked.filter("not top <=> want").count() == 0


def test_lookup_without_weight_and_with_condition(spark, skewed, join_way):
    table = stage(spark.range(0, 60).select(F.col("id").alias("k"), F.lit("v").alias("v")))
    only = F.col("id") % 2 == 0
    out = lookup_join(skewed, table, ["k"], where=only)
    assert out.count() == 3000
    wrong = out.filter(F.col("v").isNotNull() != (only & F.coalesce(F.col("k") < 60, F.lit(False))))
    assert wrong.count() == 0


def test_salted_join_of_many_to_many(spark, skewed):
    right = spark.createDataFrame(
        [(0, "a"), (0, "b"), (5, "c"), (None, "d"), (777, "e")], "k long, v string"
    )
    counts = stage(skewed.groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    out = salted_join(skewed, right, ["k"], heavy_keys(counts, ["k"], "n"), "inner")
    got = {r.v: r["count"] for r in out.groupBy("v").count().collect()}
    n = {r.k: r.n for r in counts.collect()}
    assert got == {"a": 1000, "b": 1000, "c": n[5], "d": n[None]}


def test_hot_key_is_spread_over_partitions(spark, skewed, monkeypatch):
    monkeypatch.setattr(joins, "MAX_BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        table = stage(skewed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("v")))
        out = lookup_join(skewed, table, ["k"], "n", row_id=["id"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert "SortMergeJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    # unsalted, one of the 8 partitions would hold 1000 rows more than the others
    assert sum(sizes) == 3000 and max(sizes) < 2 * 3000 / 8


def test_size_counts_rows_and_texts(spark, monkeypatch):
    table = spark.range(100).select("id", F.lit("x" * 50).alias("t"))
    assert fits_broadcast(table)
    monkeypatch.setattr(joins, "MAX_BROADCAST_BYTES", 100 * (2 * joins.CELL_BYTES + 50))
    assert fits_broadcast(table)
    monkeypatch.setattr(joins, "MAX_BROADCAST_BYTES", 100 * (2 * joins.CELL_BYTES + 49))
    assert not fits_broadcast(table)
    monkeypatch.undo()
    monkeypatch.setattr(joins, "MAX_BROADCAST_ROWS", 99)
    assert not fits_broadcast(table)


def test_what_cannot_be_measured_is_not_broadcast(spark):
    table = spark.range(3).select("id", F.array(F.lit(1.0)).alias("numbers"))
    assert fits_broadcast(table)
    assert not fits_broadcast(table.withColumn("texts", F.array(F.lit("x"))))
    assert not fits_broadcast(table.withColumn("both", F.struct("id")))


def test_column_in_both_is_an_error(spark, skewed):
    table = spark.range(3).select(F.col("id").alias("k"), F.lit(1).alias("id"))
    with pytest.raises(ValueError, match="id"):
        lookup_join(skewed, table, ["k"])
