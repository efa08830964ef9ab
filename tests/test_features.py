import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from salescast.functions import crossed
from salescast.functions.columns import exact_sum
from salescast.operators.features import (
    attach_items,
    calendar,
    daily_sums,
    history,
    history_apply,
    history_totals,
    price_change,
    price_vs_peers,
    split_by_time,
    to_score_shape,
)
from salescast.sources import stage

START = dt.datetime(2024, 1, 1)


def measures():
    return {"buys": F.col("buy").cast("long")}


def make(spark, rows):
    return spark.createDataFrame(rows, "id int, user int, ts timestamp_ntz, buy int")


def contacts(n=400):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        user = 0 if i % 3 == 0 else rng.choice([None, *range(1, 9)])
        ts = START + dt.timedelta(hours=rng.randrange(24 * 12))
        rows.append((i, user, ts, rng.randrange(2)))
    return rows


def test_history_is_of_earlier_days_only(spark, join_way):
    rows = contacts()
    out = history(make(spark, rows), "user", "ts", measures(), "user", ["id"]).collect()
    assert len(out) == len(rows)
    for r in out:
        past = [p for p in rows if p[1] == r.user and p[2].date() < r.ts.date()]
        assert r.user_contacts_before == len(past)
        assert r.user_buys_before == sum(p[3] for p in past)
        last = max((p[2].date() for p in past), default=None)
        assert r.user_days_since == (None if last is None else (r.ts.date() - last).days)


def test_later_days_change_nothing_before(spark):
    rows = contacts()
    cut = START + dt.timedelta(days=6)
    early = [r for r in rows if r[2] < cut]
    changed = early + [(r[0], r[1], r[2], 1 - r[3]) for r in rows if r[2] >= cut]
    seen = []
    for data in (rows, changed, early):
        out = history(make(spark, data), "user", "ts", measures(), "user", ["id"])
        seen.append(sorted(map(str, out.filter(F.col("ts") < F.lit(cut)).collect())))
    assert seen[0] == seen[1] == seen[2]


def test_totals_for_later_rows(spark, join_way):
    rows = contacts()
    totals = stage(
        history_totals(
            daily_sums(make(spark, rows), "user", "ts", measures()), "user", measures(), "user"
        )
    )
    day = START + dt.timedelta(days=20)
    new = spark.createDataFrame(
        [(0, day), (3, day), (None, day), (99, day)], "user int, ts timestamp_ntz"
    )
    got = {r.user: r for r in history_apply(new, totals, "user", "ts", measures(), "user").collect()}
    for user in (0, 3, None):
        past = [p for p in rows if p[1] == user]
        assert got[user].user_contacts_before == len(past)
        assert got[user].user_buys_before == sum(p[3] for p in past)
        assert got[user].user_days_since == (day.date() - max(p[2].date() for p in past)).days
    assert (got[99].user_contacts_before, got[99].user_days_since) == (0, None)


def test_attach_items_keeps_rows_without_item(spark, join_way):
    rows = spark.createDataFrame([(1, 10), (2, 11), (3, None), (4, 10)], "id int, item int")
    items = spark.createDataFrame([(10, "a"), (12, "b"), (None, "no")], "item int, maker string")
    got = {r.id: r.maker for r in attach_items(rows, items, "item").collect()}
    assert got == {1: "a", 2: None, 3: None, 4: "a"}


def test_price_against_peers(spark, join_way):
    rng = random.Random(3)
    rows = [(i, "big" if i % 3 else "small", round(rng.uniform(1, 9), 1)) for i in range(300)]
    rows += [(900, "single", 4.0), (901, None, 2.0), (902, None, 3.0), (903, "big", None)]
    df = spark.createDataFrame(rows, "id int, kind string, price double")
    out = price_vs_peers(df, "kind", "price", ["id"]).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.price is None:
            assert (r.peer_price, r.price_ratio, r.price_rank) == (None, None, None)
            continue
        peers = [p[2] for p in rows if p[1] == r.kind and p[2] is not None]
        mean = sum(peers) / len(peers)
        lower = sum(p < r.price for p in peers)
        assert r.peer_price == pytest.approx(mean)
        assert r.price_ratio == pytest.approx(r.price / mean)
        assert r.price_rank == (lower / (len(peers) - 1) if len(peers) > 1 else 0.0)


def test_prices_all_alike(spark):
    df = spark.createDataFrame([(i, "k", 5.0) for i in range(6)], "id int, kind string, price double")
    assert {r.price_rank for r in price_vs_peers(df, "kind", "price").collect()} == {0.0}


def test_price_change(spark):
    rows = [
        (1, "2024-01-01 08:00:00", 10.0, 2.0),
        (1, "2024-01-01 18:00:00", 20.0, 3.0),
        (1, "2024-01-04 08:00:00", 9.0, 1.0),
        (2, "2024-01-04 08:00:00", 5.0, 0.0),
        (2, "2024-01-05 08:00:00", 5.0, 1.0),
    ]
    df = spark.createDataFrame(rows, "item int, ts string, revenue double, quantity double")
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out = price_change(df, "item", "ts", F.col("revenue"), F.col("quantity"))
    got = [tuple(r)[2:] for r in out.orderBy("item", "day").collect()]
    assert got == [
        (6.0, None, None, None), (9.0, 6.0, 3.0, 1.5),
        (None, None, None, None), (5.0, None, None, None),
    ]


def test_calendar_and_split_and_shape(spark):
    df = make(spark, [(1, 1, dt.datetime(2024, 1, 7, 23), 0), (2, 1, dt.datetime(2024, 2, 1), 1)])
    got = [
        (r.day, r.day_of_week, r.month, r.day_number)
        for r in calendar(df, "ts", "2024-01-01").orderBy("id").collect()
    ]
    assert got == [(dt.date(2024, 1, 7), 1, 1, 6), (dt.date(2024, 2, 1), 5, 2, 31)]
    df = df.union(make(df.sparkSession, [(3, 1, None, 0)]))
    parts = split_by_time(df, "ts", "2024-02-01")
    assert [[r.id for r in part.collect()] for part in parts] == [[1], [2], [3]]
    with pytest.raises(ValueError, match="day"):
        calendar(df.withColumn("day", F.lit(1)), "ts", "2024-01-01")
    assert to_score_shape(df, ["buy"]).columns == ["id", "user", "ts"]


def test_crossed_values_stay_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("a", None), (None, "a"), ("\\N", "a"), ("a\\", "b"), ("a", "\\b")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(crossed("x", "y").alias("c")).distinct().count() == len(rows)


def test_rows_without_a_time_are_in_no_history(spark):
    rows = [(1, 7, None, 1), (2, 7, START, 1), (3, 7, START + dt.timedelta(days=1), 0)]
    df = make(spark, rows)
    got = {r.id: (r.user_contacts_before, r.user_buys_before, r.user_days_since)
           for r in history(df, "user", "ts", measures(), "user", ["id"]).collect()}
    assert got == {1: (None, None, None), 2: (0, 0, None), 3: (1, 1, 1)}
    totals = stage(history_totals(daily_sums(df, "user", "ts", measures()), "user", measures(), "user"))
    later = make(spark, [(9, 7, START + dt.timedelta(days=5), None), (10, 7, None, None)])
    got = {r.id: (r.user_contacts_before, r.user_days_since)
           for r in history_apply(later, totals, "user", "ts", measures(), "user").collect()}
    assert got == {9: (2, 4), 10: (None, None)}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_keys_named_like_history_stay_as_they_are(spark, kind, join_way):
    rows = [(1, 5, START, 1), (2, None, START, 1), (3, None, START, 0)]
    df = make(spark, rows).withColumn("user_id", F.col("user").cast(kind)).drop("user")
    totals = stage(history_totals(daily_sums(df, "user_id", "ts", measures()), "user_id", measures(), "user"))
    later = df.withColumn("ts", F.col("ts") + F.expr("interval 3 days"))
    got = {r.id: (r.user_id, r.user_contacts_before) for r in
           history_apply(later, totals, "user_id", "ts", measures(), "user", ["id"]).collect()}
    five = 5 if kind == "long" else "5"
    assert got == {1: (five, 1), 2: (None, 2), 3: (None, 2)}


def test_items_listed_twice_are_an_error(spark):
    rows = spark.createDataFrame([(1, 10)], "id int, item int")
    items = spark.createDataFrame([(10, "a"), (10, "b"), (None, "c"), (None, "d")], "item int, maker string")
    with pytest.raises(ValueError, match="10"):
        attach_items(rows, items, "item")


def test_digits_are_kept(spark):
    df = spark.createDataFrame([(1, "k", 0.004), (2, "k", 0.004), (3, "k", 0.001)], "id int, kind string, price double")
    got = price_vs_peers(df, "kind", "price", ["id"]).filter("id = 1").first()
    assert got.peer_price == pytest.approx(0.003) and got.price_ratio == pytest.approx(4 / 3)
    sales = spark.createDataFrame([(1, START, 0.008, 0.004)], "item int, ts timestamp_ntz, revenue double, quantity double")
    assert price_change(sales, "item", "ts", F.col("revenue"), F.col("quantity")).first().price == 2.0
    # fractions without end and tiny amounts end no job
    for revenue in (1.23456789e-9, 1e-7 / 3, 1e-13 / 7):
        tiny = sales.withColumn("revenue", F.lit(revenue))
        assert price_change(tiny, "item", "ts", F.col("revenue"), F.col("quantity")).first().price == pytest.approx(revenue / 0.004, rel=1e-12)
    df = spark.createDataFrame([(1, "k", 1e-7 / 3), (2, "k", 1e-7 / 3), (3, "k", 1e-7 / 6)], "id int, kind string, price double")
    got = price_vs_peers(df, "kind", "price", ["id"]).filter("id = 1").first()
    assert got.price_ratio == pytest.approx(1.2, rel=1e-12)


def test_exact_sums_do_not_depend_on_order(spark):
    rng = random.Random(5)
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(-14, 6) for _ in range(500)]
    sums = set()
    for _ in range(4):
        rng.shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(rng.randint(1, 6))
        sums.add(df.agg(exact_sum(F.col("v"))).first()[0])
    assert len(sums) == 1 and sums.pop() == pytest.approx(math.fsum(values), rel=1e-9)
