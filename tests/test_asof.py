import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from salescast.operators.asof import carried, last_before, likelihood_ordered

DAY0 = dt.date(2024, 1, 1)


def drawn(seed, n, days):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        key = draw.choice(["hot", "hot", "a", "b", None])
        day = draw.choice([None, *range(days)])
        ts = None if day is None else dt.datetime(2024, 1, 1, draw.randint(0, 23)) + dt.timedelta(days=day)
        rows.append((i, key, ts, draw.choice([0, 1, 1, None])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, key string, ts timestamp_ntz, y int").repartition(3)


@pytest.mark.parametrize("span", [1, 7, 64])
def test_last_before_against_brute_force(spark, join_way, span):
    rows, draw = drawn(1, 150, 40), random.Random(2)
    changes = {(k, d): draw.choice([1.5, 2.0, 7.25, None]) for k in ("hot", "a", None, "x") for d in range(0, 40, 3)}
    table = spark.createDataFrame(
        [(k, DAY0 + dt.timedelta(days=d), p) for (k, d), p in changes.items()] + [("a", None, 9.0)], "key string, day date, price double"
    )
    found = last_before(frame(spark, rows), table, "key", "ts", ["price"], "past", ["id"], span)
    want = {}
    for i, key, ts, _ in rows:
        day = None if ts is None else (ts.date() - DAY0).days
        earlier = [] if day is None else [(d, p) for (k, d), p in changes.items() if k == key and d < day and p is not None]
        last = max(earlier, default=None)
        want[i] = (last[1], day - last[0]) if last else (None, None)
    assert {r.id: (r.past_price, r.past_days) for r in found.collect()} == want
    assert found.columns == ["id", "key", "ts", "y", "past_price", "past_days"]


def test_later_days_change_nothing(spark):
    rows = frame(spark, drawn(3, 80, 20))
    early = spark.createDataFrame([("hot", DAY0 + dt.timedelta(days=d), float(d)) for d in range(8)], "key string, day date, price double")
    later = early.withColumns({"day": F.date_add("day", 10), "price": F.lit(99.0)})
    first = F.col("ts") < "2024-01-11"
    pick = lambda t: sorted(map(tuple, last_before(rows, t, "key", "ts", ["price"], "past", ["id"]).filter(first).collect()))
    assert pick(early) == pick(early.union(later)) != []


def test_carried_beyond_empty_ranges_and_names(spark):
    points = spark.createDataFrame(
        [("a", DAY0, 1), ("a", DAY0 + dt.timedelta(days=500), None), ("a", DAY0 + dt.timedelta(days=900), 3), ("a", None, 8)],
        "key string, day date, v int",
    )
    assert [r.before for r in carried(points, "key", "day", "v", "before").orderBy(F.col("day").asc_nulls_first()).collect()] == [None, None, 1, 1]
    assert carried(points.limit(0), "key", "day", "v", "before").count() == 0
    with pytest.raises(ValueError):
        carried(points, "key", "day", "v", "day")


def test_likelihood_ordered_against_brute_force(spark, join_way):
    rows = drawn(5, 200, 15)
    found = likelihood_ordered(frame(spark, rows), ["key"], "y", "ts", 3.0, row_id=["id"])
    for r in found.collect():
        past = [(k, y) for _, k, ts, y in rows if ts and r.ts and ts.date() < r.ts.date() and y is not None]
        if not past:
            assert r.likelihood is None
        else:
            prior, own = sum(y for _, y in past) / len(past), [y for k, y in past if k == r.key]
            assert r.likelihood == pytest.approx((sum(own) + 3 * prior) / (len(own) + 3))
    assert found.count() == len(rows)


def test_own_and_later_labels_do_not_leak(spark):
    rows = drawn(6, 200, 15)
    cut = dt.datetime(2024, 1, 8)
    other = [(i, k, ts, y if ts and ts < cut else 1 - y if y is not None else 1) for i, k, ts, y in rows]
    until = lambda some: {
        r.id: r.likelihood
        for r in likelihood_ordered(frame(spark, some), ["key"], "y", "ts", row_id=["id"]).filter("ts < timestamp_ntz'2024-01-09'").collect()
    }
    assert until(rows) == until(other) and until(rows)


def test_amounts_of_many_digits_add_up_in_any_order(spark):
    rows = spark.range(300).select(
        "id", F.lit("a").alias("key"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 3 as int))").alias("ts"), (F.col("id") / 8 + 0.1).alias("y")
    )
    values = [sorted(map(tuple, likelihood_ordered(rows.repartition(n), ["key"], "y", "ts", row_id=["id"]).select("id", "likelihood").collect())) for n in (1, 7)]
    assert values[0] == values[1]
