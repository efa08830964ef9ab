import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from salescast.operators.features import daily_sums, history_totals
from salescast.operators.recent import recent_history, store_days, stored_days
from salescast.sources import replace_scores

START = dt.datetime(2024, 1, 1)
COLUMNS = "id int, who string, ts timestamp_ntz, qty int"


def measures():
    return {"qty": F.coalesce(F.col("qty"), F.lit(0)).cast("long")}


def made(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def found(rows, daily, days):
    wide = recent_history(rows, daily, "who", "ts", ["qty"], "w", days, ["id"])
    return {r.id: tuple(r[f"w_{m}_{d}d"] for d in days for m in ("contacts", "qty")) for r in wide.collect()}


def test_edge_days_gaps_and_unknown_times(spark, join_way):
    day = lambda n: START + dt.timedelta(days=n, hours=5)
    rows = [(1, "a", day(0), 4), (2, "a", day(0), 1), (3, "a", day(7), 2), (4, "a", day(8), None),
            (5, None, day(3), 9), (6, None, day(4), 1), (7, "a", None, 50)]
    df = made(spark, rows)
    got = found(df, daily_sums(df, "who", "ts", measures()), [1, 7])
    assert got[1] == got[2] == (0, 0, 0, 0)  # its own day is not in it
    assert got[3] == (0, 0, 2, 5)  # the seventh day before is the last one in
    assert got[4] == (1, 2, 1, 2)  # the eighth is out
    assert got[6] == (1, 9, 1, 9)
    assert got[7] == (None, None, None, None)


def test_brute_force_and_no_later_day(spark, join_way):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "b", None]), START + dt.timedelta(hours=rng.randint(0, 24 * 60)), rng.randint(0, 5))
            for i in range(300)]
    df = made(spark, rows)
    daily = daily_sums(df.filter(F.col("ts") < F.lit(START + dt.timedelta(days=40))), "who", "ts", measures())
    got = found(df, daily, [7, 28])
    for i, who, ts, _ in rows:
        want = []
        for d in (7, 28):
            last = [r for r in rows if r[1] == who and r[2] < START + dt.timedelta(days=40)
                    and 1 <= (ts.date() - r[2].date()).days <= d]
            want += [len(last), sum(r[3] for r in last)]
        assert got[i] == tuple(want)


def test_empty_and_clashing(spark):
    df = made(spark, [])
    assert found(df, daily_sums(df, "who", "ts", measures()), [7]) == {}
    with pytest.raises(ValueError, match="w_qty_7d"):
        recent_history(df.withColumn("w_qty_7d", F.lit(1)), daily_sums(df, "who", "ts", measures()), "who", "ts", ["qty"], "w", [7])
    with pytest.raises(ValueError):
        found(df, daily_sums(df, "who", "ts", measures()), [0])


def test_days_are_added_one_by_one(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), START + dt.timedelta(hours=rng.randint(0, 24 * 9)), rng.randint(0, 5)) for i in range(200)]
    df, path = made(spark, rows), str(tmp_path / "daily")
    dates = [(START + dt.timedelta(days=n)).date().isoformat() for n in range(11)]
    store_days(df, path, "who", "ts", measures(), dates[0], dates[5])
    old = {p: p.stat().st_mtime_ns for p in (tmp_path / "daily").rglob("*.parquet")}
    store_days(df, path, "who", "ts", measures(), dates[5], dates[10])
    assert all(p.stat().st_mtime_ns == t for p, t in old.items())
    whole = daily_sums(df, "who", "ts", measures())
    table = stored_days(spark.read.parquet(path))
    columns = ["who", "_day", "contacts", "qty"]
    want = sorted(map(str, whole.select(columns).collect()))
    assert sorted(map(str, table.select(columns).collect())) == want
    # again: nothing changes
    store_days(df, path, "who", "ts", measures(), dates[4], dates[6])
    table = stored_days(spark.read.parquet(path))
    assert sorted(map(str, table.select(columns).collect())) == want
    totals = {r.who: (r.w_contacts_before, r.w_qty_before, r._last) for r in history_totals(table, "who", ["qty"], "w").collect()}
    assert totals == {r.who: (r.w_contacts_before, r.w_qty_before, r._last) for r in history_totals(whole, "who", ["qty"], "w").collect()}


def test_old_days_are_not_read(spark, tmp_path):
    df, path = made(spark, [(i, "a", START + dt.timedelta(days=i), 1) for i in range(6)]), str(tmp_path / "daily")
    store_days(df, path, "who", "ts", measures(), "2024-01-01", "2024-01-07")
    some = stored_days(spark.read.parquet(path), "2024-01-05")
    assert {f.split("day=")[1][:10] for f in some.inputFiles()} >= {"2024-01-05"}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert some.count() == 2


def test_scores_are_replaced_by_partition(spark, tmp_path):
    path = str(tmp_path / "scores")
    first = spark.createDataFrame([("x", 1, 0.1), ("y", 2, 0.2)], "part string, id int, p double")
    second = spark.createDataFrame([("y", 2, 0.9), ("z", 3, 0.3)], "part string, id int, p double")
    replace_scores(first, path, ["part"])
    for _ in range(2):
        replace_scores(second, path, ["part"])
        got = sorted((r.part, r.id, r.p) for r in spark.read.parquet(path).collect())
        assert got == [("x", 1, 0.1), ("y", 2, 0.9), ("z", 3, 0.3)]
    with pytest.raises(ValueError):
        replace_scores(first, path, [])
