"""History of the last days before a row's day, and daily sums that grow by new days only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salescast.functions.columns import day_of, refuse
from salescast.operators.features import daily_sums
from salescast.operators.joins import lookup_join
from salescast.sources.staging import stage


def recent_names(measures: Iterable[str], prefix: str, days: Iterable[int]) -> list[str]:
    """Columns that ``recent_history`` adds."""
    return [f"{prefix}_{m}_{d}d" for d in days for m in ("contacts", *measures)]


def recent_history(
    rows: DataFrame,
    daily: DataFrame,
    key: str,
    ts: str,
    measures: Iterable[str],
    prefix: str,
    days: Iterable[int] = (7, 28),
    row_id: list[str] | None = None,
) -> DataFrame:
    """Add to each row its key's sums over the last ``days`` days before the row's day.

    ``daily`` are ``daily_sums``, of the same rows or of earlier ones: a row sees the days it
    has, so rows to be scored see training days only if ``daily`` holds no other. A window of
    seven days is the seven before the row's day; that day itself is not in it. Days on which
    nothing happened count as days. Columns ``<prefix>_contacts_7d``, ``<prefix>_<measure>_7d``: 0
    where nothing happened, NULL in rows without a time. A NULL key is a key of its own.

    Rows are brought to one per key and day before they meet the daily table, so windows
    hold one row a day however busy a key is.
    """
    measures, days = list(measures), list(days)
    if not days or min(days) < 1:
        raise ValueError("a window has one day at least")
    refuse(rows, [*recent_names(measures, prefix, days), "_day", "_rows"], "recent_history")
    sums = ["contacts", *measures]
    names = dict(zip(sums, [f"_sum_{i}" for i in range(len(sums))]))
    told = daily.filter(F.col("_day").isNotNull()).select(
        key, "_day", F.lit(0).cast("long").alias("_rows"), *[F.col(s).alias(n) for s, n in names.items()]
    )
    asked = rows.filter(F.col(ts).isNotNull()).groupBy(key, day_of(ts).alias("_day"))
    asked = asked.agg(F.count(F.lit(1)).alias("_rows"))
    asked = asked.select("*", *[F.lit(None).cast(told.schema[n].dataType).alias(n) for n in names.values()])
    points = told.unionByName(asked).groupBy(key, "_day")
    points = points.agg(F.sum("_rows").alias("_rows"), *[F.sum(n).alias(n) for n in names.values()])
    by_day = W.partitionBy(key).orderBy(F.unix_date("_day"))
    found = []
    for d in days:
        before = by_day.rangeBetween(-d, -1)
        for s, n in names.items():
            value = F.coalesce(F.sum(n).over(before), F.lit(0)).cast(daily.schema[s].dataType)
            found.append(value.alias(f"{prefix}_{s}_{d}d"))
    table = stage(points.select(key, "_day", "_rows", *found).filter("_rows > 0"))
    return lookup_join(rows.withColumn("_day", day_of(ts)), table, [key, "_day"], "_rows", row_id=row_id).drop("_day")


def store_days(
    rows: DataFrame, path: str, key: str, ts: str, measures: dict[str, Column], first: str, after: str
) -> None:
    """Sum the days from ``first`` to before ``after`` and put them into the daily table at ``path``.

    The table is partitioned by day (``day``). Only rows of these days are read, the filter
    reaching the scan, and only their partitions are written: older ones stay as they are, and
    a day that is stored again is replaced, so a repeated or restarted run changes nothing. A
    stored day that has lost all its rows is left as it was.
    """
    kind = rows.schema[ts].dataType
    new = rows.filter((F.col(ts) >= F.lit(first).cast(kind)) & (F.col(ts) < F.lit(after).cast(kind)))
    daily = daily_sums(new, key, ts, measures).withColumnRenamed("_day", "day")
    whole = daily.repartition(F.col("day"), F.pmod(F.xxhash64(key), F.lit(16)))
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def stored_days(table: DataFrame, first: str | None = None, after: str | None = None) -> DataFrame:
    """Days of a table that ``store_days`` made, as ``daily_sums`` gives them; other partitions are not read."""
    day = F.col("day")
    if first is not None:
        table = table.filter(day >= F.lit(first).cast("date"))
    if after is not None:
        table = table.filter(day < F.lit(after).cast("date"))
    return table.withColumnRenamed("day", "_day")
