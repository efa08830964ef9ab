"""Values of strictly earlier days: the last one before a row, and likelihoods in time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salescast.functions.columns import day_of, refuse, smoothed, summable
from salescast.operators.joins import lookup_join
from salescast.sources.staging import stage

SPAN = 64  # days in a range


def carried(points: DataFrame, key: str, day: str, value: str, out: str, span: int = SPAN) -> DataFrame:
    """Add ``out``: the last ``value`` that is not NULL on an earlier day of the same key.

    ``points`` have one row per key and day. The days of a key are cut into ranges of
    ``span`` days: what a range begins with is carried over from the last value of each
    earlier range, so a key of any length is in windows of ``span`` rows, and in one of a
    row per range. Rows without a day come first and have nothing before them; their value
    is carried nowhere.
    """
    refuse(points, [out, "_range", "_inside", "_carried", "_range_key"], "carried")
    known = F.when(F.col(day).isNotNull(), F.col(value))
    at = F.floor(F.unix_date(F.col(day)) / span).cast("long")
    ranged = points.withColumn("_range", at)
    inside = W.partitionBy(key, "_range").orderBy(day).rowsBetween(W.unboundedPreceding, -1)
    ranged = ranged.withColumn("_inside", F.last(known, ignorenulls=True).over(inside))
    ends = ranged.filter(F.col(day).isNotNull()).groupBy(key, "_range").agg(F.max_by(known, F.when(known.isNotNull(), F.col(day))).alias("_end"))
    earlier = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select(F.col(key).alias("_range_key"), F.col("_range").alias("_of"), F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    same = F.col(key).eqNullSafe(F.col("_range_key")) & (F.col("_range") == F.col("_of"))
    found = ranged.join(carry, same, "left").withColumn(out, F.coalesce("_inside", "_carried"))
    return found.drop("_range", "_inside", "_carried", "_range_key", "_of")


def last_before(
    rows: DataFrame, changes: DataFrame, key: str, ts: str, values: list[str], prefix: str, row_id: list[str] | None = None, span: int = SPAN
) -> DataFrame:
    """Add to each row the values of its key's last earlier day in ``changes``: ``<prefix>_<value>``, ``<prefix>_days``.

    ``changes`` have the key, ``day`` and the values, one row per key and day; a day on which
    all values are NULL is none. Both sides are brought to one row per key and day before
    they meet (see ``carried``), so a key may have any number of rows; only strictly earlier
    days count. Rows without a time, or of a key without an earlier day, get NULL. A NULL
    key is a key of its own.
    """
    names = [f"{prefix}_{v}" for v in values]
    refuse(rows, [*names, f"{prefix}_days", "_day", "_rows", "_value", "_last"], "last_before")
    there = F.coalesce(*[F.col(v).cast("string") for v in values]).isNotNull() & F.col("day").isNotNull()
    value = F.when(there, F.struct(F.col("day").alias("day"), *values))
    told = changes.select(key, F.col("day").alias("_day"), F.lit(0).cast("long").alias("_rows"), value.alias("_value"))
    asked = rows.groupBy(key, day_of(ts).alias("_day")).agg(F.count(F.lit(1)).alias("_rows"))
    asked = asked.withColumn("_value", F.lit(None).cast(told.schema["_value"].dataType))
    points = told.unionByName(asked).groupBy(key, "_day").agg(F.sum("_rows").alias("_rows"), F.first("_value", ignorenulls=True).alias("_value"))
    table = carried(points, key, "_day", "_value", "_last", span).filter("_rows > 0")
    table = stage(
        table.select(
            key, "_day", "_rows", *[F.col(f"_last.{v}").alias(n) for v, n in zip(values, names)],
            F.date_diff("_day", F.col("_last.day")).alias(f"{prefix}_days"),
        )
    )
    return lookup_join(rows.withColumn("_day", day_of(ts)), table, [key, "_day"], "_rows", row_id=row_id).drop("_day")


def likelihood_ordered(
    df: DataFrame, keys: list[str], label: str, ts: str, m: float = 20.0, out: str = "likelihood", row_id: list[str] | None = None
) -> DataFrame:
    """Add to each row the smoothed mean of the label over its key's strictly earlier days.

    The prior is the mean over all keys' strictly earlier days, so neither a row's own label,
    nor its day's, nor a later one has a part in its value. Labels are summed as decimals per
    key and day, then added up along the days of a key; the overall mean along the days.
    Rows of the first day with a label, and rows without a time, have NULL: nothing is
    known before them. A NULL key is a key of its own.
    """
    refuse(df, [out, "_day", "_rows", "_n", "_s", "_prior"], "likelihood_ordered")
    y = summable(F.col(label).cast("double"))
    daily = df.groupBy(*keys, day_of(ts).alias("_day")).agg(
        F.count(F.lit(1)).alias("_rows"), F.count(y).alias("_n"), F.coalesce(F.sum(y), F.lit(0)).alias("_s")
    )
    daily = stage(daily)

    def before(over: W) -> tuple[Column, Column]:
        frame = over.orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
        return tuple(F.coalesce(F.sum(c).over(frame), F.lit(0)) for c in ("_s", "_n"))

    dated = daily.filter(F.col("_day").isNotNull())
    # one row per day of the calendar
    days = dated.groupBy("_day").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    s, n = before(W.partitionBy(F.lit(0)))
    priors = days.select("_day", F.try_divide(s.cast("double"), n).alias("_prior"))
    s, n = before(W.partitionBy(*keys))
    sums = dated.select(*keys, "_day", "_rows", s.cast("double").alias("_s"), n.alias("_n"))
    table = lookup_join(sums, stage(priors), ["_day"], row_id=[*keys, "_day"])
    table = stage(table.select(*keys, "_day", "_rows", smoothed(F.col("_s"), F.col("_n"), F.col("_prior"), m).alias(out)))
    return lookup_join(df.withColumn("_day", day_of(ts)), table, [*keys, "_day"], "_rows", row_id=row_id).drop("_day")
