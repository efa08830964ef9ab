"""New variables. History looks at strictly earlier days, never at the row's own day."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salescast.functions.columns import day_of, exact_sum, fine_part, refuse, summable
from salescast.operators.joins import lookup_join, slices_of
from salescast.sources.staging import stage

QUANTILE_ERROR = 0.005
PEER_COLUMNS = ["peer_price", "price_ratio", "price_rank"]


def to_score_shape(df: DataFrame, behaviour_cols: list[str]) -> DataFrame:
    """Drop what is not known before the customer acts."""
    return df.drop(*behaviour_cols)


def split_by_time(df: DataFrame, ts: str, cutoff: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows before ``cutoff``, rows from it on, and rows without a time.

    Every row is in one of the three; all filters reach the scan.
    """
    at = F.lit(cutoff).cast(df.schema[ts].dataType)
    return df.filter(F.col(ts) < at), df.filter(F.col(ts) >= at), df.filter(F.col(ts).isNull())


def attach_items(
    df: DataFrame, items: DataFrame, on: str, row_id: list[str] | None = None, unique: bool = False
) -> DataFrame:
    """Add the attributes of the item, NULL if it is not listed.

    An item listed twice is an error, since it would multiply rows. ``unique`` spares the
    count where that has been checked already.
    """
    if not unique:
        refuse_repeated(items, on)
    return lookup_join(df, items.filter(F.col(on).isNotNull()), [on], row_id=row_id)


def refuse_repeated(items: DataFrame, on: str) -> None:
    """Fail if a key is in more than one row; NULL is no key."""
    twice = items.filter(F.col(on).isNotNull()).groupBy(on).count().filter("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"listed more than once in {on}: {[r[0] for r in twice]}")


def calendar(df: DataFrame, ts: str, origin: str) -> DataFrame:
    """Add ``day``, ``day_of_week`` (Sunday 1), ``month`` and ``day_number``, days since ``origin``."""
    refuse(df, ["day", "day_of_week", "month", "day_number"], "calendar")
    day = day_of(ts)
    return df.withColumns(
        {
            "day": day,
            "day_of_week": F.dayofweek(day),
            "month": F.month(day),
            "day_number": F.date_diff(day, F.lit(origin).cast("date")),
        }
    )


def daily_sums(
    df: DataFrame,
    key: str,
    ts: str,
    measures: dict[str, Column],
    extra: list[Column] | None = None,
) -> DataFrame:
    """Per key and day (``_day``): ``contacts``, the sum of each measure, ``extra`` aggregates.

    The one pass over the contacts that history needs. It has one row per day however
    busy a key is, and partial sums are made before the shuffle. Rows without a time are
    summed with ``_day`` NULL, which history leaves out.
    """
    return df.groupBy(key, day_of(ts).alias("_day")).agg(
        F.count(F.lit(1)).alias("contacts"),
        *[F.coalesce(F.sum(expr), F.lit(0)).alias(name) for name, expr in measures.items()],
        *(extra or []),
    )


def history_names(measures: Iterable[str], prefix: str) -> list[str]:
    """Columns of the sums that history adds."""
    return [f"{prefix}_{m}_before" for m in ("contacts", *measures)]


def history_table(
    daily: DataFrame,
    key: str,
    measures: Iterable[str],
    prefix: str,
    extra: Iterable[Column] = (),
) -> DataFrame:
    """From ``daily_sums``: per key and day the sums over the key's earlier days.

    ``extra`` columns may use windows over ``key``, which cost no further shuffle.
    """
    # the row without a day comes last, so it is earlier than none
    by_day = W.partitionBy(key).orderBy(F.col("_day").asc_nulls_last())
    earlier = by_day.rowsBetween(W.unboundedPreceding, -1)
    sums = [
        F.when(F.col("_day").isNotNull(), F.coalesce(F.sum(m).over(earlier), F.lit(0))).alias(name)
        for m, name in zip(("contacts", *measures), history_names(measures, prefix))
    ]
    last = F.lag("_day").over(by_day)
    return daily.select(
        key,
        "_day",
        F.col("contacts").alias("_rows"),
        *sums,
        F.date_diff("_day", last).alias(f"{prefix}_days_since"),
        *extra,
    )


def history_join(
    df: DataFrame, table: DataFrame, key: str, ts: str, row_id: list[str] | None = None
) -> DataFrame:
    """Add the columns of a staged ``history_table`` to the rows it was made of."""
    rows = df.withColumn("_day", day_of(ts))
    return lookup_join(rows, table, [key, "_day"], "_rows", row_id=row_id).drop("_day")


def history(
    df: DataFrame,
    key: str,
    ts: str,
    measures: dict[str, Column],
    prefix: str,
    row_id: list[str] | None = None,
) -> DataFrame:
    """Add sums over the earlier days of the row's ``key``, and days since the last one.

    Columns ``<prefix>_contacts_before``, ``<prefix>_<measure>_before`` (0 without an
    earlier day) and ``<prefix>_days_since`` (NULL without one). Rows without a time have
    NULL in all, and are in nobody's history. Measures should be whole numbers or decimals
    (``summable``), whose sums do not depend on order.
    """
    table = stage(history_table(daily_sums(df, key, ts, measures), key, measures, prefix))
    return history_join(df, table, key, ts, row_id)


def history_totals(
    daily: DataFrame,
    key: str,
    measures: Iterable[str],
    prefix: str,
    extra: Iterable[Column] = (),
) -> DataFrame:
    """From ``daily_sums``: per key the sums over all days and the last day, for later rows.

    ``extra`` are further aggregates.
    """
    dated = F.col("_day").isNotNull()
    return daily.groupBy(key).agg(
        *[
            F.sum(F.when(dated, F.col(m))).alias(name)
            for m, name in zip(("contacts", *measures), history_names(measures, prefix))
        ],
        F.max("_day").alias("_last"),
        *extra,
    )


def history_apply(
    df: DataFrame,
    totals: DataFrame,
    key: str,
    ts: str,
    measures: Iterable[str],
    prefix: str,
    row_id: list[str] | None = None,
) -> DataFrame:
    """Add staged ``history_totals`` to later rows, in the columns that ``history`` gives.

    The key stays as it is, of any type; a NULL key has the history of NULL keys.
    """
    joined = lookup_join(df, totals, [key], row_id=row_id)
    dated = day_of(ts).isNotNull()
    sums = {
        c: F.when(dated, F.coalesce(F.col(c), F.lit(0).cast(totals.schema[c].dataType)))
        for c in history_names(measures, prefix)
    }
    return joined.withColumns(
        sums | {f"{prefix}_days_since": F.date_diff(day_of(ts), F.col("_last"))}
    ).drop("_last")


def price_vs_peers(
    items: DataFrame, group: str, price: str, row_id: list[str] | None = None
) -> DataFrame:
    """Add ``peer_price`` (mean of the group), ``price_ratio`` and ``price_rank`` (0 to 1).

    A group may hold most items, so none is gathered in one task: items are counted
    per group and price, prices cut into ranges at common quantiles, and the rank is
    the count in lower ranges plus the count below within the range. Where the cuts
    fall affects the size of tasks, not the result. Money adds up as decimals, as in ``exact_sum``.
    """
    refuse(items, PEER_COLUMNS, "price_vs_peers")
    found = _among_peers(items, group, price, row_id, F.lit(1).cast("long"))
    alone = F.coalesce(F.col("_items") <= 1, F.lit(False))
    rank = F.when(alone, F.lit(0.0)).otherwise(F.col("_under").cast("double") / (F.col("_items") - 1))
    return found.withColumn("price_rank", rank).drop("_under", "_items")


def prices_at(items: DataFrame, row: str, group: str, price: str, factors: list[float]) -> DataFrame:
    """Each item at each multiple of its price, its peers staying as they are.

    Columns ``row, price_factor, price, peer_price, price_ratio, price_rank``: the mean of the group is that of
    the listed prices, and the rank the share of the item's peers that are cheaper than its
    new price, so factor 1 gives what ``price_vs_peers`` gives. New prices are counted with a
    weight of 0 among the listed ones, in the same ranges. ``row`` is unique; items without a
    price have none at any factor.
    """
    if not factors or len(set(factors)) < len(factors) or min(factors) <= 0:
        raise ValueError("different factors above 0")
    own = items.select(F.col(row).alias("_row"), F.col(group).alias("_group_of"), F.col(price).cast("double").alias("_listed"))
    steps = [F.struct(F.lit(float(f)).alias("price_factor"), F.lit(0).cast("long").alias("_weight")) for f in factors]
    listed = F.struct(F.lit(1.0).alias("price_factor"), F.lit(1).cast("long").alias("_weight"))
    cases = own.select("*", F.explode(F.array(listed, *steps)).alias("_step")).select("*", "_step.*").drop("_step")
    cases = cases.withColumn("_price", F.col("_listed") * F.col("price_factor"))
    found = _among_peers(cases, "_group_of", "_price", ["_row", "price_factor"], F.col("_weight")).filter("_weight = 0")
    others = F.col("_under") - F.when(F.col("_listed") < F.col("_price"), 1).otherwise(0)
    rank = F.when(F.col("_items") > 1, others.cast("double") / (F.col("_items") - 1)).when(F.col("_items") <= 1, F.lit(0.0))
    return found.select(
        F.col("_row").alias(row), "price_factor", F.col("_price").alias("price"), "peer_price", "price_ratio", rank.alias("price_rank")
    )


def _among_peers(items: DataFrame, group: str, price: str, row_id: list[str] | None, weight: Column) -> DataFrame:
    """Items with ``peer_price``, ``price_ratio``, the weight of lower prices ``_under`` and of the group ``_items``."""
    keys = [group, price]
    counts = stage(
        items.filter(F.col(price).isNotNull())
        .groupBy(*keys)
        .agg(F.sum(weight).alias("_rows"), F.count(F.lit(1)).alias("_there"))
    )
    ranges = min(slices_of(items), round(1 / QUANTILE_ERROR))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(counts.approxQuantile(price, shares, QUANTILE_ERROR)))
    splits = [float("-inf"), *(cuts or [0.0]), float("inf")]
    ranged = Bucketizer(
        splits=splits, inputCol=price, outputCol="_range", handleInvalid="keep"
    ).transform(counts)
    money = F.col(price).cast("double") * F.col("_rows")
    coarse, fine = summable(money), fine_part(money)
    in_range = ranged.groupBy(group, "_range").agg(
        F.sum("_rows").alias("_n"), F.sum(coarse).alias("_money"), F.sum(fine).alias("_rest")
    )
    # at most one row per cut and group
    by_range = W.partitionBy(group).orderBy("_range")
    whole = W.partitionBy(group)
    lower = in_range.select(
        group,
        "_range",
        F.coalesce(
            F.sum("_n").over(by_range.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_lower"),
        F.sum("_n").over(whole).alias("_items"),
        (F.sum("_money").over(whole).cast("double") + F.sum("_rest").over(whole).cast("double")).alias("_sum"),
    )
    below = W.partitionBy(group, "_range").orderBy(price).rowsBetween(W.unboundedPreceding, -1)
    within = ranged.withColumn("_below", F.coalesce(F.sum("_rows").over(below), F.lit(0)))
    lower_right = lower.withColumnRenamed(group, "_group").withColumnRenamed("_range", "_r")
    mean = F.try_divide(F.col("_sum"), F.col("_items"))
    table = stage(
        within.join(
            lower_right,
            F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_r")),
        ).select(
            *keys,
            "_there",
            mean.alias("peer_price"),
            F.try_divide(F.col(price), mean).alias("price_ratio"),
            (F.col("_lower") + F.col("_below")).alias("_under"),
            "_items",
        )
    )
    return lookup_join(items, table, keys, "_there", row_id=row_id)


def price_change(df: DataFrame, item: str, ts: str, revenue: Column, quantity: Column) -> DataFrame:
    """Unit price per item and day, and its change since the item's previous day.

    Result: one row per item and day with ``price``, ``previous_price``,
    ``price_difference``, ``price_ratio``. Sales are summed per item and day before the
    window, which then holds one row per day.
    """
    daily = df.groupBy(item, day_of(ts).alias("day")).agg(
        F.try_divide(exact_sum(revenue), exact_sum(quantity)).alias("price")
    )
    previous = F.lag("price").over(W.partitionBy(item).orderBy("day"))
    return daily.withColumn("previous_price", previous).withColumns(
        {
            "price_difference": F.col("price") - F.col("previous_price"),
            "price_ratio": F.try_divide("price", "previous_price"),
        }
    )
