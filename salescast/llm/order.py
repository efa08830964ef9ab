"""Global order without a global task: ranges, numbers within them, and sums before each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescast.sources.staging import stage

ROW_BITS = (1 << 33) - 1


def in_order(df: DataFrame, order: list[Column]) -> DataFrame:
    """Deal rows into ranges of ``order`` and number them: ``_part``, then ``_pos`` within.

    Written once, so that the numbers of a row stay the same in all later reads. Rows
    that are alike in ``order`` are spread by a seeded random number.
    """
    order = [*order, F.rand(1)]
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbers = {
        "_part": F.spark_partition_id(),
        "_pos": F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS)),
    }
    return stage(dealt.withColumns(numbers))


def sums_ahead(df: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """Add ``<column>_ahead``, the sum of the column over all rows before this one."""
    rows = in_order(df, order)
    totals = rows.groupBy("_part").agg(*[F.sum(c).alias(c) for c in columns])
    # one row per range: their number does not depend on the rows
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col("_part"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in columns]
    )
    ahead = {c: F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns}
    return (
        rows.withColumns({f"{c}_ahead": ahead[c] for c in columns})
        .join(F.broadcast(starts), "_part")
        .withColumns({f"{c}_ahead": F.col(f"{c}_ahead") + F.col(f"_{c}") for c in columns})
        .drop("_part", "_pos", *[f"_{c}" for c in columns])
    )
