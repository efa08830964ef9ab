"""Importance by permutation: how much worse a score gets where one feature is of another row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salescast.functions.columns import exact_sum, refuse
from salescast.operators.joins import lookup_join
from salescast.sources.staging import stage

RANGE = 3  # hexadecimal digits of a hash that name its range


def shuffled_place(df: DataFrame, row_id: str, seed: str, out: str) -> DataFrame:
    """Add each row's place, from 1 on, in an order that ``seed`` draws; gapless, the same on every run.

    The order is that of a hash of the row's id, cut into 4,096 ranges of about equal size:
    places within a range, and the rows of the ranges before it, so no task holds all rows.
    ``row_id`` is unique and not NULL.
    """
    refuse(df, [out, "_hash", "_range", "_before"], "shuffled_place")
    hashed = df.withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string"))))
    hashed = hashed.withColumn("_range", F.substring("_hash", 1, RANGE))
    sizes = hashed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = hashed.withColumn(out, F.row_number().over(W.partitionBy("_range").orderBy("_hash")))
    placed = lookup_join(placed, before, ["_range"], row_id=[row_id], small=True)
    return placed.withColumn(out, F.col(out) + F.col("_before")).drop("_hash", "_range", "_before")


def permutation_importance(
    df: DataFrame, features: list[str], score: Callable[[DataFrame], DataFrame], loss: Column, row_id: str, seed: int = 42
) -> DataFrame:
    """``feature, n_rows, base_loss, loss, importance, rank``: what the mean loss rises by without each feature.

    ``score`` adds the columns that ``loss`` reads, row by row. Each row is paired with another one, the
    row of the same place in a second drawn order, and scored as it is and then once for each
    feature with that feature's value of the other row: one join for all features. Losses are
    added up exactly, so a rerun gives the same. Rows whose loss is NULL do not count. Ties in
    importance go by name.
    """
    refuse(df, ["_place", "_other", "_feature", *[f"_with_{f}" for f in features]], "permutation_importance")
    rows = stage(shuffled_place(df, row_id, f"{seed}:rows", "_place"))
    others = shuffled_place(df.select(row_id, *features), row_id, f"{seed}:others", "_place")
    others = others.select("_place", *[F.col(f).alias(f"_with_{f}") for f in features])
    paired = rows.join(others, "_place")
    cases = paired.withColumn("_feature", F.explode(F.array(*[F.lit(i) for i in range(-1, len(features))])))
    changed = {f: F.when(F.col("_feature") == i, F.col(f"_with_{f}")).otherwise(F.col(f)) for i, f in enumerate(features)}
    cases = cases.withColumns(changed).drop("_place", *[f"_with_{f}" for f in features])
    scored = score(cases).select("_feature", loss.alias("_loss"))
    means = scored.groupBy("_feature").agg(
        F.count("_loss").alias("n_rows"), F.try_divide(exact_sum(F.col("_loss")), F.count("_loss")).alias("loss")
    )
    # a row per feature
    means = stage(means)
    base = means.filter("_feature < 0").select("loss").scalar()
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("_feature") + 1)
    found = means.filter("_feature >= 0").select(
        name.alias("feature"), "n_rows", base.alias("base_loss"), "loss", (F.col("loss") - base).alias("importance")
    )
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "feature")
    return found.withColumn("rank", F.row_number().over(order))
