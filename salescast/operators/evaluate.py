"""Results: accuracy, also over rolling origins, and summed forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescast.functions.columns import SCALE, day_of, exact_sum, smoothed, summable
from salescast.sources.staging import stage


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: ``n_rows``, ``accuracy`` and the share of the commonest label.

    Rows without a label do not count. Counted per label first, so no task sees more
    than a partial sum of a common one.
    """
    right = F.coalesce(F.col(label) == F.col(prediction), F.lit(False))
    per_label = (
        df.filter(F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("right"))
    )
    n = F.sum("n")
    return per_label.agg(
        F.coalesce(n, F.lit(0)).alias("n_rows"),
        F.try_divide(F.sum("right").cast("double"), n).alias("accuracy"),
        F.try_divide(F.max("n").cast("double"), n).alias("majority_share"),
    )


def forecast(
    df: DataFrame,
    keys: list[str],
    qty: str = "qty_expected",
    price: str = "price",
    scale: int = SCALE,
) -> DataFrame:
    """Expected quantity and revenue per key; decimal sums do not depend on their order.

    A row without a price counts in ``n_unpriced``, its quantity in ``expected_qty``, and
    adds nothing to ``expected_revenue``, which is NULL if no row has a price. Results of
    a model have digits without end; ``scale`` places of them are added up.
    """
    amount = F.col(qty).cast("double")
    money, places = amount * F.col(price).cast("double"), f"decimal(38,{scale})"
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(price).isNull()).alias("n_unpriced"),
        F.sum(amount.cast(places)).cast("double").alias("expected_qty"),
        F.sum(money.cast(places)).cast("double").alias("expected_revenue"),
    )



def rolling_accuracy(
    df: DataFrame, keys: list[str], label: str, ts: str, cutoffs: list[str], horizon: int = 7, m: float = 20.0, threshold: float = 0.5
) -> DataFrame:
    """How well the likelihood of ``keys`` foretells a 0/1 label, at each of several cutoffs (days).

    At a cutoff the likelihood is learned from all earlier days, and the ``horizon`` days from the
    cutoff on are foretold; label 1 where it is ``threshold`` or more, and the mean of all earlier
    rows for an unseen key. One row per cutoff, also without rows: ``cutoff, n_train, n_rows, accuracy,
    majority_share, brier`` (mean squared error of the likelihood, nine places).

    The rows are read once, summed per key and day; a day's sums are passed on to the cutoffs
    they belong to. Rows without a time or a label do not count. A NULL key is a key of its own.
    """
    if horizon < 1 or not cutoffs or len(set(cutoffs)) < len(cutoffs):
        raise ValueError("a day at least, and different cutoffs")
    y = summable(F.col(label).cast("double"))
    daily = stage(
        df.filter(F.col(ts).isNotNull() & F.col(label).isNotNull())
        .groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], day_of(ts).alias("_day"))
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_s"))
    )
    names = [f"_k{i}" for i in range(len(keys))]
    days = F.array(*[F.lit(c).cast("date") for c in cutoffs])
    # the cutoffs that a day is before, or within the horizon of
    uses = F.filter(days, lambda c: F.col("_day") < F.date_add(c, horizon))
    cells = daily.withColumn("_cutoff", F.explode(uses)).withColumn("_past", F.col("_day") < F.col("_cutoff"))
    sums = [F.sum(F.when(F.col("_past") == past, F.col(c))).alias(f"{c}_{name}") for past, name in ((True, "past"), (False, "next")) for c in ("_n", "_s")]
    per_key = stage(cells.groupBy("_cutoff", *names).agg(*sums))
    whole = per_key.groupBy("_cutoff").agg(F.sum("_n_past").alias("_n_all"), F.sum("_s_past").cast("double").alias("_s_all"))
    # a row per cutoff
    found = per_key.join(F.broadcast(whole), "_cutoff").fillna(0, ["_n_past", "_s_past", "_n_next", "_s_next"])
    p = smoothed(F.col("_s_past").cast("double"), F.col("_n_past"), F.try_divide(F.col("_s_all"), F.col("_n_all")), m)
    ones, n = F.col("_s_next").cast("double"), F.col("_n_next")
    right = F.when(F.col("_p") >= threshold, ones).otherwise(n - ones)
    error = (1 - F.col("_p")) * (1 - F.col("_p")) * ones + F.col("_p") * F.col("_p") * (n - ones)
    known = found.withColumn("_p", p).groupBy("_cutoff").agg(
        F.sum("_n_past").alias("n_train"),
        F.sum("_n_next").alias("n_rows"),
        F.sum(F.when(F.col("_p").isNotNull(), right)).alias("_right"),
        F.sum(F.col("_s_next")).cast("double").alias("_ones"),
        exact_sum(error).alias("_error"),
    )
    every = df.sparkSession.range(1).select(F.explode(days).alias("_cutoff")).join(F.broadcast(known), "_cutoff", "left")
    rows, common = F.coalesce("n_rows", F.lit(0)), F.greatest(F.col("_ones"), F.col("n_rows") - F.col("_ones"))
    return every.select(
        F.col("_cutoff").alias("cutoff"),
        F.coalesce("n_train", F.lit(0)).alias("n_train"),
        rows.alias("n_rows"),
        F.try_divide("_right", "n_rows").alias("accuracy"),
        F.try_divide(common, F.col("n_rows")).alias("majority_share"),
        F.round(F.try_divide("_error", "n_rows"), 9).alias("brier"),
    )
