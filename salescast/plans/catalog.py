"""Every operator as a query over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescast.functions.columns import bucket, combine_layers, crossed, summable
from salescast.operators.asof import last_before, likelihood_ordered
from salescast.operators.encode import (
    likelihood_apply,
    likelihood_fit,
    likelihood_oof,
    likelihood_targets,
)
from salescast.operators.evaluate import accuracy, forecast, rolling_accuracy
from salescast.operators.features import (
    attach_items,
    calendar,
    daily_sums,
    history,
    history_apply,
    history_totals,
    price_change,
    price_vs_peers,
    prices_at,
    split_by_time,
)
from salescast.operators.fill import nb_apply, nb_fit, null_profile
from salescast.operators.gaussian import gaussian_classes, gaussian_fill, moments
from salescast.operators.layers import (
    fit_amount_layer,
    fit_buy_layer,
    score_amount_layer,
    score_buy_layer,
)
from salescast.operators.permute import permutation_importance
from salescast.operators.recent import recent_history
from salescast.operators.trees import probability, tree_sum
from salescast.plans.fixed import fixed_layers
from salescast.plans.forecaster import feature_columns, fit_forecaster, prepare_training
from salescast.plans.testbed import (
    CUTOFF,
    ORIGIN,
    ROLES,
    all_contacts,
    all_events,
    contacts,
    items,
    iso_day,
    later_contacts,
    score_rows,
    table,
)
from salescast.sources.staging import stage

ITEM_COLUMNS = ["p_partkey", "p_brand", "p_type", "p_size", "p_retailprice"]
ROW = ["event_id"]


def scan_items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_name", *ITEM_COLUMNS)


def scan_contacts(spark: SparkSession, folder: str) -> DataFrame:
    rows = all_events(spark, folder)
    return rows.select(
        "event_id", iso_day(), "user_id", "p_partkey", "event_type", "value", "buy", "amount"
    )


def scan_score_rows(spark: SparkSession, folder: str) -> DataFrame:
    return score_rows(spark, folder).select("event_id", iso_day(), "user_id", "p_partkey")


def attach(spark: SparkSession, folder: str) -> DataFrame:
    wide = attach_items(contacts(spark, folder), items(spark, folder), "p_partkey", ROW)
    return wide.select("event_id", "user_id", "buy", *ITEM_COLUMNS)


def profile(spark: SparkSession, folder: str) -> DataFrame:
    return null_profile(items(spark, folder).select("p_name", *ITEM_COLUMNS))


def likelihood_user(spark: SparkSession, folder: str) -> DataFrame:
    return likelihood_fit(contacts(spark, folder), ["user_id"], "buy")


def likelihood_oof_user(spark: SparkSession, folder: str) -> DataFrame:
    rows = contacts(spark, folder).select("event_id", "user_id", "buy")
    return likelihood_oof(rows, ["user_id"], "buy", "event_id", row_id=ROW)


def likelihood_score_rows(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["user_id", "p_partkey"]
    stats = likelihood_fit(contacts(spark, folder), keys, "buy")
    rows = score_rows(spark, folder).select("event_id", *keys)
    return likelihood_apply(rows, stats, keys, row_id=ROW)


def likelihood_crossed(spark: SparkSession, folder: str) -> DataFrame:
    pairs = items(spark, folder).select(
        "p_partkey", crossed("p_brand", "p_type").alias("brand_type")
    )
    wide = attach_items(contacts(spark, folder), pairs, "p_partkey", ROW)
    return likelihood_fit(wide, ["brand_type"], "buy")


def nb_fill_brand(spark: SparkSession, folder: str) -> DataFrame:
    parts, attrs = items(spark, folder), ["p_type", "price_band", "size_band"]
    counts = nb_fit(parts, "p_brand", attrs)
    filled = nb_apply(parts, counts, "p_brand", attrs, row_id=["p_partkey"])
    return filled.select("p_partkey", "p_brand", "p_brand_was_null")


def nb_fill_size(spark: SparkSession, folder: str) -> DataFrame:
    parts = items(spark, folder).withColumn(
        "p_size", F.when(F.col("p_partkey") % 10 != 3, F.col("p_size"))
    )
    attrs = ["p_brand", "p_type", "price_band"]
    counts = nb_fit(parts, "p_size", attrs, width=10)
    filled = nb_apply(parts, counts, "p_size", attrs, width=10, row_id=["p_partkey"])
    return filled.select("p_partkey", "p_size", "p_size_was_null")


def calendar_days(spark: SparkSession, folder: str) -> DataFrame:
    wide = calendar(all_contacts(spark, folder), "ts", ORIGIN)
    return wide.select("event_id", iso_day(), "day_of_week", "month", "day_number")


def _measures() -> dict:
    return {
        "buys": F.col("buy").cast("long"),
        "qty": F.coalesce(summable(F.col("amount")), F.lit(0)),
    }


def _history_columns(side: str) -> list:
    return [
        f"{side}_contacts_before",
        f"{side}_buys_before",
        F.col(f"{side}_qty_before").cast("double").alias(f"{side}_qty_before"),
        f"{side}_days_since",
    ]


def _history(spark: SparkSession, folder: str, side: str, key: str) -> DataFrame:
    rows = contacts(spark, folder).select("event_id", "ts", key, "buy", "amount")
    wide = history(rows, key, "ts", _measures(), side, ROW)
    return wide.select("event_id", key, *_history_columns(side))


def user_history(spark: SparkSession, folder: str) -> DataFrame:
    return _history(spark, folder, "user", "user_id")


def item_history(spark: SparkSession, folder: str) -> DataFrame:
    return _history(spark, folder, "item", "p_partkey")


def score_row_history(spark: SparkSession, folder: str) -> DataFrame:
    daily = daily_sums(contacts(spark, folder), "user_id", "ts", _measures())
    totals = stage(history_totals(daily, "user_id", _measures(), "user"))
    rows = score_rows(spark, folder).select("event_id", "ts", "user_id")
    wide = history_apply(rows, totals, "user_id", "ts", _measures(), "user", ROW)
    return wide.select("event_id", "user_id", *_history_columns("user"))


def peers(spark: SparkSession, folder: str) -> DataFrame:
    parts = items(spark, folder).select("p_partkey", "p_type", "p_retailprice")
    return price_vs_peers(parts, "p_type", "p_retailprice", ["p_partkey"])


def price_ladder(spark: SparkSession, folder: str) -> DataFrame:
    return prices_at(items(spark, folder), "p_partkey", "p_type", "p_retailprice", [0.5, 1.0, 1.25])


def changes(spark: SparkSession, folder: str) -> DataFrame:
    sales = table(spark, folder, "lineitem")
    revenue, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    daily = price_change(sales, "l_partkey", "l_shipdate", revenue, quantity)
    return daily.withColumn("day", F.col("day").cast("string"))


def last_offer(spark: SparkSession, folder: str) -> DataFrame:
    """What the item was last offered at before the contact's day, and the change since.

    Later contacts see offers of the training days only, as rows to be scored do.
    """
    value = F.sum(summable(F.col("value"))).cast("double") / F.count("value")
    offers = contacts(spark, folder).groupBy("p_partkey", F.col("ts").cast("date").alias("day")).agg(value.alias("offer"))
    rows = all_contacts(spark, folder).select("event_id", "ts", "p_partkey", "value")
    wide = last_before(rows, offers, "p_partkey", "ts", ["offer"], "last", ROW)
    return wide.select(
        "event_id", "p_partkey", "last_offer", "last_days", (F.col("value") - F.col("last_offer")).alias("offer_change")
    )


def ordered_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    rows = contacts(spark, folder).select("event_id", "ts", "user_id", "buy")
    return likelihood_ordered(rows, ["user_id"], "buy", "ts", row_id=ROW).select("event_id", "user_id", "likelihood")


def amount_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    wide = attach_items(contacts(spark, folder), items(spark, folder).select("p_partkey", "p_type"), "p_partkey", ROW)
    return likelihood_targets(wide, ["p_type"], {"buy": F.col("buy"), "amount": F.col("amount")})


def fixed_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Both layers with fixed trees, over the history and the item of each row to be scored."""
    layers = fixed_layers()
    daily = daily_sums(contacts(spark, folder), "user_id", "ts", _measures())
    totals = stage(history_totals(daily, "user_id", _measures(), "user"))
    rows = score_rows(spark, folder).select("event_id", "ts", "user_id", "p_partkey")
    wide = history_apply(rows, totals, "user_id", "ts", _measures(), "user", ROW)
    wide = attach_items(wide, items(spark, folder).select("p_partkey", "p_size", "p_retailprice"), "p_partkey", ROW)
    wide = wide.select("event_id", *[F.coalesce(F.col(f).cast("double"), F.lit(-1.0)).alias(f) for f in layers["features"]])
    scored = wide.select(
        "event_id",
        F.round(probability(tree_sum(layers["buy"], layers["features"])), 9).alias("p_buy"),
        tree_sum(layers["amount"], layers["features"]).alias("amount"),
    )
    return scored.select("*", *combine_layers("p_buy", "amount", 0.25))


def recent(spark: SparkSession, folder: str, side: str, key: str) -> DataFrame:
    """Training days only, for training rows and for rows to be scored alike."""
    daily = stage(daily_sums(contacts(spark, folder), key, "ts", _measures()))
    rows = all_contacts(spark, folder).select("event_id", "ts", key)
    wide = recent_history(rows, daily, key, "ts", _measures(), side, (7, 28), ROW)
    sums = [f"{side}_{m}_{d}d" for d in (7, 28) for m in ("contacts", "buys")]
    amounts = [F.col(f"{side}_qty_{d}d").cast("double").alias(f"{side}_qty_{d}d") for d in (7, 28)]
    return wide.select("event_id", key, *sums, *amounts)


def user_recent(spark: SparkSession, folder: str) -> DataFrame:
    return recent(spark, folder, "user", "user_id")


def item_recent(spark: SparkSession, folder: str) -> DataFrame:
    return recent(spark, folder, "item", "p_partkey")


def gaussian_brand(spark: SparkSession, folder: str) -> DataFrame:
    filled = gaussian_fill(items(spark, folder), "p_brand", ["p_size", "p_retailprice"], "p_partkey")
    return filled.select("p_partkey", "p_brand", "p_brand_was_null")


def gaussian_type(spark: SparkSession, folder: str) -> DataFrame:
    """The type that size and price of each part speak for, whatever type it has, and how much."""
    parts = items(spark, folder)
    numbers = ["p_size", "p_retailprice"]
    best = gaussian_classes(parts, moments(parts, "p_type", numbers), numbers, "p_partkey")
    return best.select("p_partkey", F.col("cls").alias("p_type"), F.round("score", 6).alias("score"))


CUTOFFS = ["2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29"]


def rolling(spark: SparkSession, folder: str) -> DataFrame:
    rows = all_contacts(spark, folder).select("user_id", "ts", "buy")
    found = rolling_accuracy(rows, ["user_id"], "buy", "ts", CUTOFFS, threshold=0.35)
    return found.withColumn("cutoff", F.col("cutoff").cast("string"))


def permuted(spark: SparkSession, folder: str) -> DataFrame:
    """Importance of what the fixed trees of the first layer see, by squared error on later contacts."""
    layers = fixed_layers()
    daily = daily_sums(contacts(spark, folder), "user_id", "ts", _measures())
    totals = stage(history_totals(daily, "user_id", _measures(), "user"))
    rows = later_contacts(spark, folder).select("event_id", "ts", "user_id", "p_partkey", "buy")
    wide = history_apply(rows, totals, "user_id", "ts", _measures(), "user", ROW)
    wide = attach_items(wide, items(spark, folder).select("p_partkey", "p_size", "p_retailprice"), "p_partkey", ROW)
    seen = [F.coalesce(F.col(f).cast("double"), F.lit(-1.0)).alias(f) for f in layers["features"]]
    p = probability(tree_sum(layers["buy"], layers["features"]))
    error = F.col("buy") - F.col("p_buy")
    found = permutation_importance(
        wide.select("event_id", "buy", *seen), layers["features"], lambda df: df.withColumn("p_buy", p), error * error, "event_id"
    )
    places = [F.round(c, 9).alias(c) for c in ("base_loss", "loss", "importance")]
    return found.select("feature", "n_rows", *places)


def split_counts(spark: SparkSession, folder: str) -> DataFrame:
    def counted(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(
            F.lit(name).alias("part"),
            F.count(F.lit(1)).alias("n_rows"),
            F.coalesce(F.sum("buy"), F.lit(0)).alias("n_buys"),
        )

    train, test, untimed = split_by_time(all_contacts(spark, folder), "ts", CUTOFF)
    parts = counted("train", train).unionByName(counted("test", test))
    return parts.unionByName(counted("untimed", untimed))


def two_layer_combine(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_discount") * 10).alias("p_buy"),
        F.col("l_quantity").alias("amount"),
    )
    return given.select("*", *combine_layers("p_buy", "amount"))


def rule_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    ruled = later_contacts(spark, folder).withColumn("guess", (F.col("value") > 50).cast("int"))
    return accuracy(ruled, "buy", "guess")


def fixed_forecast(spark: SparkSession, folder: str) -> DataFrame:
    scored = later_contacts(spark, folder).withColumn(
        "qty_expected", F.col("p_partkey") % 10 / F.lit(10.0) * F.col("value")
    )
    wide = attach_items(scored, items(spark, folder), "p_partkey", ROW)
    return forecast(wide, ["p_type"], price="p_retailprice", scale=6)


def small_peers(spark: SparkSession, folder: str) -> DataFrame:
    """Prices of a fraction of a cent."""
    parts = table(spark, folder, "part").select(
        "p_partkey", "p_type", (F.col("p_retailprice") / 1000).alias("price")
    )
    return price_vs_peers(parts, "p_type", "price", ["p_partkey"])


def small_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Unit prices from amounts of a thousandth."""
    sales = table(spark, folder, "lineitem")
    revenue, quantity = F.col("l_extendedprice") / 1000, F.col("l_quantity") / 1000
    daily = price_change(sales, "l_partkey", "l_shipdate", revenue, quantity)
    return daily.withColumn("day", F.col("day").cast("string"))


def unpriced_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """Only two thirds of the items have a price; prices are of a fraction of a cent."""
    scored = later_contacts(spark, folder).withColumn("qty_expected", F.col("value") / 8)
    priced = F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice") / 1000)
    listed = items(spark, folder).select("p_partkey", priced.alias("price"))
    return forecast(attach_items(scored, listed, "p_partkey", ROW), ["p_partkey"])


def _fitted(spark: SparkSession, folder: str):
    return fit_forecaster(contacts(spark, folder), items(spark, folder), ROLES)


def buy_layer(spark: SparkSession, folder: str) -> DataFrame:
    fitted, train = prepare_training(contacts(spark, folder), items(spark, folder), ROLES)
    model = fit_buy_layer(train, feature_columns(ROLES), "buy")
    rows = fitted.features(score_rows(spark, folder))
    scored = score_buy_layer(rows, model, feature_columns(ROLES))
    return scored.select("event_id", "p_buy", "buy_predicted")


def amount_layer(spark: SparkSession, folder: str) -> DataFrame:
    fitted, train = prepare_training(contacts(spark, folder), items(spark, folder), ROLES)
    seen = feature_columns(ROLES, "amount")
    model = fit_amount_layer(train.filter("buy = 1"), seen, "amount")
    rows = fitted.features(score_rows(spark, folder))
    scored = score_amount_layer(rows, model, seen)
    return scored.select("event_id", F.col("amount_predicted").alias("amount"))


def two_layer_scores(spark: SparkSession, folder: str) -> DataFrame:
    scored = _fitted(spark, folder).score(score_rows(spark, folder))
    amount = F.col("amount_predicted").alias("amount")
    return scored.select("event_id", "p_buy", amount, "qty_gated", "qty_expected")


def importances(spark: SparkSession, folder: str) -> DataFrame:
    fitted = _fitted(spark, folder)
    return fitted.importance("buy").unionByName(fitted.importance("amount"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_items": scan_items,
    "scan_contacts": scan_contacts,
    "scan_score_rows": scan_score_rows,
    "attach_items": attach,
    "null_profile": profile,
    "likelihood_user": likelihood_user,
    "likelihood_oof_user": likelihood_oof_user,
    "likelihood_score_rows": likelihood_score_rows,
    "likelihood_crossed": likelihood_crossed,
    "nb_fill_brand": nb_fill_brand,
    "nb_fill_size": nb_fill_size,
    "calendar": calendar_days,
    "user_history": user_history,
    "item_history": item_history,
    "score_row_history": score_row_history,
    "price_vs_peers": peers,
    "price_ladder": price_ladder,
    "price_change": changes,
    "last_offer": last_offer,
    "likelihood_ordered": ordered_likelihood,
    "likelihood_amount": amount_likelihood,
    "score_fixed_layers": fixed_scores,
    "user_recent": user_recent,
    "item_recent": item_recent,
    "gaussian_fill_brand": gaussian_brand,
    "gaussian_type": gaussian_type,
    "rolling_accuracy": rolling,
    "permutation_importance": permuted,
    "split_counts": split_counts,
    "two_layer_combine": two_layer_combine,
    "accuracy": rule_accuracy,
    "forecast": fixed_forecast,
    "forecast_unpriced": unpriced_forecast,
    "price_vs_peers_small": small_peers,
    "price_change_small": small_changes,
    "buy_layer": buy_layer,
    "amount_layer": amount_layer,
    "two_layer_scores": two_layer_scores,
    "feature_importance": importances,
}
