"""The test tables in the roles of contacts, items and rows to be scored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescast.functions.columns import bucket, day_of
from salescast.operators.features import split_by_time, to_score_shape
from salescast.plans.forecaster import Roles

CUTOFF = "2024-01-25"
ORIGIN = "2024-01-01"
BEHAVIOUR = ["event_type", "value", "buy", "amount"]
KINDS = ["view", "click", "purchase"]

ROLES = Roles(
    row_id="event_id",
    user="user_id",
    item="p_partkey",
    ts="ts",
    buy="buy",
    amount="amount",
    price="p_retailprice",
    origin=ORIGIN,
    peers="p_type",
    gaps={"p_brand": ["p_type", "price_band", "size_band"]},
    nominal=[["user_id"], ["p_brand"], ["p_type"], ["p_brand", "p_type"]],
    amount_nominal=[["p_type"]],
    numeric=["p_size"],
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def all_events(spark: SparkSession, folder: str) -> DataFrame:
    """Every event, as a contact; the item key is read from the JSON text."""
    item = F.get_json_object("props", "$.k").try_cast("long")
    buy = (F.col("event_type") == "purchase").cast("int")
    return (
        table(spark, folder, "events")
        .select(
            "event_id",
            "ts",
            "user_id",
            item.alias("p_partkey"),
            "event_type",
            "value",
            buy.alias("buy"),
            F.when(buy == 1, F.col("value")).alias("amount"),
        )
    )


def all_contacts(spark: SparkSession, folder: str) -> DataFrame:
    """Views, clicks and purchases."""
    return all_events(spark, folder).filter(F.col("event_type").isin(KINDS))


def contacts(spark: SparkSession, folder: str) -> DataFrame:
    return split_by_time(all_contacts(spark, folder), "ts", CUTOFF)[0]


def later_contacts(spark: SparkSession, folder: str) -> DataFrame:
    return split_by_time(all_contacts(spark, folder), "ts", CUTOFF)[1]


def score_rows(spark: SparkSession, folder: str) -> DataFrame:
    return to_score_shape(later_contacts(spark, folder), BEHAVIOUR)


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Parts, one brand in ten missing, with the bands the brand is filled from."""
    return table(spark, folder, "part").select(
        "p_partkey",
        "p_name",
        F.when(F.col("p_partkey") % 10 != 0, F.col("p_brand")).alias("p_brand"),
        "p_type",
        "p_size",
        "p_retailprice",
        bucket(F.col("p_retailprice"), 10).alias("price_band"),
        bucket(F.col("p_size"), 10).alias("size_band"),
    )


def iso_day(ts: str = "ts"):
    return day_of(ts).cast("string").alias("day")
