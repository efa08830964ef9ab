"""Train on behaviour and item files, score the third file, write the results.

The settings are a JSON file: ``train``, ``items`` and ``score`` name CSV files or
folders, ``out`` a new folder, ``schemas`` gives the columns of the three as
``name type, ...``, ``sep`` the separator, ``options`` further options of Spark's CSV
reader, ``roles`` the fields of ``Roles``, and ``trees`` optional parameters of the
layers. With ``holdout``, a time, a model of the rows before it is evaluated on those
from it on, before the model for scoring is fitted on all.

Lines that cannot be read are kept apart under ``rejected`` and counted; with
``"bad_lines": "fail"`` they fail the job.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salescast.operators.evaluate import forecast
from salescast.operators.features import split_by_time
from salescast.plans.forecaster import Roles, fit_forecaster
from salescast.sources import read_table, stage, write_scores
from salescast.sources.tables import bad_rows, sound_rows

CORRUPT = "_line"


def run(spark: SparkSession, settings: dict[str, Any]) -> None:
    out, strict = settings["out"], settings.get("bad_lines") == "fail"
    rejected = []

    def read(name: str) -> DataFrame:
        """The sound rows, parsed once; the others go to their folder."""
        schema = T.StructType.fromDDL(settings["schemas"][name])
        corrupt = None if strict else CORRUPT
        rows = read_table(
            spark, settings[name], schema, corrupt, settings.get("sep", ","), settings.get("options")
        )
        if strict:
            return stage(rows)
        rows = stage(rows)
        write_scores(bad_rows(rows, CORRUPT), f"{out}/rejected/{name}")
        counted = spark.read.parquet(f"{out}/rejected/{name}").agg(
            F.lit(name).alias("file"), F.count(F.lit(1)).alias("n_rejected")
        )
        rejected.append(counted)
        return sound_rows(rows, CORRUPT)

    roles, trees = Roles(**settings["roles"]), settings.get("trees", {})
    train, items, score = read("train"), read("items"), read("score")
    if rejected:
        write_scores(reduce(DataFrame.unionByName, rejected), f"{out}/rejected/counts")
    if settings.get("holdout"):
        before, after, untimed = split_by_time(train, roles.ts, settings["holdout"])
        tried = fit_forecaster(before, items, roles, **trees).evaluate(after)
        n_untimed = untimed.agg(F.count(F.lit(1)).alias("n_untimed"))
        write_scores(tried.crossJoin(F.broadcast(n_untimed)), f"{out}/accuracy")
    fitted = fit_forecaster(train, items, roles, **trees)
    fitted.save(f"{out}/model")
    write_scores(fitted.score(score), f"{out}/scores")
    scores = spark.read.parquet(f"{out}/scores")
    price = roles.offer or roles.price
    write_scores(forecast(scores, [roles.item], price=price), f"{out}/forecast")
    importance = fitted.importance("buy").unionByName(fitted.importance("amount"))
    write_scores(importance, f"{out}/importance")


def main(path: str) -> None:
    spark = SparkSession.builder.appName("salescast").getOrCreate()
    with open(path, encoding="utf-8") as file:
        run(spark, json.load(file))
    spark.stop()
