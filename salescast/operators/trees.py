"""Tree ensembles as expressions: Spark columns, or SQL for another engine."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column
from pyspark.sql import functions as F

IF = re.compile(r"^(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")
HEAD = re.compile(r"^Tree \d+ \(weight (\S+)\):$")


def trees_of(model: GBTClassificationModel | GBTRegressionModel) -> list[dict]:
    """The trees of a fitted model: ``weight`` and ``root``.

    A node is ``{"value"}`` or ``{"feature", "at", "low", "high"}``: ``low`` where the feature's
    number has a value of at most ``at``, else ``high``, also for NaN. Categorical splits, which no model
    of this library has, are refused.
    """
    lines = [line.strip() for line in model.toDebugString.splitlines()[1:] if line.strip()]
    trees, at = [], 0

    def node() -> dict:
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict:"):
            return {"value": float(line.split(":")[1])}
        found = IF.match(line)
        if not found or found[1] != "If":
            raise ValueError(f"not a split of a number: {line}")
        low = node()
        at += 1  # its Else
        return {"feature": int(found[2]), "at": float(found[4]), "low": low, "high": node()}

    while at < len(lines):
        weight = HEAD.match(lines[at])[1]
        at += 1
        trees.append({"weight": float(weight), "root": node()})
    return trees


def _total(trees: list[dict], leaf: Callable, split: Callable, add: Callable, weigh: Callable):
    """The weighted sum of the trees, in their order, by the given ways to write each part."""

    def written(n: dict):
        if "value" in n:
            return leaf(n["value"])
        return split(n["feature"], n["at"], written(n["low"]), written(n["high"]))

    return reduce(add, [weigh(t["weight"], written(t["root"])) for t in trees])


def tree_sum(trees: list[dict], features: list[str]) -> Column:
    """What the ensemble predicts, as a column over ``features`` (numbers without NULL)."""
    x = [F.col(f).cast("double") for f in features]
    return _total(
        trees,
        F.lit,
        lambda i, at, low, high: F.when(x[i] <= at, low).otherwise(high),
        lambda a, b: a + b,
        lambda w, t: F.lit(w) * t,
    )


def tree_sql(trees: list[dict], features: list[str]) -> str:
    """The same in SQL."""
    number = lambda v: f"CAST({v!r} AS DOUBLE)"
    return _total(
        trees,
        number,
        lambda i, at, low, high: f"CASE WHEN {features[i]} <= {number(at)} THEN {low} ELSE {high} END",
        lambda a, b: f"({a} + {b})",
        lambda w, t: f"({number(w)} * {t})",
    )


def probability(total: Column) -> Column:
    """Chance of label 1 from the sum of a classifier's trees."""
    return 1.0 / (1.0 + F.exp(-2.0 * total))

