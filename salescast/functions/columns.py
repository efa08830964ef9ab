from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def smoothed(s: Column, n: Column, prior: Column, m: float) -> Column:
    """Mean ``s/n`` drawn towards ``prior`` with the weight of ``m`` rows."""
    if m < 0:
        raise ValueError("m must not be negative")
    return F.when(n + F.lit(m) == 0, prior).otherwise((s + m * prior) / (n + m))


SCALE = 12
FINE = 36
SLACK = 1e-9


def summable(value: Column, scale: int = SCALE) -> Column:
    """``value`` as a decimal of ``scale`` places, whose sums do not depend on the order of the rows.

    Further places are rounded away; where they matter, as in the mean of tiny prices, use
    ``exact_sum``.
    """
    return value.cast(f"decimal(38,{scale})")


def fine_part(value: Column) -> Column:
    """What ``summable`` leaves of a double, where that is more than one part in a thousand million."""
    left = value - summable(value).cast("double")
    kept = F.when(F.abs(left) > F.abs(value) * F.lit(SLACK), left).when(value.isNotNull(), F.lit(0.0))
    return kept.cast(f"decimal(38,{FINE})")


def exact_sum(value: Column) -> Column:
    """Aggregate: the sum of doubles, the same whatever the order of the rows.

    Two sums of decimals: twelve places of each value, and, of values too small for those,
    places 13 to 36. What is left of a value is below 1e-12, so a million million rows fit.
    """
    given = value.cast("double")
    return F.sum(summable(given)).cast("double") + F.sum(fine_part(given)).cast("double")


def refuse(df: DataFrame, names: Iterable[str], what: str) -> None:
    """Fail if ``df`` has columns that are about to be added."""
    taken = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if taken:
        raise ValueError(f"{what} adds columns that are there already: {sorted(taken)}")


def bucket(value: Column, width: float) -> Column:
    """Number of the interval of ``width`` that holds ``value``."""
    return F.floor(value / width).cast("long")


def crossed(*columns: str) -> Column:
    """One nominal value out of several; different inputs give different values."""
    parts = []
    for name in columns:
        text = F.regexp_replace(F.col(name).cast("string"), r"([\\|])", r"\\$1")
        parts.append(F.coalesce(text, F.lit(r"\N")))
    return F.concat_ws("|", *parts)


def day_of(ts: str) -> Column:
    return F.col(ts).cast("date")


def fold_of(number: str, n_folds: int) -> Column:
    """Fold 0 to ``n_folds - 1`` of a whole number; rows without one are in fold 0."""
    return F.pmod(F.coalesce(F.col(number), F.lit(0)), F.lit(n_folds)).cast("int")


def combine_layers(p: str, amount: str, threshold: float = 0.5) -> list[Column]:
    """``qty_gated``: the amount if buying is likely, else 0. ``qty_expected``: P x amount."""
    return [
        F.when(F.col(p) >= threshold, F.col(amount)).otherwise(F.lit(0.0)).alias("qty_gated"),
        (F.col(p) * F.col(amount)).alias("qty_expected"),
    ]
