"""Likelihood encoding: a nominal value becomes the smoothed mean of the target."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from salescast.functions.columns import exact_sum, fold_of, smoothed, summable
from salescast.operators.joins import lookup_join
from salescast.sources.staging import stage

#: of exact label sums, so that a dozen folds add up without loss
EXACT = "decimal(25,12)"


def likelihood_fit(
    df: DataFrame, keys: list[str], label: str, m: float = 20.0, out: str = "likelihood"
) -> DataFrame:
    """One row per key: ``n_rows``, labelled ``n``, label sum ``s`` and the encoding.

    The rows are read once: the overall mean comes from the staged sums per key.
    """
    y = F.col(label).cast("double")
    counts = stage(
        df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count(y).alias("n"),
            F.coalesce(exact_sum(y), F.lit(0.0)).alias("s"),
        )
    )
    return counts.withColumn(out, smoothed(F.col("s"), F.col("n"), likelihood_prior(counts), m))


def likelihood_targets(
    df: DataFrame, keys: list[str], targets: dict[str, Column], m: float = 20.0
) -> DataFrame:
    """Encodings by several targets from one pass: ``n_rows``, and per target ``n_``, ``s_`` and ``likelihood_<target>``.

    A target may be any number, such as an amount, NULL where it is not known; it is added
    up as decimals, so the result does not depend on the order of the rows.
    """
    sums = []
    for name, target in targets.items():
        y = summable(target.cast("double"))
        sums += [F.count(y).alias(f"n_{name}"), F.coalesce(F.sum(y), F.lit(0)).alias(f"s_{name}")]
    counts = stage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *sums))
    priors = counts.agg(
        F.array(*[F.try_divide(F.sum(f"s_{t}").cast("double"), F.sum(f"n_{t}")) for t in targets])
    ).scalar()
    columns = []
    for i, t in enumerate(targets):
        s, n = F.col(f"s_{t}").cast("double"), F.col(f"n_{t}")
        columns += [n, s.alias(f"s_{t}"), smoothed(s, n, priors[i], m).alias(f"likelihood_{t}")]
    return counts.select(*keys, "n_rows", *columns)


def likelihood_prior(stats: DataFrame) -> Column:
    """Overall mean of the label, NULL if no row has one."""
    return stats.agg(F.try_divide(exact_sum(F.col("s")), F.sum("n"))).scalar()


def likelihood_apply(
    df: DataFrame,
    stats: DataFrame,
    keys: list[str],
    prior: Column | float | None = None,
    out: str = "likelihood",
    row_id: list[str] | None = None,
) -> DataFrame:
    """Add the fitted encoding; a key not seen in the fit gets the prior.

    ``df`` may be other rows than the fit saw, so heavy keys are counted there if the
    statistics are too large to broadcast.
    """
    if prior is None:
        prior = likelihood_prior(stats)
    elif not isinstance(prior, Column):
        prior = F.lit(float(prior))
    joined = lookup_join(df, stats.select(*keys, out), keys, row_id=row_id)
    return joined.withColumn(out, F.coalesce(F.col(out), prior))


def fold_columns(
    label: str | Column, fold: str, n_folds: int = 5, tag: str = "", exact: bool = False
) -> list[Column]:
    """Aggregates ``n_rows``, and labelled rows ``n0..`` and label sums ``s0..`` by fold.

    ``fold`` is a column of whole numbers, taken modulo ``n_folds``. One aggregate
    serves all folds, and several targets, told apart by a ``tag`` behind the letter.
    ``exact`` adds up decimals, for targets other than 0 and 1.
    """
    in_fold = fold_of(fold, n_folds)
    y = (F.col(label) if isinstance(label, str) else label).cast("double")
    y = summable(y) if exact else y
    columns = [F.count(F.lit(1)).alias("n_rows")]
    for f in range(n_folds):
        own = F.when(in_fold == f, y)
        columns += [
            F.count(own).alias(f"n{tag}{f}"),
            F.coalesce(F.sum(own), F.lit(0.0)).cast(EXACT if exact else "double").alias(f"s{tag}{f}"),
        ]
    return columns


def fold_counts(
    df: DataFrame, keys: list[str], label: str, fold: str, n_folds: int = 5
) -> DataFrame:
    """``fold_columns`` per key."""
    return df.groupBy(*keys).agg(*fold_columns(label, fold, n_folds))


def roll_up(counts: DataFrame, keys: list[str], n_folds: int = 5, tags: Iterable[str] = ("",)) -> DataFrame:
    """Counts by coarser ``keys``, added up from finer counts instead of from the rows."""
    sums = ["n_rows", *[f"{letter}{t}{f}" for t in tags for f in range(n_folds) for letter in "ns"]]
    return counts.groupBy(*keys).agg(*[F.sum(c).cast(counts.schema[c].dataType).alias(c) for c in sums])


def total(letter: str, folds: Iterable[int]) -> Column:
    """Labelled rows (``n``) or label sum (``s``) over some folds."""
    return F.expr(" + ".join([f"{letter}{f}" for f in folds] or ["0L"]))


def _samples(n_folds: int) -> list[list[int]]:
    """All folds, then for each fold the other ones."""
    every = list(range(n_folds))
    return [every] + [[o for o in every if o != f] for f in every]


def label_means(n_folds: int, tag: str = "") -> Column:
    """Aggregate of counts: array of label means, over all folds, then without each in turn."""
    means = [
        F.try_divide(F.sum(total(f"s{tag}", o)).cast("double"), F.sum(total(f"n{tag}", o)))
        for o in _samples(n_folds)
    ]
    return F.array(*means)


def encoding_columns(
    priors: Column, m: float, n_folds: int, over: WindowSpec | None = None, tag: str = ""
) -> tuple[Column, Column]:
    """The encoding over all rows, and the array of those for training, one per fold.

    A value of the array is learned from the other folds. Sums and prior of a fold add
    up the other folds (and do not subtract its own), so the label of a row has no part
    in its own value. With ``over`` the counts of a key are added up over that window.
    """

    def summed(letter: str, folds: list[int]) -> Column:
        parts = total(letter + tag, folds)
        return (parts if over is None else F.sum(parts).over(over)).cast("double")

    whole, *by_fold = [
        smoothed(summed("s", o), summed("n", o), priors[i], m)
        for i, o in enumerate(_samples(n_folds))
    ]
    return whole, F.array(*by_fold)


def encodings_from_counts(
    counts: DataFrame, keys: list[str], m: float, n_folds: int, out: str = "likelihood", tag: str = ""
) -> DataFrame:
    """``encoding_columns`` per key, named ``out`` and ``by_fold``; reads ``counts`` twice."""
    priors = counts.agg(label_means(n_folds, tag)).scalar()
    whole, by_fold = encoding_columns(priors, m, n_folds, tag=tag)
    return counts.select(*keys, "n_rows", whole.alias(out), by_fold.alias("by_fold"))


def oof_join(
    df: DataFrame,
    table: DataFrame,
    keys: list[str],
    fold: str,
    n_folds: int = 5,
    out: str = "likelihood",
    row_id: list[str] | None = None,
) -> DataFrame:
    """Give each row its fold's value from a table ``keys, n_rows, by_fold``."""
    joined = lookup_join(df, table, keys, weight="n_rows", row_id=row_id)
    return joined.withColumn(out, F.col("by_fold")[fold_of(fold, n_folds)]).drop("by_fold")


def likelihood_oof(
    df: DataFrame,
    keys: list[str],
    label: str,
    fold: str,
    m: float = 20.0,
    n_folds: int = 5,
    out: str = "likelihood",
    row_id: list[str] | None = None,
) -> DataFrame:
    """Add to each row the encoding learned from the other folds only."""
    counts = stage(fold_counts(df, keys, label, fold, n_folds))
    table = encodings_from_counts(counts, keys, m, n_folds).drop("likelihood")
    return oof_join(df, table, keys, fold, n_folds, out, row_id)
