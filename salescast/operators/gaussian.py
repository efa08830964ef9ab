"""Missing values from numeric attributes: Naive Bayes with a normal distribution per class."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescast.functions.columns import exact_sum, refuse
from salescast.operators.fill import SCORE_DIGITS
from salescast.operators.joins import lookup_join
from salescast.sources.staging import stage

BLOCK = 4096  # classes in one array
SMOOTHING = 1e-9  # of the largest variance of an attribute


def moments(df: DataFrame, target: str, numbers: list[str]) -> DataFrame:
    """Per class ``cls``: its rows ``n``, and per attribute ``n_i, s_i, q_i``: count, sum, sum of squares.

    Rows without the target do not count, nor an attribute where it is NULL or NaN. One
    aggregate, counted up before the shuffle; sums do not depend on the order of the rows.
    Moments of two tables are brought together by ``merged``.
    """
    if not numbers:
        raise ValueError("at least one attribute")
    sums = []
    for i, name in enumerate(numbers):
        x = F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
        sums += [
            F.count(x).alias(f"n_{i}"),
            F.coalesce(exact_sum(x), F.lit(0.0)).alias(f"s_{i}"),
            F.coalesce(exact_sum(x * x), F.lit(0.0)).alias(f"q_{i}"),
        ]
    known = df.filter(F.col(target).isNotNull())
    return stage(known.groupBy(F.col(target).alias("cls")).agg(F.count(F.lit(1)).alias("n"), *sums))


def merged(*tables: DataFrame) -> DataFrame:
    """Moments of all the rows that the given moments were made of, for data that come in parts."""
    both = tables[0]
    for table in tables[1:]:
        both = both.unionByName(table)
    counts = [c for c in both.columns if c.startswith("n")]
    sums = [c for c in both.columns if c[0] in "sq"]
    return stage(both.groupBy("cls").agg(*[F.sum(c).alias(c) for c in counts], *[exact_sum(F.col(c)).alias(c) for c in sums]))


def _variance(n: Column, s: Column, q: Column) -> Column:
    mean = F.try_divide(s, n)
    return F.greatest(F.try_divide(q, n) - mean * mean, F.lit(0.0))


def distributions(table: DataFrame, n_attrs: int) -> DataFrame:
    """Per class ``log_prior`` and per attribute ``mean_i`` and ``var_i``, NULL if the class has no value.

    A thousand-millionth of the largest variance of an attribute over all rows is added to
    each variance, so that a class whose values are all alike has one.
    """
    whole = [F.struct(*[F.sum(f"{c}_{i}").alias(c) for c in "nsq"]) for i in range(n_attrs)]
    row = table.agg(F.sum("n").alias("n"), *[w.alias(f"a{i}") for i, w in enumerate(whole)])
    spread = [_variance(F.col(f"a{i}.n"), F.col(f"a{i}.s"), F.col(f"a{i}.q")) for i in range(n_attrs)]
    largest = row.select(F.coalesce(F.array_max(F.array(*spread)), F.lit(0.0))).scalar()
    columns = []
    for i in range(n_attrs):
        n, s, q = (F.col(f"{c}_{i}") for c in "nsq")
        added = F.when(largest > 0, largest * SMOOTHING).otherwise(F.lit(SMOOTHING))
        columns += [F.try_divide(s, n).alias(f"mean_{i}"), (_variance(n, s, q) + added).alias(f"var_{i}")]
    prior = F.log(F.col("n").cast("double")) - F.log(row.select(F.col("n").cast("double")).scalar())
    return table.select("cls", prior.alias("log_prior"), *columns)


def log_density(x: Column, mean: Column, variance: Column) -> Column:
    return -0.5 * (F.log(F.lit(2 * math.pi) * variance) + (x - mean) * (x - mean) / variance)


def gaussian_classes(df: DataFrame, table: DataFrame, numbers: list[str], row: str, block: int = BLOCK) -> DataFrame:
    """The likeliest class of each row of ``df``: columns ``row, cls, score``.

    The score is the log prior and the log densities of the attributes that are there, rounded to
    nine places; the smaller class wins a tie. A class that has never had a value of an attribute
    that the row has cannot win unless no class has one. Classes are put into arrays of
    ``block``, each row is scored against an array in one expression, and the best of the arrays
    is one more minimum, so neither classes nor rows are multiplied by each other.
    """
    n = len(numbers)
    known = distributions(table, n).withColumn("_block", F.pmod(F.xxhash64("cls"), F.ceil(F.lit(table.count()) / F.lit(block))))
    arrays = stage(known.groupBy("_block").agg(F.collect_list(F.struct(*[c for c in known.columns if c != "_block"])).alias("_classes")))
    blocks = [r["_block"] for r in arrays.select("_block").collect()]
    values = [F.nanvl(F.col(a).cast("double"), F.lit(None).cast("double")).alias(f"_x{i}") for i, a in enumerate(numbers)]
    rows = df.select(F.col(row).alias("_id"), *values)
    rows = rows.withColumn("_block", F.explode(F.array(*[F.lit(b) for b in blocks]).cast("array<long>")))

    def scored(c: Column) -> Column:
        score = c["log_prior"]
        for i in range(n):
            x, never = F.col(f"_x{i}"), F.lit(float("-inf"))
            density = F.coalesce(log_density(x, c[f"mean_{i}"], c[f"var_{i}"]), never)
            score = score + F.when(x.isNull(), F.lit(0.0)).otherwise(density)
        return F.struct((-F.round(score, SCORE_DIGITS)).alias("neg"), c["cls"].alias("cls"))

    best = F.array_min(F.transform("_classes", scored))
    small = F.broadcast(arrays) if len(blocks) == 1 else arrays
    found = rows.join(small, "_block").select("_id", best.alias("_win"))
    if len(blocks) > 1:
        found = found.groupBy("_id").agg(F.min("_win").alias("_win"))
    return found.select(F.col("_id").alias(row), F.col("_win.cls").alias("cls"), (-F.col("_win.neg")).alias("score"))


def gaussian_fill(df: DataFrame, target: str, numbers: list[str], row: str, table: DataFrame | None = None) -> DataFrame:
    """Fill ``target`` where it is NULL from numeric attributes, and add ``<target>_was_null``.

    ``row`` is unique. ``table`` are ``moments``, of ``df`` itself if not given. Where no row has the
    target, nothing is filled.
    """
    refuse(df, ["_fill", f"{target}_was_null"], "gaussian_fill")
    table = moments(df, target, numbers) if table is None else table
    missing = F.col(target).isNull()
    filled = df.withColumn("_fill", F.lit(None).cast(df.schema[target].dataType))
    if not table.isEmpty():
        best = gaussian_classes(df.filter(missing), table, numbers, row)
        filled = lookup_join(df, stage(best.select(row, F.col("cls").alias("_fill"))), [row], where=missing, row_id=[row])
    return filled.withColumns({f"{target}_was_null": missing, target: F.coalesce(F.col(target), F.col("_fill"))}).drop("_fill")
