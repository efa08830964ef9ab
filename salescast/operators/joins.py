"""Joins between many rows and one row per key, safe when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salescast.sources.staging import stage

MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
CELL_BYTES = 16


def fits_broadcast(table: DataFrame) -> bool:
    """Measure ``table``: few enough rows, and few enough bytes with its texts counted.

    Meant for staged or source tables, where this reads the text columns only. A table
    with nested columns other than arrays of numbers cannot be measured, and does not fit.
    """
    lengths = F.lit(CELL_BYTES * len(table.columns))
    for field in table.schema.fields:
        kind = field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            lengths = lengths + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            lengths = lengths + F.coalesce(F.size(field.name), F.lit(0)) * CELL_BYTES
        elif not isinstance(kind, T.AtomicType):
            return False
    size = table.agg(F.count(F.lit(1)).alias("n"), F.sum(lengths.cast("long")).alias("b")).first()
    return size["n"] <= MAX_BROADCAST_ROWS and (size["b"] or 0) <= MAX_BROADCAST_BYTES


def slices_of(df: DataFrame) -> int:
    """How finely to cut hot keys: into pieces that are small next to a shuffle partition."""
    return 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def heavy_keys(table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Keys with more than ``1/slices`` of the weight, and the number of salts of each.

    At most ``slices`` keys can be that heavy, whatever the data, so the result may be
    broadcast; the salts of all of them together number at most twice as many.
    """
    limit = table.agg(F.sum(weight) / F.lit(slices_of(table))).scalar()
    return table.filter(F.col(weight) > limit).select(
        *keys, F.ceil(F.col(weight) / limit).cast("int").alias("_salts")
    )


def _renamed(table: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    names = [f"_right_{k}" for k in keys]
    return table.withColumnsRenamed(dict(zip(keys, names))), names


def _same(left: list[str], right: list[str]) -> Column:
    condition = F.lit(True)
    for a, b in zip(left, right):
        condition = condition & F.col(a).eqNullSafe(F.col(b))
    return condition


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    heavy: DataFrame,
    how: str = "left",
    where: Column | None = None,
    row_id: list[str] | None = None,
) -> DataFrame:
    """Shuffle join on null-safe ``keys`` that spreads the rows of heavy keys.

    A row of a heavy key gets one of the key's salts, chosen by a hash of ``row_id``
    (all columns if not given), so a repeated task chooses the same. The right side
    repeats heavy keys once per salt. With ``where``, left rows outside it match
    nothing and get a salt of their own, so they pile up nowhere.
    """
    spread = F.xxhash64(*(row_id or left.columns))
    hot, hot_keys = _renamed(heavy, keys)
    salt = F.pmod(spread, F.coalesce(F.col("_salts"), F.lit(1)))
    if where is not None:
        # beyond any salt of the right side
        salt = F.when(where, salt).otherwise(-1 - F.pmod(spread, F.lit(slices_of(left))))
    salted_left = (
        left.join(F.broadcast(hot), _same(keys, hot_keys), "left")
        .withColumn("_salt", salt.cast("long"))
        .drop("_salts", *hot_keys)
    )
    last = F.coalesce(F.col("_salts"), F.lit(1)).cast("long") - 1
    salted_right = (
        right.join(F.broadcast(hot), _same(keys, hot_keys), "left")
        .withColumn("_right_salt", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .drop("_salts", *hot_keys)
    )
    salted_right, names = _renamed(salted_right, keys)
    condition = _same(keys, names) & (F.col("_salt") == F.col("_right_salt"))
    return salted_left.join(salted_right, condition, how).drop("_salt", "_right_salt", *names)


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    weight: str | None = None,
    where: Column | None = None,
    row_id: list[str] | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Add the columns of ``table`` (one row per key, NULL being a key) to ``rows``.

    A table measured small is broadcast, and ``rows`` are not shuffled at all. A larger
    one is joined by shuffle, heavy keys salted. ``weight`` names the column of
    ``table`` holding the rows per key, and is not passed on; if there is none, the
    rows are counted. ``small`` spares the measuring where ``fits_broadcast`` has
    already answered for this table or one that contains it.
    """
    values = table if weight is None else table.drop(weight)
    twice = set(rows.columns) & set(values.columns) - set(keys)
    if twice:
        raise ValueError(f"in the rows and in the table to look up: {sorted(twice)}")
    if fits_broadcast(table) if small is None else small:
        right, names = _renamed(values, keys)
        condition = _same(keys, names)
        if where is not None:
            condition = where & condition
        return rows.join(F.broadcast(right), condition, "left").drop(*names)
    if weight is None:
        counted = rows if where is None else rows.filter(where)
        sizes = stage(counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")))
        heavy = heavy_keys(sizes, keys, "_rows")
    else:
        heavy = heavy_keys(table, keys, weight)
    return salted_join(rows, values, keys, heavy, "left", where, row_id)
