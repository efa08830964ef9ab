"""Scans and the sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    corrupt_col: str | None = None,
    sep: str = ",",
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Read a CSV file (or folder of files) with a header and a declared schema.

    An empty field becomes NULL. A malformed one would too, and would then be filled as
    if it were missing; so bad input either fails the job, or, with ``corrupt_col``, is
    kept as text in that column. One record per line, so large files stay splittable,
    unless ``options`` of Spark's reader say otherwise (``multiLine``, ``nullValue``,
    ``dateFormat`` and so on).
    """
    reader = spark.read.option("header", True).option("sep", sep).options(**options or {})
    if corrupt_col is None:
        return reader.schema(schema).option("mode", "FAILFAST").csv(path)
    wide = T.StructType(schema.fields + [T.StructField(corrupt_col, T.StringType())])
    return (
        reader.schema(wide)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", corrupt_col)
        .csv(path)
    )


def sound_rows(df: DataFrame, corrupt_col: str) -> DataFrame:
    """Rows that were read without error, without the column of raw text."""
    return df.filter(F.col(corrupt_col).isNull()).drop(corrupt_col)


def bad_rows(df: DataFrame, corrupt_col: str) -> DataFrame:
    """Rows that could not be read whole, as they stand in the file."""
    return df.filter(F.col(corrupt_col).isNotNull()).select(F.col(corrupt_col).alias("line"))


def write_scores(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Write scored rows as Parquet; an existing path is an error, not overwritten."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def replace_scores(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Write scored rows in place of those of the same partitions; other partitions stay.

    A second run, or one that was started again, leaves the same rows. A partition of
    which no row is left is not emptied.
    """
    if not partition_by:
        raise ValueError("without partitions there is nothing to replace singly; see write_scores")
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(path)
