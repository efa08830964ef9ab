"""Fitted statistics are written once and read many times."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, taken from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            # local-cluster has executors of their own
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="salescast-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


#: Spark's setting: shuffle files go when the query that wrote them ends
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries run inside leave no shuffle files; otherwise these stay until the driver collects its garbage."""
    before = spark.conf.get(CLEANED, "false")
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANED, before)


def stage(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written.

    ``options`` are those of Spark's Parquet writer, such as ``compression``.

    Used for tables of one row per key, and for the training rows, which the trees read
    many times. The lineage ends here, so a lost executor costs a re-read, and Spark
    plans later joins with the true size. Nothing reads the shuffles of the write again, so
    their files are removed when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
