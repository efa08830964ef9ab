"""Arrow batches bounded by bytes, for rows that hold whole texts."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
MOST = 4 << 20


def bound_batches(spark: SparkSession, most: int = MOST) -> None:
    """From now on no Arrow batch of the session has more than some ``most`` bytes.

    Batches go by the number of rows otherwise, and ten thousand rows with one or two texts
    each may fill a worker's memory. A smaller bound that is set already stays.
    """
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get(SETTING).lower()).groups()
    now = int(number) << 10 * " kmgt".index(unit or " ")
    if now > most:
        spark.conf.set(SETTING, str(most))
