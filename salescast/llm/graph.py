"""Connected components of links between 64-bit ids, by DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescast.sources.staging import stage


def components(links: DataFrame) -> DataFrame:
    """Every id of ``links`` (``a``, ``b``) with its ``root``, the smallest id it reaches.

    Links are rewired in turns: to the smallest neighbour of their larger end, then to
    that of their smaller ends, until each component is a star. The number of turns grows
    with the logarithm of the longest chain. A hub's links are one aggregate and one join,
    both of which may be split; nothing is gathered. No links give no rows.
    """
    edges = stage(
        links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours of u hang on the least of u and its neighbours
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.filter("u != v").distinct())
        # small star: smaller neighbours of u and u itself hang on the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionAll(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        small = stage(small)
        same = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        before = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        edges = small
        if same == before:
            break
    stars = edges.groupBy("u").agg(F.min("v").alias("root"))
    roots = stars.select("root").distinct()
    return stage(
        stars.select(F.col("u").alias("id"), "root").unionAll(roots.select(F.col("root").alias("id"), "root"))
    )
