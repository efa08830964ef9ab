"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescast.llm.order import in_order, sums_ahead
from salescast.operators.joins import lookup_join
from salescast.sources.staging import stage

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, cycle: Sequence[int] = (5, 2, 1), limit: int = 3) -> DataFrame:
    """Share the sum of ``size`` over the sources by weight, none above ``limit`` times its size.

    ``sources`` has one row per ``source`` with its ``size``. Weights repeat ``cycle`` in
    code-point order, NULL last. What a limited source leaves is shared again by weight
    until none is above its limit: with sources ordered by limit over weight, the limited
    ones come first, and each row can tell from the sums before it whether it is one.
    Sources of size 0 get target 0. Adds ``target`` (double).
    """
    ranked = sums_ahead(sources.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], ["one"])
    turns = F.array(*[F.lit(int(w)) for w in cycle])
    weighted = ranked.select(
        "source",
        "size",
        (F.lit(limit) * F.col("size")).alias("cap"),
        F.get(turns, F.pmod("one_ahead", F.lit(len(cycle))).cast("int")).cast("long").alias("weight"),
    )
    ratio = F.col("cap") / F.col("weight")
    placed = stage(sums_ahead(weighted, [ratio, F.col("source").asc_nulls_last()], ["cap", "weight"]))
    total = placed.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(total["size"] or 0) - F.col("cap_ahead")) / (F.lit(total["weight"] or 1) - F.col("weight_ahead"))
    free = placed.filter(F.col("cap") > level * F.col("weight"))
    shared = free.agg(F.min_by(level, F.col("cap_ahead") + F.col("weight_ahead")).alias("level")).first()["level"]
    cap = F.col("cap").cast("double")
    target = cap if shared is None else F.least(cap, F.lit(shared) * F.col("weight"))
    return placed.select("source", "size", target.alias("target"))


def mix(
    docs: DataFrame,
    size: Column,
    source: str = "source",
    order: Sequence[str] = ("doc_id",),
    cycle: Sequence[int] = (5, 2, 1),
    limit: int = 3,
    seed: int = 17,
) -> DataFrame:
    """Say how often each document is taken so that sources come near their targets.

    Each document of a source is expected ``target / source_size`` times. Documents are
    put in order of source and size (then ``order``), so a systematic sample has its fair
    part of short and of long ones. The copies expected up to a document are that rate
    times its place; one random offset per source is added, drawn from a hash of
    ``seed`` and the source's name; and the document is taken once per whole number that
    is crossed at its place, so at most ``limit`` times.

    Places come from ranges of the order, not from one task per source, so a source may
    hold any share of the rows. NULL sources are one source, NULL sizes count 0, repeated
    rows are documents of their own. An empty table gives an empty result. Returns the
    columns of ``docs`` and ``size``, ``source_size``, ``target``, ``copies``, ``taken``,
    which replace input columns of these names.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    kept = [c for c in docs.columns if c.lower() not in added]
    rows = docs.select(
        F.struct(*kept).alias("_row") if kept else F.struct(F.lit(0)).alias("_row"),
        F.col(source).cast("string").alias("_source"),
        F.coalesce(size, F.lit(0)).cast("long").alias("_size"),
        F.struct(*order).alias("_order"),
    )
    numbered = in_order(rows, [F.col("_source").asc_nulls_last(), F.col("_size"), F.col("_order")])
    parts = stage(
        numbered.groupBy("_part", "_source").agg(
            F.count(F.lit(1)).alias("n"), F.sum("_size").alias("words"), F.min("_pos").alias("first")
        )
    )
    sources = stage(
        targets(
            parts.groupBy(F.col("_source").alias("source")).agg(F.sum("words").alias("size")), cycle, limit
        ).select(F.col("source").alias("_named"), F.col("size").alias("source_size"), "target")
    )
    # one row per range and source
    earlier = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first"))
    starts = stage(
        starts.join(sources, F.col("_source").eqNullSafe(F.col("_named"))).select(
            "_part", "_source", "n", "before", "source_size", "target", rate(limit).alias("rate"),
            offset(F.col("_source"), seed).alias("offset"),
        )
    )
    found = lookup_join(numbered, starts, ["_part", "_source"], weight="n", row_id=["_part", "_pos"])
    place = F.col("before") + F.col("_pos")
    crossed = F.floor((place + 1) * F.col("rate") + F.col("offset")) - F.floor(place * F.col("rate") + F.col("offset"))
    return found.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in kept],
        F.col("_size").alias("size"),
        "source_size",
        "target",
        crossed.cast("int").alias("copies"),
        (crossed * F.col("_size")).cast("long").alias("taken"),
    )


def rate(limit: int) -> Column:
    """Expected copies of each document of a source."""
    return F.when(
        F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(limit)))
    ).otherwise(F.lit(0.0))


def offset(source: Column, seed: int) -> Column:
    """A number from 0 to below 1, fixed by ``seed`` and the source."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
