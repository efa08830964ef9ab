"""I-Match document fingerprints over several randomised lexicon subsets, JVM-side throughout."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescast.operators.joins import fits_broadcast, heavy_keys, salted_join
from salescast.sources.staging import stage

#: (parts a lexicon is dealt into, how many of them are hashed): small parts tell long
#: texts apart by degrees, large ones hold something of short texts too
SUBSETS = ((8, 8), (64, 12), (512, 16))
SLOTS = sum(taken for _, taken in SUBSETS)
#: a term counts if it is in at most this and at least that share of the documents
BAND = (0.2, 0.001)
EMPTY = "." * 8
ENOUGH = 4
#: a text has few lexicon terms if they are less than one in so many of its own
FEW = 4


def terms(text: Column) -> Column:
    """Distinct runs of letters and digits, lower case; may hold one empty string."""
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))


def lexicon(docs: DataFrame, text: str = "text", band: Sequence[float] = BAND) -> DataFrame:
    """Terms whose inverse document frequency lies in the band, as 64-bit hashes with counts.

    Counts run over all documents, NULL texts included in their number. There can be no
    more terms than the distinct terms of a mean document divided by the lower share,
    however many documents there are.
    """
    found = docs.select(F.explode(terms(F.col(text))).alias("term")).filter("term != ''")
    counts = found.groupBy(F.xxhash64("term").alias("term")).agg(F.count(F.lit(1)).alias("docs"))
    total = docs.count()
    idf = F.log(F.lit(float(max(total, 1))) / F.col("docs"))
    low, high = math.log(1 / band[0]), math.log(1 / band[1])
    return stage(counts.filter((idf >= low) & (idf <= high)))


def fingerprint(
    docs: DataFrame, known: DataFrame, texts: Sequence[str], key: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Fingerprint the columns ``texts`` of each row with the lexicon ``known``.

    The lexicon is dealt by a seeded hash into parts, three times over (``SUBSETS``). A
    document keeps its distinct terms that are in the lexicon, and has one 32-bit hash
    per subset of them. The hash of a set is the exclusive or of its terms' hashes, which
    does not depend on their order and so needs no sort. The terms of a row stay in one
    task until they are summed, so what is shuffled is one row per text.

    ``key`` names columns that tell rows apart; ``keep`` are returned with it. Of each
    text column there is a string of the same name: eight hex digits per subset, dots for
    a subset without terms; a text with few lexicon terms (``FEW``), as the copies of one
    text that is in a large share of the rows have, has ``~`` and the same subsets of all
    its terms. Texts without terms have ``~`` and zeros. Equal texts have equal strings,
    in whatever row. An empty table gives an empty result.

    One sum holds both: the upper half of its bits is of lexicon terms, the lower of all.
    """
    versions = F.array(
        *[
            F.struct(F.lit(i).alias("version"), terms(F.coalesce(F.col(t), F.lit(""))).alias("terms"))
            for i, t in enumerate(texts)
        ]
    )
    one = docs.select(*key, *keep, F.explode(versions).alias("v"))
    rows = one.select(*key, *keep, "v.version", F.explode("v.terms").alias("word"))
    rows = rows.select(*key, *keep, "version", F.when(F.col("word") != "", F.xxhash64("word")).alias("_term"))
    listed = known.select(F.col("term").alias("_term"), "docs")
    if fits_broadcast(listed):
        joined = rows.join(F.broadcast(listed.withColumn("_in", F.lit(True)).drop("docs")), "_term", "left")
    else:
        heavy = heavy_keys(listed, ["_term"], "docs")
        marked = listed.drop("docs").withColumn("_in", F.lit(True))
        joined = salted_join(rows, marked, ["_term"], heavy, "left", row_id=[*key, "version"])
    mixed = F.xxhash64("_term", F.lit(7))
    value = F.xxhash64("_term", F.lit(11)).bitwiseAND(F.lit(0xFFFFFFFF))
    both = F.when(F.col("_in"), F.shiftleft(value, 32).bitwiseOR(value)).otherwise(value)
    joined = joined.withColumns({"_value": F.when(F.col("_term").isNotNull(), both), "_lot": mixed})
    sums, at = [], 0
    for shift, (parts, taken) in zip((0, 8, 24), SUBSETS):
        lot = F.shiftrightunsigned("_lot", shift).bitwiseAND(F.lit(parts - 1))
        for part in range(taken):
            sums.append(F.bit_xor(F.when(lot == part, F.col("_value"))).alias(f"s{at}"))
            at += 1
    summed = joined.groupBy(*key, *keep, "version").agg(*sums, F.count("_in").alias("listed"), F.count("_term").alias("own"))

    def hexes(half: Callable[[str], Column]) -> Column:
        return F.concat(*[F.coalesce(F.lpad(F.lower(F.hex(half(f"s{i}"))), 8, "0"), F.lit(EMPTY)) for i in range(SLOTS)])

    def upper(name: str) -> Column:
        found = F.shiftrightunsigned(name, 32)
        return F.when(found != 0, found)

    few = F.concat(F.lit("~"), hexes(lambda name: F.col(name).bitwiseAND(F.lit(0xFFFFFFFF))))
    form = F.when(F.col("own") == 0, F.lit("~" + "0" * 16)).when(F.col("listed") * FEW < F.col("own"), few).otherwise(hexes(upper))
    shown = summed.select(*key, *keep, "version", form.alias("print"))
    return shown.groupBy(*key, *keep).agg(
        *[F.max(F.when(F.col("version") == i, F.col("print"))).alias(t) for i, t in enumerate(texts)]
    )


def likeness(a: Column, b: Column) -> Column:
    """Share of subsets with equal hashes, of those in which either text has terms.

    Taken over the smallest parts (see ``SUBSETS``) that have ``ENOUGH`` such subsets, or
    else over the largest parts, which cover the lexicon. Fingerprints of all terms (``~``)
    are compared with each other in the same way, and have nothing in common (0.0) with
    those of lexicon terms, as have texts without terms with any that has some.
    """
    def parts(text: Column) -> Column:
        first = F.when(text.startswith("~"), F.lit(2)).otherwise(F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.substring(text, 8 * i + first, F.lit(8)))

    filled = F.zip_with(
        parts(a), parts(b), lambda x, y: F.when((x != EMPTY) | (y != EMPTY), (x == y).cast("int"))
    )
    levels, at = [], 1
    for level, (_, taken) in enumerate(SUBSETS):
        levels.append(
            F.struct(F.slice(filled, at, taken).alias("same"), F.lit(1 if level == 0 else ENOUGH).alias("least"))
        )
        at += taken
    counts = F.transform(
        F.array(*levels),
        lambda v: F.struct(
            F.size(F.filter(v["same"], lambda x: x == 1)).alias("equal"),
            F.size(F.filter(v["same"], lambda x: x.isNotNull())).alias("n"),
            v["least"].alias("least"),
        ),
    )
    found = F.aggregate(
        counts, F.lit(0.0), lambda kept, v: F.when(v["n"] >= v["least"], v["equal"] / v["n"]).otherwise(kept)
    )
    apart = (a.startswith("~") != b.startswith("~")) | (F.length(a) != F.length(b))
    none = F.length(a) <= 8 * SLOTS
    return F.when(apart, F.lit(0.0)).when(none & a.startswith("~"), F.lit(1.0)).otherwise(found)


def ranges(docs: DataFrame, key: str) -> Column:
    """Number of the range of ``key``, a whole number, that a row is in; NULL is in the first.

    There are two ranges per shuffle partition, with bounds that are quantiles of the key.
    A range is found in two steps, of the square root of their number each.
    """
    count = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / count for i in range(1, count)]
    found = docs.agg(F.percentile_approx(key, shares, 100 * count)).first()[0]
    bounds = sorted(set(found or []))
    if not bounds:
        return F.lit(0)
    wide = math.isqrt(len(bounds)) + 1
    rows = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    value = F.col(key)
    outer = F.size(F.filter(F.array(*[F.lit(r[0]) for r in rows]), lambda b: b <= value))
    inner = F.size(
        F.filter(F.get(F.array(*[F.array(*map(F.lit, r)) for r in rows]), outer - 1), lambda b: b <= value)
    )
    return F.when(value.isNull() | (outer == 0), F.lit(0)).otherwise((outer - 1) * wide + inner)


def with_next(docs: DataFrame, key: str, value: str) -> DataFrame:
    """Add ``_range`` and ``_place`` in it, and ``_next``: the value of the next row by ``key``.

    NULL keys come first, rows with equal keys in order of their values, and after the
    last row comes the first. The rows are shuffled once, by range; the first value of
    each range is looked up for the last row of the range before.
    """
    at = ranges(docs, key)
    placed = docs.withColumn("_range", at)
    order = Window.partitionBy("_range").orderBy(F.col(key).asc_nulls_first(), F.col(value).asc_nulls_first())
    sorted_rows = placed.withColumns(
        {"_place": F.row_number().over(order), "_lead": F.lead(F.struct(value)).over(order)}
    )
    return _closed(sorted_rows, _first_values(placed, key, value))


def _first_values(placed: DataFrame, key: str, value: str) -> DataFrame:
    """Of each range, the first value of the range after it; one row per range."""
    least = placed.groupBy("_range").agg(F.min(key).alias("key"), F.max(F.col(key).isNull()).alias("null"))
    firsts = stage(least)
    first = F.when(F.col("null"), F.lit(None)).otherwise(F.col("key"))
    keyed = firsts.select(F.col("_range").alias("_at"), first.alias("_key"))
    found = (
        placed.join(F.broadcast(keyed), (F.col("_range") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_key")))
        .groupBy("_at")
        .agg(F.min(F.struct(F.col(value).isNotNull().alias("there"), F.col(value).alias("value"))).alias("v"))
    )
    values = stage(found.select("_at", F.struct(F.col("v.value").alias(value)).alias("_value")))
    # one row per range, and there are twice as many ranges as shuffle partitions
    everything = Window.orderBy("_at")
    whole = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("_at").over(everything), F.first("_at").over(whole))
    pairs = values.select("_at", after.alias("_after"))
    return stage(
        pairs.join(values.withColumnsRenamed({"_at": "_after"}), "_after").select("_at", F.col("_value"))
    )


def _closed(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    joined = rows.join(firsts, F.col("_range") == F.col("_at"), "left")
    value = F.coalesce("_lead", "_value")
    return joined.withColumn("_next", value[value_name(rows)]).drop("_lead", "_value", "_at")


def value_name(rows: DataFrame) -> str:
    return rows.schema["_lead"].dataType.names[0]
