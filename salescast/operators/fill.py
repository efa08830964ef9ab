"""Missing values: where they are, and filling them by Naive Bayes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescast.functions.columns import bucket, exact_sum, refuse
from salescast.operators.joins import fits_broadcast, heavy_keys, lookup_join, salted_join
from salescast.sources.staging import stage

SCORE_DIGITS = 9
MAX_ATTRS = 12
#: width of a band of classes, as a logarithm of their score
BAND = 0.25
#: bands of a value whose best class is scored first
SEEDS = 4
SLACK = 1e-6


def null_profile(df: DataFrame) -> DataFrame:
    """One row per column of ``df``: rows, NULLs, share of NULLs. One pass."""
    counted = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns],
    )
    return counted.unpivot(["n_rows"], df.columns, "column", "n_null").select(
        "column",
        "n_rows",
        "n_null",
        F.try_divide(F.col("n_null").cast("double"), F.col("n_rows")).alias("null_share"),
    )


def nb_fit(
    df: DataFrame, target: str, attrs: list[str], width: float | None = None
) -> DataFrame:
    """Counts of classes, and of attribute values within them, over rows with a target.

    Columns ``cls, attr, value, n, total``; the rows with ``attr`` NULL count the
    classes. A numeric target is cut into intervals of ``width``, which are then the
    classes, and ``total`` sums the target itself. Numeric attributes must come as
    buckets. One aggregate over all attributes, counted up before the shuffle.
    """
    if not 0 < len(attrs) <= MAX_ATTRS:
        raise ValueError(f"between 1 and {MAX_ATTRS} attributes")
    cls = F.col(target) if width is None else bucket(F.col(target), width)
    total = F.lit(0.0) if width is None else F.col(target).cast("double")
    nothing = F.lit(None).cast("string")
    cells = F.array(
        F.struct(nothing.alias("attr"), nothing.alias("value")),
        *[
            F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("value"))
            for a in attrs
        ],
    )
    return stage(
        df.filter(F.col(target).isNotNull())
        .select(cls.alias("cls"), total.alias("total"), F.explode(cells).alias("cell"))
        .filter(F.col("cell.attr").isNull() | F.col("cell.value").isNotNull())
        .groupBy("cls", "cell.attr", "cell.value")
        .agg(F.count(F.lit(1)).alias("n"), exact_sum(F.col("total")).alias("total"))
    )


def _class_table(counts: DataFrame, attrs: list[str], alpha: float) -> DataFrame:
    """Per class: log prior, and per attribute the log likelihood of an unseen value."""
    # one row per attribute: its number of values; the row of the classes has the total
    sizes = {
        r["attr"]: r
        for r in counts.groupBy("attr")
        .agg(F.count_distinct("value").alias("values"), F.sum("n").alias("n"))
        .collect()
    }
    known = sizes[None]["n"] if None in sizes else 0
    wide = counts.groupBy("cls").agg(
        F.sum(F.when(F.col("attr").isNull(), F.col("n"))).alias("n"),
        F.sum(F.when(F.col("attr").isNull(), F.col("total"))).alias("total"),
        *[
            F.coalesce(F.sum(F.when(F.col("attr") == a, F.col("n"))), F.lit(0)).alias(f"n_{i}")
            for i, a in enumerate(attrs)
        ],
    )
    unseen = []
    for i, a in enumerate(attrs):
        values = sizes[a]["values"] if a in sizes else 1
        unseen.append(F.log(alpha / (F.col(f"n_{i}") + alpha * values)).alias(f"unseen_{i}"))
    return wide.select(
        "cls",
        (F.col("total") / F.col("n")).alias("mean"),
        F.log(F.col("n") / F.lit(float(known or 1))).alias("log_prior"),
        *unseen,
    )


def _base(mask: Column, n_attrs: int) -> Column:
    """Score of a class if all attributes in ``mask`` had values not seen with it."""
    score = F.col("log_prior")
    for i in range(n_attrs):
        on = mask.bitwiseAND(F.lit(1 << i)) != 0
        score = score + F.when(on, F.col(f"unseen_{i}")).otherwise(F.lit(0.0))
    return score


def _best(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the class of highest rounded score, the smaller class on ties.

    A plain minimum, so most candidates are dropped before the shuffle.
    """
    order = F.struct((-F.round("score", SCORE_DIGITS)).alias("neg"), F.col("cls"))
    return rows.groupBy(*keys).agg(F.min(order).alias("win")).select(
        *keys, F.col("win.cls").alias("cls"), (-F.col("win.neg")).alias("score")
    )


def nb_classes(
    df: DataFrame, counts: DataFrame, target: str, attrs: list[str], alpha: float = 1.0
) -> DataFrame:
    """The likeliest class of each combination of attributes that lacks the target.

    Rows alike in their attributes get the same answer, so they are first counted into
    patterns. The class that would win if no value were seen is always scored: seen values
    only add to a score, so no other class without them can win. Of the classes seen with a
    value of the pattern, the best by one value alone are scored first, and then those
    that could still beat them, by upper bounds for bands of classes and for each class. Columns: ``attrs, n_rows, cls, mean``, so no attribute may have one
    of the last three names; ``nb_apply`` and ``nb_fill`` take attributes of any name.
    """
    taken = {a.lower() for a in attrs} & {"n_rows", "cls", "mean"}
    if taken:
        raise ValueError(f"names of the result: {sorted(taken)}")
    found = _classes(df, counts, target, attrs, alpha)
    return found.withColumnsRenamed(dict(zip(_safe(attrs), attrs)))


def _safe(attrs: list[str]) -> list[str]:
    """Names for attributes that no column made on the way has."""
    return [f"_nb_{i}" for i in range(len(attrs))]


def _answers(df: DataFrame, counts: DataFrame, target: str, attrs: list[str], alpha: float, mean: bool, fill: str) -> DataFrame:
    """Per combination of ``attrs``: how many rows lack the target (``_nb_rows``), and what fills it."""
    best = _classes(df, counts, target, attrs, alpha)
    value = F.col("mean" if mean else "cls").alias(fill)
    own = [F.col(s).alias(a) for s, a in zip(_safe(attrs), attrs)]
    return best.select(*own, F.col("n_rows").alias("_nb_rows"), value)


def _classes(df: DataFrame, counts: DataFrame, target: str, given: list[str], alpha: float) -> DataFrame:
    """``nb_classes`` with the attributes under their safe names."""
    if alpha <= 0:
        raise ValueError("alpha must be above 0")
    # there are no more classes than counts, so one measure serves all tables made of them
    small = fits_broadcast(counts)
    attrs = _safe(given)
    classes = stage(_class_table(counts, given, alpha))
    postings = stage(_postings(counts, classes, given, alpha, small))
    patterns = _patterns(df, target, given)
    sure = _fallback(patterns, classes, attrs)
    lists = stage(_lists(patterns, postings, classes, given, small))
    seeds = stage(_scored(_seeds(lists, attrs), postings, classes, given, small).unionByName(sure))
    reached = _reached(lists, seeds, postings, classes, attrs, small)
    candidates = _scored(reached, postings, classes, given, small).unionByName(seeds)
    winners = _best(candidates, [*attrs, "n_rows"]).drop("score")
    means = classes.select("cls", "mean")
    if small:
        return stage(winners.join(F.broadcast(means), "cls"))
    return stage(lookup_join(stage(winners), means, ["cls"]))


def nb_candidates(
    df: DataFrame, counts: DataFrame, target: str, attrs: list[str], alpha: float = 1.0
) -> DataFrame:
    """The pairs that ``nb_classes`` scores: ``_id`` of a combination of attributes, and ``cls``.

    Beside them, it scores one class per combination that needs no value seen.
    """
    small = fits_broadcast(counts)
    classes = stage(_class_table(counts, attrs, alpha))
    postings = stage(_postings(counts, classes, attrs, alpha, small))
    patterns = _patterns(df, target, attrs)
    lists = stage(_lists(patterns, postings, classes, attrs, small))
    first = _seeds(lists, _safe(attrs))
    least = _scored(first, postings, classes, attrs, small).unionByName(_fallback(patterns, classes, _safe(attrs)))
    more = _reached(lists, stage(least), postings, classes, _safe(attrs), small)
    return first.select("_id", "cls").union(more.select("_id", "cls")).distinct()


def _pattern(attrs: list[str]) -> list[str]:
    return ["_id", *attrs, "n_rows", "mask"]


def _patterns(df: DataFrame, target: str, given: list[str]) -> DataFrame:
    """The different combinations of attributes of rows without target, numbered and written once."""
    attrs = _safe(given)
    mask = reduce(
        lambda a, b: a + b,
        [F.when(F.col(a).isNotNull(), 1 << i).otherwise(0) for i, a in enumerate(attrs)],
    )
    found = (
        df.filter(F.col(target).isNull())
        .groupBy(*[F.col(g).alias(a) for g, a in zip(given, attrs)])
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    return stage(found.select(F.monotonically_increasing_id().alias("_id"), "*", mask.alias("mask")))


def _cells(given: list[str]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(i).alias("at"), F.lit(g).alias("attr"), F.col(a).cast("string").alias("value"))
            for i, (g, a) in enumerate(zip(given, _safe(given)))
        ]
    )


def _fallback(patterns: DataFrame, classes: DataFrame, attrs: list[str]) -> DataFrame:
    """Per pattern, the class that would win if none were seen with its values, with that score."""
    # at most 2^attrs masks; bounded by MAX_ATTRS, not by the data
    masks = range(1 << len(attrs))
    if len(masks) > 16:
        masks = [r["mask"] for r in patterns.select("mask").distinct().collect()] or [0]
    unseen = (
        classes.withColumn("mask", F.explode(F.array(*[F.lit(x) for x in masks])))
        .withColumn("score", _base(F.col("mask"), len(attrs)))
        .select("mask", "cls", "score")
    )
    found = patterns.join(F.broadcast(_best(unseen, ["mask"])), "mask")
    return found.select(*_pattern(attrs), "cls", "score")


def _postings(counts: DataFrame, classes: DataFrame, given: list[str], alpha: float, small: bool) -> DataFrame:
    """Of each value seen, the classes seen with it, in bands of their score by this value alone.

    ``gain`` is what the value adds to a class that has it, ``own`` the class's share of
    the value, as a logarithm, and ``alone`` that with the class's prior.
    """
    seen = counts.filter(F.col("attr").isNotNull()).select(
        "attr", "value", "cls", F.log((F.col("n") + alpha) / F.lit(alpha)).alias("gain")
    )
    wide = _look(seen, classes.drop("mean"), ["cls"], small, "inner")
    unseen = F.coalesce(*[F.when(F.col("attr") == g, F.col(f"unseen_{i}")) for i, g in enumerate(given)])
    own = wide.withColumn("own", unseen + F.col("gain"))
    alone = own.withColumn("alone", F.col("log_prior") + F.col("own")).drop("log_prior")
    return alone.withColumn("band", F.floor(F.col("alone") / BAND))


def _lists(patterns: DataFrame, postings: DataFrame, classes: DataFrame, given: list[str], small: bool) -> DataFrame:
    """Per pattern and value of it: the value's bands, and what other values can add at most.

    The values of a pattern are ordered by how many classes have them. A class is to be
    found by the first of its values, so it has none of those before (``before``), for which
    it gets no more than the likeliest class without the value does (``none``). Bands
    follow from logarithms of counts, so a value has some hundreds of them at most.
    """
    attrs = _safe(given)
    pattern = _pattern(attrs)
    top = classes.agg(*[F.max(f"unseen_{i}") for i in range(len(attrs))]).first()
    tops = F.array(*[F.lit(t if t is not None else 0.0) for t in top])
    bits = F.array(*[F.lit(1 << i) for i in range(len(attrs))])
    bands = postings.groupBy("attr", "value", "band").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("own").alias("own"),
        F.max("alone").alias("most"),
        F.max(F.struct("alone", "cls"))["cls"].alias("cls"),
    )
    values = bands.groupBy("attr", "value").agg(
        F.sum("n").alias("n"),
        F.max("own").alias("own"),
        F.sort_array(F.collect_list(F.struct("band", "most", "cls")), asc=False).alias("bands"),
    )
    present = (
        patterns.select(*pattern, F.explode(_cells(given)).alias("cell"))
        .select(*pattern, "cell.*")
        .filter(F.col("value").isNotNull())
    )
    none = F.get(tops, F.col("at"))
    found = _look(present, values, ["attr", "value"], small, "left").select(
        *pattern,
        F.struct(
            F.col("n").isNull().alias("new"), "n", "at", F.greatest("own", none).alias("best"), none.alias("none"),
            F.get(bits, F.col("at")).alias("bit"), "attr", "value", "bands",
        ).alias("value"),
    )
    # no more than MAX_ATTRS values in a group
    whole = found.groupBy(*pattern).agg(F.sort_array(F.collect_list("value")).alias("all"))

    def one(x: Column, i: Column) -> Column:
        before, after = F.slice("all", F.lit(1), i), F.slice("all", i + 2, F.lit(len(attrs)))
        return F.struct(
            x["attr"].alias("attr"),
            x["value"].alias("value"),
            x["bands"].alias("bands"),
            F.aggregate(before, F.lit(0), lambda acc, y: acc + y["bit"]).alias("before"),
            (
                F.aggregate(before, F.lit(0.0), lambda acc, y: acc + y["none"])
                + F.aggregate(after, F.lit(0.0), lambda acc, y: acc + y["best"])
            ).alias("others"),
        )

    return whole.select(*pattern, F.explode(F.transform("all", one)).alias("l")).select(*pattern, "l.*")


def _seeds(lists: DataFrame, attrs: list[str]) -> DataFrame:
    """The best classes by one value alone, whose scores are what others have to reach."""
    best = F.explode(F.slice("bands", 1, SEEDS)).alias("b")
    return lists.select(*_pattern(attrs), best).select(*_pattern(attrs), F.col("b.cls").alias("cls"))


def _reached(
    lists: DataFrame, seeds: DataFrame, postings: DataFrame, classes: DataFrame, attrs: list[str], small: bool
) -> DataFrame:
    """Pairs of pattern and class that could win against the best seed.

    First by band, so that no class of a band that cannot win is looked at, then by the
    class's own figures. ``SLACK`` is above what rounding changes, so ties are kept.
    """
    least = seeds.groupBy("_id").agg((F.max("score") - SLACK).alias("least"))
    rows = lists.join(least, "_id")
    able = F.filter("bands", lambda b: b["most"] + F.col("others") >= F.col("least"))
    rest = ["attr", "value", "before", "others", "least"]
    rows = rows.select(*_pattern(attrs), *rest, F.explode(F.transform(able, lambda b: b["band"])).alias("band"))
    found = _look(rows, postings, ["attr", "value", "band"], small, "inner")
    top = classes.agg(*[F.max(f"unseen_{i}") for i in range(len(attrs))]).first()
    most = F.col("alone") + F.col("others")
    for i, t in enumerate(top):
        if t is not None:
            on = F.col("before").bitwiseAND(F.lit(1 << i)) != 0
            most = most + F.when(on, F.col(f"unseen_{i}") - F.lit(t)).otherwise(F.lit(0.0))
    return found.filter(most >= F.col("least")).select(*_pattern(attrs), "cls")


def _scored(rows: DataFrame, postings: DataFrame, classes: DataFrame, given: list[str], small: bool) -> DataFrame:
    """Whole scores of pairs of pattern and class; a repeated pair counts once."""
    attrs = _safe(given)
    pattern = _pattern(attrs)
    cells = (
        rows.select(*pattern, "cls", F.explode(_cells(given)).alias("cell"))
        .select(*pattern, "cls", "cell.attr", "cell.value")
        .filter(F.col("value").isNotNull())
    )
    found = _look(cells, postings.select("attr", "value", "cls", "gain"), ["attr", "value", "cls"], small, "left")
    gains = found.groupBy(*pattern, "cls").agg(
        *[F.coalesce(F.max(F.when(F.col("attr") == g, F.col("gain"))), F.lit(0.0)).alias(f"gain_{i}") for i, g in enumerate(given)]
    )
    whole = _look(gains, classes.drop("mean"), ["cls"], small, "inner")
    score = reduce(lambda a, b: a + b, [_base(F.col("mask"), len(attrs)), *[F.col(f"gain_{i}") for i in range(len(attrs))]])
    return whole.select(*pattern, "cls", score.alias("score"))


def _look(left: DataFrame, right: DataFrame, keys: list[str], small: bool, how: str) -> DataFrame:
    """Join with a table made of the counts; a common value or class may belong to most rows."""
    if small:
        return left.join(F.broadcast(right), keys, how)
    left = stage(left)
    sizes = stage(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    return salted_join(left, right, keys, heavy_keys(sizes, keys, "n"), how)


def nb_apply(
    df: DataFrame,
    counts: DataFrame,
    target: str,
    attrs: list[str],
    alpha: float = 1.0,
    width: float | None = None,
    out: str | None = None,
    row_id: list[str] | None = None,
) -> DataFrame:
    """Fill ``target`` where it is NULL, and add ``<target>_was_null``.

    A numeric target gets the mean of its predicted interval. ``out`` names another
    column for the result and leaves ``target`` as it is.
    """
    refuse(df, ["_fill", "_nb_rows"], "nb_apply")
    answers = _answers(df, counts, target, attrs, alpha, width is not None, "_fill")
    missing = F.col(target).isNull()
    joined = lookup_join(df, answers, attrs, "_nb_rows", where=missing, row_id=row_id)
    filled = F.coalesce(F.col(target), F.col("_fill"))
    return (
        joined.withColumn(f"{target}_was_null", missing)
        .withColumn(out or target, filled)
        .drop("_fill")
    )


def nb_fill(
    df: DataFrame,
    targets: dict[str, list[str]],
    alpha: float = 1.0,
    widths: dict[str, float] | None = None,
) -> DataFrame:
    """Fit and apply for several targets, each filled from the values as they came."""
    widths = widths or {}
    refuse(df, ["_nb_rows", *[f"_fill_{t}" for t in targets]], "nb_fill")
    result = df
    for target, attrs in targets.items():
        width = widths.get(target)
        counts = nb_fit(df, target, attrs, width)
        answers = _answers(df, counts, target, attrs, alpha, width is not None, f"_fill_{target}")
        result = lookup_join(
            result,
            answers,
            attrs,
            "_nb_rows",
            where=F.col(target).isNull(),
            row_id=df.columns,
        )
    for target in targets:
        result = result.withColumn(f"{target}_was_null", F.col(target).isNull())
    for target in targets:
        fill = f"_fill_{target}"
        result = result.withColumn(target, F.coalesce(F.col(target), F.col(fill))).drop(fill)
    return result
