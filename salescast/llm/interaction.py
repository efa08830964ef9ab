"""How filters interact: what each removes after any others, from tables of failing ids."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescast.operators.joins import lookup_join
from salescast.sources.staging import stage

SPACE = r"[\x20\x09-\x0D]+"
UPPER, MARKS = "[^A-Z]+", "[#$%&*|]"


def text_failures(text: str | Column) -> dict[str, Column]:
    """The failure conditions of four filters on a text alone; NULL counts as empty.

    A: under 200 words; B: fewer than half of the words are distinct; C: more than 3 % of the
    code points are upper-case A-Z; D: holds any of ``#$%&*|``. Words are maximal runs
    without ASCII white space.
    """
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, UPPER, "")) > 3 * F.length(text),
        "D": text.rlike(MARKS),
    }


def repeats(rows: DataFrame, key: str, digest: str, row: str) -> DataFrame:
    """The ``row`` of those whose digest a smaller key has; a NULL key is never larger nor smaller.

    Only digests found more than once are looked up, and a digest of many rows is split.
    """
    least = rows.groupBy(digest).agg(F.min(key).alias("_least"), F.count(F.lit(1)).alias("_n"))
    least = stage(least.filter("_n > 1"))
    found = lookup_join(rows, least, [digest], weight="_n", row_id=[row])
    return found.filter(F.col(key) > F.col("_least")).select(row)


def prefixes(failing: dict[str, DataFrame]) -> DataFrame:
    """Of each failing row, filter and set of earlier filters: whether it is removed or redundant.

    ``failing`` holds one table of ids (``_row``) per filter. Filters are put ahead one by
    one: what fails a filter is taken once without the new one and once behind it, where a
    left-anti join with the new one's failing ids leaves what is still removed, and a
    left-semi join what became redundant. Every set of earlier filters is reached once, as
    the order within it does not matter: rows (``_row``, ``filter``, ``ahead``, ``redundant``),
    2 ** (filters - 1) for each failing row and filter.
    """
    parts = [table.select("_row", F.lit(name).alias("filter")) for name, table in failing.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionAll(part)
    rows = rows.select("*", F.lit("").alias("ahead"), F.lit(False).alias("redundant"))
    for name, table in failing.items():
        behind = rows.filter(F.col("filter") != name).withColumn("ahead", F.concat("ahead", F.lit(name)))
        first = ~F.col("redundant")
        left = behind.filter(first).join(table, "_row", "left_anti")
        hit = behind.filter(first).join(table, "_row", "left_semi").withColumn("redundant", F.lit(True))
        rows = stage(rows.unionByName(left).unionByName(hit).unionByName(behind.filter("redundant")))
    return rows


def audit(docs: DataFrame, failures: dict[str, DataFrame], part: str, losses: dict[str, DataFrame], row: str = "_row") -> DataFrame:
    """Effects of every filter after every set of others, and in every order, by part.

    ``docs`` has one row per document: ``row``, its ``part`` (not NULL); ``failures`` the
    failing rows of each filter, by names of one letter; ``losses`` the rows of each kind of
    label. Returns for each part, order of filters (``filter_order``) and ``step`` from 1:
    ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``<loss>_lost`` and ``shapley``, the filter's
    removals summed over all orders. Parts and filters that remove nothing have zeros.
    """
    names = sorted(failures)
    failing = {n: stage(failures[n].select(F.col(row).alias("_row"))) for n in names}
    rows = prefixes(failing)
    removed = rows.filter(~F.col("redundant"))
    marked = rows.withColumns({f"{k}_lost": F.lit(0) for k in losses})
    for kind, ids in losses.items():
        lost = removed.join(ids.select(F.col(row).alias("_row")), "_row", "left_semi")
        lost = lost.withColumns({f"{k}_lost": F.lit(int(k == kind)) for k in losses})
        marked = marked.unionByName(lost.withColumn("redundant", F.lit(None).cast("boolean")))
    owners = docs.select(F.col(row).alias("_row"), F.col(part).alias("part"))
    # a row of the union is a removal, a redundancy (redundant), or a loss (redundant NULL)
    count = lambda which: F.sum(which.cast("long"))
    each = marked.groupBy("_row", "filter", "ahead").agg(
        F.coalesce(F.max(~F.col("redundant")), F.lit(False)).alias("out"),
        *[F.max(f"{k}_lost").alias(f"{k}_lost") for k in losses],
    )
    sums = each.join(owners, "_row").groupBy("part", "filter", "ahead").agg(
        count(F.col("out")).alias("removed"), count(~F.col("out")).alias("redundant"),
        *[F.sum(f"{k}_lost").cast("long").alias(f"{k}_lost") for k in losses],
    )
    return in_orders(stage(docs.groupBy(F.col(part).alias("part")).agg(F.count(F.lit(1)).alias("total"))), stage(sums), names, list(losses))


def in_orders(parts: DataFrame, sums: DataFrame, names: list[str], losses: list[str]) -> DataFrame:
    """The figures of sets of earlier filters, told for each order of the filters.

    Both tables have as many rows as there are parts, times a number of the filters.
    """
    steps = [
        F.struct(
            F.lit("".join(order)).alias("filter_order"), F.lit(i + 1).alias("step"),
            F.lit(name).alias("filter"), F.lit("".join(sorted(order[:i]))).alias("ahead"),
        )
        for order in permutations(names) for i, name in enumerate(order)
    ]
    listed = parts.select("part", "total", F.explode(F.array(*steps)).alias("s")).select("part", "total", "s.*")
    others = F.regexp_replace(F.lit("".join(names)), F.col("filter"), "")
    alone = sums.filter(F.col("ahead") == others).select("part", "filter", F.col("removed").alias("unique_fails"))
    figures = ["removed", "redundant", *[f"{k}_lost" for k in losses]]
    found = listed.join(sums, ["part", "filter", "ahead"], "left").join(alone, ["part", "filter"], "left")
    found = stage(found.fillna(0, [*figures, "unique_fails"]))
    shares = found.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    earlier = found.groupBy("part", "filter_order").agg(F.sort_array(F.collect_list(F.struct("step", "removed"))).alias("all"))
    gone = F.aggregate(F.filter("all", lambda x: x["step"] <= F.col("step")), F.lit(0).cast("long"), lambda s, x: s + x["removed"])
    return found.join(earlier, ["part", "filter_order"]).join(shares, ["part", "filter"]).select(
        "part", "filter_order", "step", (F.col("total") - gone).alias("kept"), *figures, "unique_fails", "shapley"
    )


def audit_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The audit of the five filters A to E (see ``text_failures``; E: a smaller key has the same text).

    Texts are read once; what is kept of them is a row number, the key, the part, four
    outcomes and a digest (SHA-256) by which E compares. Losses are documents that ``labels``
    gives ``quality`` 1 (good) or ``toxic`` 1; a key labelled several times counts once.

    A NULL part is the empty string, a NULL text empty. Rows that repeat a key are documents
    of their own, with the key's labels; a NULL key has no label and repeats nothing. Other
    columns are ignored; without documents there are no rows.
    """
    base = docs.select(
        F.col(key).alias("_key"), F.coalesce(F.col(part), F.lit("")).alias("_part"),
        F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("_digest"),
        *[fails.alias(f"_{name}") for name, fails in text_failures(text).items()],
    )
    base = stage(base.withColumn("_row", F.monotonically_increasing_id()))
    failures = {name: base.filter(F.col(f"_{name}")).select("_row") for name in "ABCD"}
    failures["E"] = repeats(base.select("_row", "_key", "_digest"), "_key", "_digest", "_row")
    losses = {}
    for kind, label in (("good", "quality"), ("toxic", "toxic")):
        ids = labels.filter(F.col(label) == 1).select(F.col(key).alias("_key")).distinct()
        losses[kind] = stage(base.select("_row", "_key").join(ids, "_key", "left_semi").select("_row"))
    return audit(base, failures, "_part", losses)
