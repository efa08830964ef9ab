"""Exact nearest neighbours of binary codes by incremental multi-index hashing."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescast.operators.joins import fits_broadcast
from salescast.sources.staging import stage

WORD = 16


def sign_code(vector: str | Column, dims: int) -> Column:
    """Code of a vector: bit i is set where component i is above 0; whole words of 16 bits.

    Components that are missing, NULL or NaN are 0 bits; a NULL vector has no code.
    """
    vector = F.col(vector) if isinstance(vector, str) else vector

    def bit(i: int) -> Column:
        x = F.get(vector, F.lit(i))
        return F.when((x > 0) & ~F.isnan(x), 1 << (i % WORD)).otherwise(0)

    words = [
        reduce(add, [bit(i) for i in range(at, min(at + WORD, dims))]) for at in range(0, dims, WORD)
    ]
    return F.when(vector.isNotNull(), F.array(*words))


def masks(radius: int, width: int) -> list[int]:
    """All values of ``width`` bits with ``radius`` ones."""
    return [sum(1 << i for i in bits) for bits in combinations(range(width), radius)]


def widths(words: int, codes: int, k: int = 10) -> list[int]:
    """Bits of each segment, 4 to 16: those by which a search looks up and measures the fewest codes.

    That is counted for random codes, whose k-th neighbours are the farthest away. Other
    codes are found as well, with more or less work.
    """
    bits, codes = WORD * words, max(1, codes)
    far, within = 0, 1
    while codes * within < min(k, codes) << bits:
        far += 1
        within += math.comb(bits, far)

    def cut(count: int) -> list[int]:
        return [(i + 1) * bits // count - i * bits // count for i in range(count)]

    def work(count: int) -> float:
        radius, more = divmod(far + 1, count)
        looked_up = [sum(math.comb(w, r) for r in range(radius + (i < more))) for i, w in enumerate(cut(count))]
        return sum(n * (1 + codes / (1 << w)) for n, w in zip(looked_up, cut(count)))

    return cut(min(range(words, bits // 4 + 1), key=work))


def segments(code: Column, sizes: list[int]) -> Column:
    """The code's words cut anew into segments."""
    found, at = [], 0
    for width in sizes:
        word, offset = divmod(at, WORD)
        value = F.shiftright(code[word], offset)
        if offset + width > WORD:
            value = value.bitwiseOR(F.shiftleft(code[word + 1], WORD - offset))
        found.append(value.bitwiseAND(F.lit((1 << width) - 1)))
        at += width
    return F.array(*found)


def smallest(rows: DataFrame, group: list[str], order: list[Column], k: int, spread: Column) -> DataFrame:
    """The first ``k`` rows of each group; of 64 parts of a group first, so it may be of any size."""
    parts = Window.partitionBy(*group, F.pmod(F.xxhash64(spread), F.lit(64))).orderBy(*order)
    whole = Window.partitionBy(*group).orderBy(*order)
    some = rows.withColumn("_n", F.row_number().over(parts)).filter(F.col("_n") <= k)
    return some.withColumn("_n", F.row_number().over(whole)).filter(F.col("_n") <= k)


def probes(active: DataFrame, sizes: list[int], radius: int) -> DataFrame:
    """What queries look up in round ``radius``: values that differ from theirs in as many bits.

    After all segments at smaller radii and ``a`` of them at this one, every code up to a
    distance of segments * radius + a - 1 has been seen. So a query whose k-th distance so
    far is ``bound`` needs no more segments than cover that; one without a bound needs all.
    """
    flips = F.array(*[F.array(*map(F.lit, masks(radius, w) or [0])) for w in sizes])
    needed = F.least(F.lit(len(sizes)), F.col("bound") + F.lit(1 - len(sizes) * radius))  # NULL is left out
    wide = F.get(F.array(*map(F.lit, sizes)), F.col("seg")) >= radius
    # a handful of queries may look up much: they are dealt out, also from one small file
    parts = int(active.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = active.repartition(parts, "sq").select("sq", "bound", F.posexplode("sq").alias("seg", "own"))
    each = each.filter(wide & (F.col("seg") < needed))
    each = each.select("sq", "bound", "seg", "own", F.explode(F.get(flips, F.col("seg"))).alias("mask"))
    return each.select("sq", "bound", "seg", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))


def top_k(rows: DataFrame, queries: DataFrame, words: int, k: int = 10, key: str = "vec_id", code: str = "code") -> DataFrame:
    """The ``k`` rows of the smallest Hamming distance to each query, ties by key.

    Codes are arrays of ``words`` numbers of 16 bits, cut into segments (see ``widths``).
    The index holds each distinct code once per segment, with its ``k`` smallest keys, so
    equal codes cost nothing more. Round r looks up, in every segment, the values that
    differ from the query's in exactly r bits, and measures the codes found; a code is taken
    where it is found first, and no farther away than the k-th so far. After round r every
    code up to a distance of segments * (r + 1) - 1 has been seen, so queries whose k-th
    distance is no larger are done; the others go on. In its last round a query takes one
    segment after the other until its k-th distance is covered (see ``probes``). After the
    last radius all codes have been seen. Equal queries are searched once.

    Rows and queries with a NULL key or code are left out; a query is found among the rows
    if it is one. Repeated (key, code) rows are one. With fewer than ``k`` rows all are
    returned. Returns ``query_id``, the key, ``distance`` and ``rank`` from 1.
    """
    known = rows.select(F.col(key).alias("id"), F.col(code).alias("c")).filter("id is not null and c is not null").distinct()
    asked = queries.select(F.col(key).alias("query_id"), F.col(code).alias("q")).filter("query_id is not null and q is not null").distinct()
    listed = smallest(known.withColumn("c", F.slice("c", 1, words)), ["c"], [F.col("id")], k, F.col("id"))
    codes = stage(listed.groupBy("c").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    total = codes.count()
    sizes = widths(words, total, k)
    # a code's segments stand for it from here on
    codes = codes.select(segments(F.col("c"), sizes).alias("sc"), "ids")
    asked = asked.select("query_id", segments(F.col("q"), sizes).alias("sq"))
    index = stage(codes.select(F.posexplode("sc").alias("seg", "value"), "sc", F.col("ids")[0].alias("first")))
    # beyond that the join must shuffle: what queries look up is planned by the size of the queries, of which
    # there may be few, and broadcast it would fill the driver
    right = F.broadcast(index) if fits_broadcast(index) else index.hint("merge")
    active = stage(asked.select("sq", F.lit(None).cast("int").alias("bound")).distinct())
    best, done, last = None, [], max(sizes)
    every = range(len(sizes))
    far = [F.bit_count(F.col("sq")[t].bitwiseXOR(F.col("sc")[t])) for t in every]
    distance = reduce(add, far)
    for radius in range(last + 1):
        # found in no earlier round, and in no earlier segment of this one
        first = reduce(and_, [far[t] >= F.when(F.col("seg") > t, radius + 1).otherwise(radius) for t in every])
        near_enough = F.col("bound").isNull() | (distance <= F.col("bound"))
        found = probes(active, sizes, radius).join(right, ["seg", "value"]).filter(near_enough & first)
        found = found.select("sq", "sc", "first", distance.alias("distance"))
        pool = found if best is None else best.unionByName(found)
        near, whole = Window.partitionBy("sq").orderBy("distance", "first"), Window.partitionBy("sq")
        pool = pool.withColumn("_n", F.row_number().over(near)).filter(F.col("_n") <= k).drop("_n")
        full = F.count(F.lit(1)).over(whole) >= min(k, total)
        pool = stage(pool.withColumn("bound", F.when(full, F.max("distance").over(whole))))
        covered = F.coalesce(F.col("bound") <= len(sizes) * (radius + 1) - 1, F.lit(False)) | F.lit(radius == last)
        done.append(pool.filter(covered).drop("bound"))
        best = pool.filter(~covered).drop("bound")
        bounds = pool.groupBy("sq").agg(F.max("bound").alias("bound"))
        active = stage(active.drop("bound").join(bounds, "sq", "left").filter(~covered))
        if active.isEmpty():
            break
    chosen = reduce(DataFrame.unionByName, done)
    spread = chosen.join(codes, "sc").select("sq", "distance", F.explode("ids").alias("id"))
    order = Window.partitionBy("sq").orderBy("distance", "id")
    ranked = spread.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return asked.join(ranked, "sq").select("query_id", F.col("id").alias(key), F.col("distance").cast("int").alias("distance"), "rank")
