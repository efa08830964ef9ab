"""Near-duplicate vectors by NN-descent: a neighbour graph refined until it holds the near pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescast.llm.graph import components
from salescast.operators.joins import fits_broadcast, lookup_join
from salescast.sources.staging import stage

#: neighbours of a list at first, orders it starts from, and places looked ahead in each
NEAR, ORDERS, AHEAD = 8, 6, 4
#: how much a saturated list grows, clients of a centre that are compared together
GROWTH, CLIENTS = 4, 256
#: vectors whose links are counted by brute force, the recall asked for, rounds without new links
AUDITED, RECALL = 512, 0.98
MOST_ROUNDS = 40
EDGES = "a long, b long, sim double, k int"


def sound(vector: Column) -> Column:
    """Whether a vector has a direction: no NULL or non-finite component, and one that is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of length 1 in double precision, shorter ones filled up, and their sizes."""
    sizes = np.asarray(column.value_lengths(), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.zeros((len(sizes), sizes.max(initial=0)))
    x[np.arange(x.shape[1]) < sizes[:, None]] = flat
    # by the largest component first, so that no square overflows or vanishes
    x /= np.abs(x).max(axis=1, initial=0, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)), sizes


def made(a: list, b: list, sim: list, k: list) -> pa.RecordBatch:
    """Edges once each, the ``k`` nearest of each ``a`` among them."""
    a, b, k = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b, k))
    sim = np.concatenate(sim) if sim else np.empty(0)
    order = np.lexsort((b, a))
    a, b, k, sim = a[order], b[order], k[order], sim[order]
    once = np.ones(len(a), bool)
    once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, k, sim = a[once], b[once], k[once], sim[once]
    order = np.lexsort((-sim, a))
    a, b, k, sim = a[order], b[order], k[order], sim[order]
    first = np.ones(len(a), bool)
    first[1:] = a[1:] != a[:-1]
    at = np.arange(len(a))
    near = at - at[first][np.cumsum(first) - 1] < k if len(a) else first
    columns = [pa.array(a[near], pa.int64()), pa.array(b[near], pa.int64()), pa.array(sim[near]), pa.array(k[near], pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "sim", "k"])


def nearest(edges: DataFrame) -> DataFrame:
    """Of each ``a`` its ``k`` nearest, ranked."""
    once = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.max("k").alias("k"))
    order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return stage(once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("k")))


def first_lists(nodes: DataFrame, total: int, seed: int) -> DataFrame:
    """Neighbours in orders by random hyperplanes: vectors of a small angle often have one code.

    An order is dealt into ranges, vectors of one code by a hash, and each vector is held
    against the next few in its range.
    """
    bits = max(4, total.bit_length())

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, sizes = unit(batch.column(1))
            planes = np.random.default_rng(seed).standard_normal((ORDERS * bits, x.shape[1])).T
            above = (x @ planes > 0).reshape(len(x), ORDERS, bits)
            found = above @ (1 << np.arange(bits))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(found[:, i]) for i in range(ORDERS)]],
                names=["node", "vector", *[f"c{i}" for i in range(ORDERS)]],
            )

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0] if held is not None else batch
            (x, sizes), ids = unit(batch.column(1)), np.asarray(batch.column(0))
            a, b, sim = [], [], []
            for j in range(1, min(AHEAD + 1, len(ids))):
                near = (x[:-j] * x[j:]).sum(axis=1)
                same = sizes[:-j] == sizes[j:]
                a += [ids[:-j][same], ids[j:][same]]
                b += [ids[j:][same], ids[:-j][same]]
                sim += [near[same]] * 2
            yield made(a, b, sim, [np.full(len(x), NEAR) for x in a])
            held = batch.slice(max(0, len(ids) - AHEAD))

    kind = nodes.schema["vector"].dataType.simpleString()
    coded = stage(nodes.select("node", "vector").mapInArrow(codes, f"node long, vector {kind}, " + ", ".join(f"c{i} long" for i in range(ORDERS))))
    found = None
    for i in range(ORDERS):
        order = [F.col(f"c{i}"), F.xxhash64("node", F.lit(seed))]
        dealt = coded.select("node", "vector", f"c{i}").repartitionByRange(*order).sortWithinPartitions(*order)
        one = dealt.select("node", "vector").mapInArrow(along, EDGES)
        found = one if found is None else found.unionByName(one)
    return found


def neighbourhoods(edges: DataFrame, turn: int) -> DataFrame:
    """Who meets at which centre: (``centre``, ``block``, ``node``, ``near``).

    At a centre meet its own list and its clients, which have it among their first
    neighbours. Clients and the first of the list are ``near``: they are held against all who
    meet. Clients of a hub meet in blocks, dealt anew in each turn, each with the whole list.
    """
    close = edges.filter(F.col("rank") <= NEAR)
    clients = close.select(F.col("b").alias("centre"), F.col("a").alias("node"))
    listed = edges.select(F.col("a").alias("centre"), F.col("b").alias("node"), (F.col("rank") <= NEAR).alias("near"))
    hubs = stage(
        clients.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / CLIENTS).cast("int").alias("blocks")).filter("blocks > 1")
    )
    dealt = lookup_join(clients, hubs, ["centre"], row_id=["node"])
    block = F.pmod(F.xxhash64("node", F.lit(turn)), F.coalesce("blocks", F.lit(1)))
    dealt = dealt.select("centre", block.cast("int").alias("block"), "node", F.lit(True).alias("near"))
    held = lookup_join(listed, hubs, ["centre"], row_id=["node"])
    every = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    held = held.select("centre", every.alias("block"), "node", "near")
    return held.unionByName(dealt).groupBy("centre", "block", "node").agg(F.max("near").alias("near"))


def joined(meeting: DataFrame, state: DataFrame, small: bool) -> DataFrame:
    """Edges found where neighbours of neighbours meet, if nearer than the last of a full list."""
    full = lookup_join(meeting, state, ["node"], row_id=["centre", "block", "node"], small=small)
    order = ["centre", "block"]
    dealt = full.select(*order, "node", "near", "worst", "k", "vector").repartition(*order).sortWithinPartitions(*order)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            centre, block = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            starts = np.flatnonzero(np.concatenate(([True], (centre[1:] != centre[:-1]) | (block[1:] != block[:-1]))))
            # the last group may go on
            held = batch.slice(int(starts[-1])) if len(starts) else None
            if len(starts) > 1:
                yield compared(batch.slice(0, int(starts[-1])), starts)
        if held is not None:
            yield compared(held, np.array([0, len(held)]))

    return dealt.mapInArrow(rows, EDGES)


def compared(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
    """Each near vector of a group against all of the group."""
    ids, near, worst, k = (np.asarray(batch.column(i)) for i in (2, 3, 4, 5))
    x, sizes = unit(batch.column(6))
    out_a, out_b, out_sim, out_k = [], [], [], []
    for s, e in zip(starts[:-1], starts[1:]):
        own = s + np.flatnonzero(near[s:e])
        sim = x[own] @ x[s:e].T
        better = (sim > worst[own][:, None]) & (ids[own][:, None] != ids[s:e]) & (sizes[own][:, None] == sizes[s:e])
        i, j = np.nonzero(better)
        out_a.append(ids[own[i]])
        out_b.append(ids[s + j])
        out_sim.append(sim[i, j])
        out_k.append(k[own[i]].astype(np.int64))
    return made(out_a, out_b, out_sim, out_k)


def recall(nodes: DataFrame, edges: DataFrame, least: float, audited: int = AUDITED, seed: int = 0) -> float:
    """Share of the links of ``audited`` vectors, drawn by a hash, that ``edges`` hold; 1 if they have none.

    The drawn vectors are a fixed number; all vectors are held against them in blocks.
    """
    drawn = nodes.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(audited).select("node", "vector").toArrow()
    asked = np.asarray(drawn.column("node").combine_chunks(), np.int64)
    wanted, lengths = unit(drawn.column("vector").combine_chunks()) if len(asked) else (np.empty((0, 0)), asked)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, sizes), ids = unit(batch.column(1)), np.asarray(batch.column(0))
            width = min(x.shape[1], wanted.shape[1])
            sim = wanted[:, :width] @ x[:, :width].T
            i, j = np.nonzero((sim >= least) & (lengths[:, None] == sizes) & (asked[:, None] != ids))
            yield pa.RecordBatch.from_arrays([pa.array(asked[i]), pa.array(ids[j])], names=["a", "b"])

    true = stage(nodes.select("node", "vector").mapInArrow(rows, "a long, b long"))
    kept = edges.filter(F.col("sim") >= least)
    either = kept.select("a", "b").unionAll(kept.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = true.join(either, ["a", "b"], "left_semi").count()
    return found / total if (total := true.count()) else 1.0


def neighbour_graph(nodes: DataFrame, least: float) -> DataFrame:
    """Lists of nearest neighbours (``a``, ``b``, ``sim``) that hold the pairs with a cosine of ``least`` or more.

    ``nodes`` have a ``node`` and a sound ``vector``, each vector once. Lists start from random
    orders and are refined by letting neighbours of neighbours meet. A list is saturated if its
    last neighbour is a link too: it may have more, and grows. When neither new links nor
    saturated lists are left, the recall is measured; below ``RECALL`` the lists get new
    random neighbours and go on.
    """
    total = nodes.count()
    link = F.col("sim") >= least
    turn, links, missed = 0, -1, 0
    edges = nearest(first_lists(nodes, total, 0))
    while turn < MOST_ROUNDS:
        turn += 1
        ends = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("last"), F.max("k").alias("k"))
        grown = F.when((F.col("n") >= F.col("k")) & (F.col("last") >= least), F.col("k") * GROWTH).otherwise(F.col("k")).cast("int")
        ends = ends.select(
            F.col("a").alias("node"), grown.alias("k"),
            F.when(F.col("n") < grown, -2.0).otherwise(F.col("last")).alias("worst"),
            (grown > F.col("k")).alias("saturated"),
        )
        ends = stage(ends)
        counts = edges.agg(F.sum(link.cast("long"))).first()[0] or 0
        if counts == links and not ends.filter("saturated").limit(1).count():
            if recall(nodes, edges, least, seed=turn) >= RECALL:
                break
            edges = nearest(edges.select("a", "b", "sim", "k").unionByName(first_lists(nodes, total, turn)))
        links = counts
        state = nodes.select("node", "vector").join(ends.drop("saturated"), "node")
        state = stage(state.select("node", "k", "worst", "vector"))
        old = edges.drop("k").join(ends.select(F.col("node").alias("a"), "k"), "a")
        found = joined(neighbourhoods(edges, turn), state, fits_broadcast(state))
        edges = nearest(old.select("a", "b", "sim", "k").unionByName(found))
    return edges.select("a", "b", "sim")


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9) -> DataFrame:
    """Links and groups of vectors whose cosine, in double precision, is ``least`` or more.

    Equal vectors are one node of the neighbour graph (see ``neighbour_graph``), so copies cost
    nothing more. Pairs of the graph with a cosine of ``least`` or more are the links; the number of
    pairs that are kept follows the number of links between different vectors.

    Returns one row per row: the key, ``n_links`` (other rows linked directly), ``component_id``
    (the smallest key reachable, its own included) and ``kept`` (whether that is its own). Vectors
    that are NULL, empty, zero, or hold a NULL or non-finite component link with nothing, nor do
    vectors of different lengths. Rows with the same or a NULL key are vectors of their own; a
    NULL key is never the smallest, and a group of NULL keys has component_id NULL. Other
    columns are ignored; an empty table gives no rows.
    """
    read = rows.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    read = stage(read.withColumns({"sound": sound(F.col("vector")), "row": F.monotonically_increasing_id()}))
    good = read.filter("sound").drop("sound")
    nodes = good.groupBy("vector").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("least"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()))
    graph = neighbour_graph(nodes, least).filter(F.col("sim") >= least)
    links = stage(graph.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = nodes.select(F.col("node").alias("b"), "copies")
    others = both.join(sizes, "b").groupBy("a").agg(F.sum("copies").alias("others")).withColumnRenamed("a", "node")
    roots = components(links).withColumnRenamed("id", "node")
    known = nodes.join(others, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = stage(known.select("vector", "copies", "least", "root", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    told = stage(known.join(smallest, "root").select("vector", "copies", "n_links", "component_id"))
    found = lookup_join(good.select("key", "row", "vector"), told, ["vector"], weight="copies", row_id=["row"])
    found = found.select("key", "n_links", "component_id")
    alone = read.filter("not sound").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return found.unionByName(alone).select(
        F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept")
    )
