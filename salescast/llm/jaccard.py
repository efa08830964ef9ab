"""Exact Jaccard join of documents on word shingles, by PartEnum signatures."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salescast.llm.batches import bound_batches
from salescast.llm.graph import components
from salescast.operators.joins import fits_broadcast, heavy_keys, lookup_join, salted_join
from salescast.sources.staging import stage

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
FULL = 1 << 64
BUFFER = 400_000
BLOCK = 512
DRAWS = 8
MOST_BITS = 1 << 15


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * M2
    return (x ^ (x >> np.uint64(27))) * M1


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles.

    Words are runs without ASCII white space, A-Z in lower case. A text with fewer words
    has one shingle, the whole sequence; one without words has none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    each = pd.util.hash_array(np.array(found, dtype=object), categorize=False)
    width = min(words, len(each))
    total = np.full(len(each) - width + 1, width, np.uint64)
    for i in range(width):
        total = total * M1 + each[i : len(each) - width + 1 + i]
    return np.unique(mixed(total))


def set_id(hashes: np.ndarray) -> int:
    """64-bit id of a set; equal sets have equal ids."""
    total = mixed(hashes + M1).sum(dtype=np.uint64) + np.uint64(len(hashes))
    return int(total.view(np.int64))


def spare_parts(k: int, smallest: float) -> int:
    """Parts beyond ``k + 1`` that a set of ``smallest`` elements leaves empty, and three deviations.

    0 if these would be more than half of ``k``.
    """
    for spare in range(1, k // 2):
        empty = (k + 1 + spare) * math.exp(-smallest / (k + 1 + spare))
        if spare >= empty + 3 * math.sqrt(empty):
            return spare
    return 0


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of the set's elements in as many classes as a power of two above their number.

    Each element that two sets do not share changes one parity, so these differ in no more
    places than the sets. Halves may be folded together: fewer classes, the same bound.
    """
    bits = min(MOST_BITS, max(64, 1 << (2 * len(hashes)).bit_length()))
    odd = np.bincount((mixed(hashes ^ M1) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(words.reshape(-1, size), axis=0)


def least_apart(a: bytes, b: bytes) -> int:
    """Places in which two sketches differ: two sets differ in as many elements at least."""
    one, two = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    size = min(len(one), len(two))
    return int(np.bitwise_count(folded(one, size) ^ folded(two, size)).sum())


def most_apart(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Elements that similar sets may not share, for the sum of their sizes."""
    return sizes - 2 * -(-percent * sizes // (100 + percent))


class Scheme:
    """Signatures of sets whose sizes lie in one band.

    Bands are as wide as two similar sets can differ in size, so these lie in the same
    band or in neighbours; a set has the signatures of its own band and of the next.
    Similar sets of a band differ in ``k`` elements at most. The hash domain is cut into
    equal parts and signatures are hashes of the elements within a choice of parts:

    * ``k`` up to 2: ``k + 2`` parts, all choices of two. ``k`` parts at most are touched
      by a difference, so some choice is the same in both sets.
    * up to some tens: ``(k + 1) / 2`` parts of three, each with all choices of two of its three.
      Some part has one difference at most, which is outside of one of its choices.
    * more: ``k + 1`` parts and a few to spare, each a choice by itself; one is without
      difference. If both sets have no more empty parts than are to spare, one of the
      others is without difference, so empty ones count for sets with more of them only.
    """

    def __init__(self, largest: int, percent: int):
        self.largest, self.spare = largest, 0
        self.k = max(t + 2 * (-percent * t // (100 + percent)) for t in range(max(1, 2 * largest - 30), 2 * largest + 1))
        k = self.k
        if k <= 2:
            self.parts = k + 2
            self.choices = [(i, j) for i in range(self.parts) for j in range(i)]
        elif not (spare := spare_parts(k, largest * percent * percent / 10_000)):
            self.parts = 3 * ((k + 2) // 2)
            self.choices = [(p + i, p + j) for p in range(0, self.parts, 3) for i in range(3) for j in range(i)]
        else:
            self.spare, self.parts, self.choices = spare, k + 1 + spare, None
        bounds = [FULL * i // self.parts for i in range(1, self.parts)]
        self.bounds = np.array(bounds, np.uint64)
        if self.choices:
            self.first, self.second = (np.array(c) for c in zip(*self.choices))

    def of(self, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of a sorted set, and which of them have no element."""
        at = np.concatenate(([0], np.searchsorted(ordered, self.bounds), [len(ordered)]))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(ordered ^ M2))))
        part, filled = sums[at[1:]] - sums[at[:-1]], at[1:] > at[:-1]
        if self.choices:
            part = mixed(part[self.first]) + part[self.second]
            filled = filled[self.first] | filled[self.second]
        slot = np.arange(len(part), dtype=np.uint64) + np.uint64(self.largest << 32)
        return mixed(mixed(part + M1) ^ mixed(slot * M1)), ~filled


@lru_cache(maxsize=None)
def band(size: int, percent: int) -> tuple[Scheme, Scheme]:
    """The schemes of the size's own band and of the next."""
    high = last_of(size, percent)
    return scheme(high, percent), scheme(last_of(high + 1, percent), percent)


def last_of(size: int, percent: int) -> int:
    low = 1
    while True:
        high = max(low, low * 100 // percent)
        if size <= high:
            return high
        low = high + 1


@lru_cache(maxsize=None)
def scheme(largest: int, percent: int) -> Scheme:
    return Scheme(largest, percent)


def signatures(hashes: np.ndarray, percent: int) -> np.ndarray:
    """All signatures of a set, of both its bands.

    A choice of parts without any element would be shared by too many sets. It is made
    finer: such a signature is joined with each one of the whole set under another hash,
    of which similar sets share one as well.
    """
    out = []
    for s in band(len(hashes), percent):
        if s.k == 0:
            continue  # only equal sets are similar
        found, empty = s.of(hashes)
        out.append(found[~empty])
        if empty.sum() > s.spare:
            finer, _ = s.of(np.sort(mixed(hashes * M1 + M2)))
            out.append((mixed(found[empty])[:, None] + finer[None, :]).ravel())
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def sets_of(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """Of each document: its key, the number of its shingles, the id and the sketch of their set."""
    kind = docs.schema[key].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, sketches = [], [], []
            for value in batch.column(1):
                found = shingles(value.as_py(), words)
                sizes.append(len(found))
                ids.append(set_id(found) if len(found) else None)
                sketches.append(sketch(found).tobytes() if len(found) else None)
            columns = [pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["key", "n", "id", "sketch"])

    return docs.select(key, text).mapInArrow(rows, f"key {kind}, n long, id long, sketch binary")


def candidates(docs: DataFrame, text: str, words: int, percent: int) -> DataFrame:
    """Sets that share a signature with a smaller id: ``sig``, ``a``, and the ``b`` it is held against.

    In a bucket of sets with one signature, each is held against the one of the smallest
    id. A task first does so among its own sets and passes on the smallest of each bucket
    only, so that a bucket's rows at the shuffle are as many as tasks, whatever its size.
    """

    def combined(sigs: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        sig, member = np.concatenate(sigs).view(np.int64), np.concatenate(ids)
        order = np.lexsort((member, sig))
        sig, member = sig[order], member[order]
        starts = np.ones(len(sig), bool)
        starts[1:] = sig[1:] != sig[:-1]
        head = member[starts][np.cumsum(starts) - 1]
        kept = starts | (member != head)
        sig, member, head, starts = sig[kept], member[kept], head[kept], starts[kept]
        # rows that are settled already go anywhere
        at = np.where(starts, sig, mixed(sig.view(np.uint64) ^ mixed(member.view(np.uint64))).view(np.int64))
        return pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(member), pa.array(head, mask=starts), pa.array(sig, mask=starts)],
            names=["at", "a", "head", "sig"],
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, ids, held, seen = [], [], 0, set()
        for batch in batches:
            for value in batch.column(0):
                hashes = shingles(value.as_py(), words)
                name = set_id(hashes)
                if not len(hashes) or name in seen:
                    continue
                seen.add(name)
                found = signatures(hashes, percent)
                sigs.append(found)
                ids.append(np.full(len(found), name, np.int64))
                held += len(found)
                if held >= BUFFER:
                    yield combined(sigs, ids)
                    sigs, ids, held = [], [], 0
                    seen.clear()
        if held:
            yield combined(sigs, ids)

    made = docs.select(text).mapInArrow(rows, "at long, a long, head long, sig long")
    bucket = Window.partitionBy("at").orderBy("a")
    found = made.withColumn("b", F.coalesce("head", F.first("a").over(bucket)))
    return stage(found.filter("a != b").select(F.coalesce("sig", "at").alias("sig"), "a", "b"))


def texts_of(
    wanted: DataFrame, sets: DataFrame, docs: DataFrame, key: str, text: str, words: int
) -> DataFrame:
    """One text for each wanted set: ``id``, ``text``.

    Found by a document's key; where keys are NULL or repeated, by the set of each text.
    """
    keys = sets.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    if not keys.filter("n > 1 or key is null").limit(1).count():
        # a row per set first: many documents may have one set
        owners = stage(sets.groupBy("id").agg(F.min("key").alias("key")).join(wanted, "id"))
        right = F.broadcast(owners) if fits_broadcast(owners) else owners
        texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(right, "key")
        return texts.select("id", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [set_id(shingles(t.as_py(), words)) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column(0)], names=["id", "text"])

    named = docs.select(text).mapInArrow(rows, "id long, text string")
    return named.join(stage(wanted), "id").groupBy("id").agg(F.min("text").alias("text"))


def with_ends(pairs: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs with the columns of ``right``, which has a row per ``id``, for ``a`` and for ``b`` (``..._a``, ``..._b``)."""
    both = pairs
    for end in ("a", "b"):
        # a hub is in many pairs, which are dealt out with a copy of its row each
        sizes = stage(pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n")))
        each = right.withColumnsRenamed({c: end if c == "id" else f"{c}_{end}" for c in right.columns})
        both = salted_join(both, each, [end], heavy_keys(sizes, [end], "n"), "inner", row_id=["a", "b"])
    return both


def possible(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets with whether their sizes and sketches leave it open that they are similar (``may``)."""
    both = with_ends(pairs, known)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            most = most_apart(sizes[0] + sizes[1], percent)
            apart = [least_apart(a.as_py(), b.as_py()) for a, b in zip(batch.column(4), batch.column(5))]
            may = (np.abs(sizes[0] - sizes[1]) <= most) & (np.array(apart, np.int64) <= most)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(may)], names=["a", "b", "may"])

    both = both.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    return stage(both.mapInArrow(rows, "a long, b long, may boolean"))


def each_once(sets: DataFrame) -> DataFrame:
    """One row for each set: ``id``, ``n``, ``sketch``."""
    known = sets.filter("id is not null").groupBy("id")
    return stage(known.agg(F.min("n").alias("n"), F.min("sketch").alias("sketch")))


def verified(
    pairs: DataFrame, sets: DataFrame, known: DataFrame, docs: DataFrame, key: str, text: str, words: int, percent: int
) -> DataFrame:
    """Pairs of sets with whether they are similar, from the texts of one document each.

    Texts are many times the size of sketches, so they are moved for those pairs only that
    the sketches do not rule out.
    """
    pairs = possible(stage(pairs), known, percent)
    left = pairs.filter("may").select("a", "b")
    wanted = left.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    both = with_ends(left, stage(texts_of(wanted, sets, docs, key, text, words)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_text, last = None, np.empty(0, np.uint64)
        for batch in batches:
            similar = []
            for a, b in zip(batch.column(2), batch.column(3)):
                if (b := b.as_py()) != last_text:
                    last_text, last = b, shingles(b, words)
                one = shingles(a.as_py(), words)
                common = len(np.intersect1d(one, last, assume_unique=True))
                similar.append(100 * common >= percent * (len(one) + len(last) - common))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(similar, pa.bool_())], names=["a", "b", "similar"]
            )

    read = both.select("a", "b", "text_a", "text_b").mapInArrow(rows, "a long, b long, similar boolean")
    return stage(read.unionByName(pairs.filter("not may").select("a", "b", F.lit(False).alias("similar"))))


def pairs_across(labelled: DataFrame, sets: DataFrame, percent: int, one: bool = False) -> DataFrame:
    """Pairs of sets that share a ``sig``, are in different components (``root``) and may be similar.

    In a bucket, the sets of its largest component are held against all others, and the
    others against each other, in blocks of about 512. What is held together are sizes and
    sketches; pairs that these rule out are never made. With ``one``, only one set of the
    largest component, drawn by a hash, is held against the others: most of those that
    belong to it are found so, and what is left for a whole comparison is little.
    """
    of_root = labelled.groupBy("sig", "root").count()
    buckets = of_root.groupBy("sig").agg(
        F.max_by("root", F.struct("count", "root")).alias("major"), F.max("count").alias("big"), F.sum("count").alias("all")
    )
    # every row of a bucket of one component ends here
    buckets = stage(buckets.filter("all > big"))
    rows = stage(labelled.join(buckets, "sig"))
    known = sets.join(rows.select("id").distinct(), "id").groupBy("id").agg(F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    if one:
        drawn = F.xxhash64(F.pmod("sig", F.lit(DRAWS)), "id")
        chosen = rows.filter("root = major").groupBy("sig").agg(F.min_by("id", drawn).alias("id"))
        rows = stage(rows.filter("root != major").unionByName(rows.join(chosen, ["sig", "id"])).withColumn("big", F.lit(1)))
    first, rest = F.ceil(F.col("big") / BLOCK), F.ceil((F.col("all") - F.col("big")) / BLOCK)
    spread, is_major = F.xxhash64("id"), F.col("root") == F.col("major")
    blocks = rows.join(known, "id").select(
        "sig", "id", "root", "n", "sketch",
        F.when(is_major, F.pmod(spread, first)).otherwise(first + F.pmod(spread, rest)).alias("own"),
        F.explode(
            F.sequence(
                F.when(is_major, first).otherwise(F.lit(0)),
                F.when(is_major | F.lit(not one), first + rest - 1).otherwise(F.lit(0)),
            )
        ).alias("other"),
    )
    order = ["sig", "low", "high"]
    blocks = blocks.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    dealt = blocks.select(*order, "own", "id", "root", "n", "sketch").repartition(*order).sortWithinPartitions(*order)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            found: list[np.ndarray] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:3] != row[:3]:
                    found.append(may_be_similar(held, percent))
                    held = []
                held.append(row)
            yield pairs_batch(found)
        if held:
            yield pairs_batch([may_be_similar(held, percent)])

    return dealt.mapInArrow(rows_of, "a long, b long").distinct()


def may_be_similar(rows: list[tuple], percent: int) -> np.ndarray:
    """Pairs of one pair of blocks (rows ``sig, low, high, own, id, root, n, sketch``), larger id first."""
    sketches = [np.frombuffer(r[7], np.uint64) for r in rows]
    least = min(map(len, sketches))
    words = np.array([folded(s, least) for s in sketches])
    own, ids, roots, n = (np.array([r[i] for r in rows], np.int64) for i in (3, 4, 5, 6))
    same, out = rows[0][1] == rows[0][2], []
    for i in range(len(rows)):
        # within a block each pair once, of two blocks only across
        others = np.arange(i + 1, len(rows))
        others = others[(roots[others] != roots[i]) & (same | (own[others] != own[i]))]
        others = others[most_apart(n[others] + n[i], percent) >= np.abs(n[others] - n[i])]
        if len(others):
            apart = np.bitwise_count(words[others] ^ words[i]).sum(axis=1)
            near = others[apart <= most_apart(n[others] + n[i], percent)]
            out.append(np.column_stack([np.maximum(ids[near], ids[i]), np.minimum(ids[near], ids[i])]))
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def pairs_batch(found: list[np.ndarray]) -> pa.RecordBatch:
    both = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: only the roots of those that the links reach are joined anew."""
    ends = links
    for end in ("a", "b"):
        of_end = roots.select(F.col("id").alias(end), F.col("root").alias(f"root_{end}"))
        ends = ends.join(of_end, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    above = components(stage(ends.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))))
    above = above.select(F.col("id").alias("root"), F.col("root").alias("above"))
    alone = above.join(roots.select("root").distinct(), "root", "left_anti").select(F.col("root").alias("id"), F.col("above").alias("root"))
    kept = roots.join(above, "root", "left").select("id", F.coalesce("above", "root").alias("root"))
    return stage(kept.unionByName(alone))


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85
) -> DataFrame:
    """Groups of documents that reach each other by links of similar shingle sets.

    Two documents link when their sets of distinct ``words``-word shingles have a Jaccard
    similarity of ``percent`` or more. Equal sets are one set from the start. Sets that
    share a PartEnum signature (see ``Scheme``) are held against the smallest of their
    bucket; then, in buckets with sets of different components, pairs across components
    that sizes and sketches do not rule out (see ``pairs_across``). Every other pair that these
    leave open is checked on the texts too (see ``verified``), and no link is lost.

    Returns the key, ``n_shingles``, ``component_id`` (the smallest key of the group) and
    ``component`` (a number of the group, NULL without words). NULL and empty texts have
    no shingle and link with nothing. A NULL key never is the smallest, and a group of
    NULL keys only has component_id NULL. Rows with the same key and different texts are
    documents of their own. Other columns are ignored; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    sets = stage(sets_of(docs, key, text, words))
    known = each_once(sets)
    near = candidates(docs, text, words, percent)
    pairs = near.select("a", "b").distinct()
    checked = verified(pairs, sets, known, docs, key, text, words, percent)
    links = checked.filter("similar").select("a", "b")
    roots = components(links)
    members = near.select("sig", F.col("a").alias("id")).unionAll(near.select("sig", F.col("b").alias("id"))).distinct()
    members = stage(members)
    checked = checked.select("a", "b", "similar")
    for one in (True, False):
        labelled = members.join(roots, "id", "left").select("sig", "id", F.coalesce("root", "id").alias("root"))
        across = stage(pairs_across(labelled, sets, percent, one).join(checked, ["a", "b"], "left_anti"))
        if across.limit(1).count():
            new = verified(across, sets, known, docs, key, text, words, percent)
            checked = stage(checked.unionByName(new))
            roots = joined(roots, new.filter("similar").select("a", "b"))
    found = lookup_join(sets.drop("sketch"), roots, ["id"], row_id=["key", "id"])
    found = found.withColumn("root", F.coalesce("root", "id"))
    least = stage(found.filter("root is not null").groupBy("root").agg(F.min("key").alias("least")))
    named = lookup_join(found, least, ["root"], where=F.col("root").isNotNull(), row_id=["key", "id"])
    return named.select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("key")).alias("component_id"),
        F.col("root").alias("component"),
    )
