"""Alignment of two tokenizers' tokens over the bytes of the same texts."""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescast.llm.packing import byte_letters
from salescast.sources.staging import stage

#: A tokens that one lane of the state vector passes over
LANE = 256
#: bytes of text that are aligned together
ROUND = 2 << 20
#: ids of either vocabulary, and how often a document may hold a pair in one code
ID_BITS, MOST_TIMES = 20, 1 << 22
#: pairs that are broadcast, the most frequent ones; others are joined by shuffle
FREQUENT = 500_000
#: the splitting rule of byte-level vocabularies (a fixed value)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteLevel:
    """Ids of a byte-level BPE file, special tokens' strings being plain text.

    Where the file's merges stand in the order of their ids, and it has no rules of its
    own, its entries are the ranks of the merges, which a quicker library takes.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        byte = {letter: b for b, letter in byte_letters().items()}
        special = {t["content"] for t in said.get("added_tokens", [])}
        entries = {i: bytes(byte[c] for c in e) for e, i in said["model"]["vocab"].items() if e not in special}
        self.bytes = [entries.get(i, b"") for i in range(1 + max(entries))]
        if ranked(said):
            import tiktoken

            ranks = {b: i for i, b in entries.items()}
            self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            whole.encode_special_tokens = True
            self.encode = lambda text: whole.encode(text, add_special_tokens=False).ids


def ranked(said: dict) -> bool:
    """Whether a byte-level file's merges follow from its ids alone."""
    rules, model, vocab = said["pre_tokenizer"] or {}, said["model"], said["model"]["vocab"]
    plain = rules.get("type") == "ByteLevel" and not rules.get("add_prefix_space") and rules.get("use_regex", True)
    if not plain or said.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
        return False
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab["".join(p)] for p in pairs]
    return all(x < y for x, y in zip(made, made[1:])) and len(made) + 256 == len(set(vocab.values()) - {
        t["id"] for t in said.get("added_tokens", [])})


class Pieces:
    """Ids of a piece file with byte fallback, and the bytes that each piece stands for."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.encode, self.bytes = (lambda texts: model.encode(texts, num_threads=1)), []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                self.bytes.append(piece.replace("▁", " ").encode("utf-8", "surrogatepass"))


class Pair:
    """Two tokenizers, with the lengths, the bytes and the printed forms of their ids."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        n = max(len(self.a.bytes), len(self.b.bytes))
        if n >= 1 << ID_BITS:
            raise ValueError(f"more than {1 << ID_BITS} ids")
        self.sizes = [np.array([len(b) for b in t.bytes], np.int64) for t in (self.a, self.b)]
        self.letters = [np.frombuffer(b"".join(t.bytes), np.uint8) for t in (self.a, self.b)]
        # an id followed by each of the marks, at 3 * id + mark
        self.shown = [b"%d%s" % (i, mark) for i in range(n) for mark in (b",", b"|", b";")]

    def tokens(self, texts: list[str | None]) -> list[list[bytes]]:
        """Ids by A and by B of each text, four bytes each; none for NULL and empty texts."""
        there = [t for t in texts if t]
        made_a = iter([array("i", self.a.encode(" " + t)).tobytes() for t in there])
        made_b = iter([array("i", ids).tobytes() for ids in self.b.encode(there)])
        return [[next(made) if t else b"" for t in texts] for made in (made_a, made_b)]

    def round(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both and how many each text has: none where either's bytes are not those of a space and the text."""
        found = self.tokens(texts)
        ids = [np.frombuffer(b"".join(f), "<i4").astype(np.int64) for f in found]
        counts = [np.array([len(x) // 4 for x in f], np.int64) for f in found]
        encoded = [b" " + t.encode() if t else b"" for t in texts]
        length = np.array([len(e) for e in encoded], np.int64)
        good = np.ones(len(texts), bool)
        for each, count, size, letters in zip(ids, counts, self.sizes, self.letters):
            doc = np.repeat(np.arange(len(texts)), count)
            good &= np.bincount(doc, size[each], minlength=len(texts)).astype(np.int64) == length
            # the bytes of the texts that have as many, laid side by side
            kept = each[good[doc]]
            n = size[kept]
            from_ = np.repeat((np.cumsum(size) - size)[kept] - (np.cumsum(n) - n), n)
            made = letters[from_ + np.arange(n.sum())]
            true = np.frombuffer(b"".join(e for e, g in zip(encoded, good) if g), np.uint8)
            if (odd := np.flatnonzero(made != true)).size:
                owner = np.repeat(np.flatnonzero(good), length[good])
                good[owner[odd]] = False
        return [(each[np.repeat(good, count)], np.where(good, count, 0)) for each, count in zip(ids, counts)]


@lru_cache(maxsize=1)
def pair_of(path_a: str, path_b: str) -> Pair:
    """One for each worker process, which keeps it from task to task."""
    return Pair(path_a, path_b)


def lanes(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where lanes begin and end: documents' tokens ``first`` to ``stop``, ``LANE`` at a time."""
    count = -(-(stop - first) // LANE)
    lane = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = np.repeat(first, count) + LANE * lane
    return begin, np.minimum(begin + LANE, np.repeat(stop, count))


def lockstep(end_a: np.ndarray, end_b: np.ndarray, first: np.ndarray, stop: np.ndarray):
    """Links and cuts of all documents of a round: (A token, B token) in order, and cut flags of both.

    ``end_a`` and ``end_b`` hold where each token ends, documents one after the other;
    ``first`` and ``stop`` bound each document's A tokens. One state vector holds a pair
    of pointers for every document; each step emits the link under all pointers, marks a
    cut where both tokens end, advances the token that ends first (or both), and leaves out
    documents that are finished. A long document has a lane for every ``LANE`` A tokens:
    its B pointer starts at the token that goes on beyond the end of the lane before, which
    is the state that the lane before ends with. So the steps do not grow with the texts.
    """
    at_a, until = lanes(first, stop)
    starts = np.concatenate(([0], end_a))[at_a]
    at_b = np.searchsorted(end_b, starts, side="right")
    # the sum of the pointers grows at each step of a document, so each link has a place
    link = np.full(len(end_a) + len(end_b), -1, np.int64)
    cut_a, cut_b = np.zeros(len(end_a), bool), np.zeros(len(end_b), bool)
    while len(at_a):
        a, b = end_a[at_a], end_b[at_b]
        link[at_a + at_b] = at_a
        both = a == b
        cut_a[at_a[both]] = True
        cut_b[at_b[both]] = True
        at_a = at_a + (a <= b)
        at_b = at_b + (b <= a)
        left = at_a < until
        if not left.all():
            at_a, at_b, until = at_a[left], at_b[left], until[left]
    place = np.flatnonzero(link >= 0)
    return link[place], place - link[place], cut_a, cut_b


def aligned(pair: Pair, texts: list[str | None], digest: bool) -> list[list]:
    """Columns of a round: n_a, n_b, n_groups, n_links, groups, codes of linked id pairs."""
    (a, count_a), (b, count_b) = pair.round(texts)
    stop_a = np.cumsum(count_a)
    from_a, from_b, cut_a, cut_b = lockstep(np.cumsum(pair.sizes[0][a]), np.cumsum(pair.sizes[1][b]), stop_a - count_a, stop_a)
    doc_of = np.repeat(np.arange(len(texts)), count_a)
    # groups as printed: each token after those of earlier groups, A's before B's
    ahead_a, ahead_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    upto_a, upto_b = (np.concatenate(([0], np.flatnonzero(c) + 1)) for c in (cut_a, cut_b))
    printed = np.empty(len(a) + len(b), np.int64)
    if len(a):
        printed[np.arange(len(a)) + upto_b[ahead_a]] = 3 * a + cut_a
        printed[np.arange(len(b)) + upto_a[ahead_b + 1]] = 3 * b + 2 * cut_b
    shown = list(map(pair.shown.__getitem__, printed.tolist()))
    groups, at = [], 0
    for n in (count_a + count_b).tolist():
        joined = b"".join(shown[at : at + n])[:-1]
        groups.append("" if not n else hashlib.sha256(joined).hexdigest() if digest else joined.decode())
        at += n
    # how often each document links each pair of ids
    doc = doc_of[from_a]
    code = (doc << (2 * ID_BITS)) | (a[from_a] << ID_BITS) | b[from_b]
    code, times = np.unique(code, return_counts=True)
    at, code = code >> (2 * ID_BITS), code & ((1 << 2 * ID_BITS) - 1)
    codes = np.split(code | times << (2 * ID_BITS), np.searchsorted(at, np.arange(1, len(texts)))) if len(texts) else []
    if len(times) and times.max() >= MOST_TIMES:
        codes = [np.concatenate([parted(c) for c in one]) if len(one) else one for one in codes]
    n_groups = np.bincount(doc_of[cut_a], minlength=len(texts))
    return [count_a, count_b, n_groups, np.bincount(doc, minlength=len(texts)), groups, codes]


def parted(code: int) -> np.ndarray:
    """A code whose number does not fit, as several of the same pair."""
    times, pair = divmod(int(code), 1 << (2 * ID_BITS))
    parts = [MOST_TIMES - 1] * (times // (MOST_TIMES - 1)) + [times % (MOST_TIMES - 1)]
    return np.array([t << (2 * ID_BITS) | pair for t in parts if t], np.int64)


def rounds(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of some ``ROUND`` bytes."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= ROUND:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def links(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """The alignment of each text: the key, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups``, ``codes``.

    ``groups`` is ``a1,a2|b1;a3|b2,b3`` or, with ``digest``, its SHA-256 in hex; ``codes``
    are the linked id pairs (see ``counted``). A text that is NULL, empty, or not given back
    by either tokenizer has no tokens: zeros, an empty string and no codes.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = ["n_a", "n_b", "n_groups", "n_links", "groups", "codes"]
    kinds = [*[pa.int64()] * 4, pa.string(), pa.list_(pa.int64())]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(path_a, path_b)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, stop in rounds(texts):
                columns = aligned(pair, texts[start:stop], digest)
                made = [pa.array(c, k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), *made], names=["key", *names])

    said = "n_a long, n_b long, n_groups long, n_links long, groups string, codes array<long>"
    made = docs.select(key, text).mapInArrow(rows, f"key {kind}, {said}")
    return made.select(F.col("key").alias(key), *names)


def counted(codes: DataFrame) -> DataFrame:
    """Rows of (``_row``, ``codes``) as ``_row``, ``pair``, ``times``: one for each pair of ids a document links."""
    each = codes.select("_row", F.explode("codes").alias("c"))
    return each.select(
        "_row",
        F.col("c").bitwiseAND(F.lit((1 << 2 * ID_BITS) - 1)).alias("pair"),
        F.shiftright("c", 2 * ID_BITS).alias("times"),
    )


def pair_counts(each: DataFrame) -> DataFrame:
    """Each linked pair of ids, ``n`` links in all documents, and whether that is its B id's most."""
    counts = each.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1)))
    counts = stage(counts)
    # one row for each id of a vocabulary
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def least_frequent(known: DataFrame, room: int) -> int:
    """The power of two from which on at most ``room`` pairs are as frequent."""
    sizes = known.groupBy(F.floor(F.log2("n")).alias("power")).count().collect()  # 63 rows at most; no count reaches 2 ** 62
    total, least = 0, 62
    for row in sorted(sizes, key=lambda r: -r["power"]):
        total += row["count"]
        if total > room:
            break
        least = int(row["power"])
    return 1 << least


def align(
    docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", digest: bool = False, room: int = FREQUENT
) -> DataFrame:
    """Align the tokens of a byte-level file (A) and of a piece file (B) in each text.

    A reads a space and the text, B the text, to which it adds that space itself. Tokens are
    linked where their byte ranges overlap, and the offsets where tokens of both end cut them
    into groups (see ``links``, which gives the columns of each text). A pair's count is the
    number of links of all texts that hold it; ``n_best`` are the links whose pair has the
    highest count of its B id, ties included, and ``count_sum`` adds up the counts of all
    links.

    Counts of the ``room`` most frequent pairs at most are broadcast, which covers most links;
    rarer pairs meet theirs by a shuffle, in which by their rarity no key is hot.

    Paths must be readable by executors. Every row is a document of its own, also where keys
    are NULL or repeated; other columns are ignored; an empty table gives no rows.
    """
    made = stage(
        links(docs, path_a, path_b, key, text, digest).withColumn("_row", F.monotonically_increasing_id()), compression="zstd"
    )
    each = counted(made.select("_row", "codes"))
    known = stage(pair_counts(each))
    least = least_frequent(known, room)
    frequent, rare = known.filter(F.col("n") >= least), known.filter(F.col("n") < least)
    parts = each.join(F.broadcast(frequent), "pair")
    if rare.limit(1).count():
        others = each.join(F.broadcast(frequent.select("pair")), "pair", "left_anti")
        parts = parts.unionByName(others.join(rare.hint("merge"), "pair"))
    times = F.col("times")
    sums = parts.groupBy("_row").agg(
        F.sum(F.when(F.col("best"), times).otherwise(0)).alias("n_best"), F.sum(times * F.col("n")).alias("count_sum")
    )
    found = made.drop("codes").join(sums, "_row", "left")
    return found.select(
        key, "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"),
        "groups",
    )
