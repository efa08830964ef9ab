"""Packing documents into sequences of a fixed length."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salescast.sources.staging import stage

CACHED_WORDS = 400_000
CACHED_CHARS = 48
#: letters below this one are lower-cased and composed one by one
SIMPLE_END = "\u0130"
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies.

    Printable bytes of Latin-1 stand for themselves, the others for the letters from 256 on.
    """
    plain = {b for b in range(33, 256) if not 127 <= b <= 160 and b != 173}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


class WordTokenizer:
    """Ids of whole texts, four little-endian bytes each, from the ids of their words.

    For byte-level tokenizers in lower case that drop white space and part letters from
    marks: a text's ids are then those of its space-free pieces one after the other, and
    most pieces were seen before. A new piece of Latin letters, with marks behind it or
    not, goes to the merges directly, any other through the whole tokenizer. The memory of
    pieces is bounded and starts anew when full.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.known: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def whole(self, piece: str) -> bytes:
        return np.asarray(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def stem(self, letters: str) -> bytes:
        found = self.stems.get(letters)
        if found is None:
            as_bytes = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.letters)
            made = self.merges.tokenize(as_bytes)
            found = np.array([t.id for t in made], "<u4").tobytes()
            if len(self.stems) >= CACHED_WORDS:
                self.stems.clear()
            if len(letters) <= CACHED_CHARS:
                self.stems[letters] = found
        return found

    def piece(self, piece: str) -> bytes:
        letters = piece.rstrip(MARKS)
        if not letters or not letters.isalpha() or max(letters) >= SIMPLE_END:
            return self.whole(piece)
        found = self.stem(letters.lower())
        if len(letters) < len(piece):
            marks = piece[len(letters) :]
            behind = self.known.get(marks)
            if behind is None:
                behind = self.known[marks] = self.whole(marks)
            found += behind
        return found

    def encode(self, text: str | None) -> bytes:
        words = (text or "").replace("\n", " ").split(" ")
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        missing = [w for w in dict.fromkeys(words) if w not in known]
        for word in missing:
            known[word] = self.piece(word)
        ids = b"".join([known[w] for w in words])
        for word in missing:
            if len(word) > CACHED_CHARS:
                del known[word]
        return ids


@lru_cache(maxsize=1)
def tokenizer_of(path: str) -> WordTokenizer:
    """One for each worker process, which keeps it from task to task."""
    return WordTokenizer(path)


PIECES = T.StructType(
    [
        T.StructField("row", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
    ]
)


def cut(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 2, longest: int = 4096
) -> DataFrame:
    """Token pieces of at most ``longest`` ids: a document's full pieces, then its rest.

    Every document ends with ``end_id``, so empty and NULL texts have one token.
    """
    out = T.StructType([docs.schema[key], *PIECES.fields[1:]])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer_of(tokenizer)
        last = int(end_id).to_bytes(4, "little")
        for batch in batches:
            at, columns = [], [[], [], [], []]
            for i, value in enumerate(batch.column(1)):
                ids = words.encode(value.as_py()) + last
                total = len(ids) // 4
                for start in range(0, total, longest):
                    part = ids[4 * start : 4 * (start + longest)]
                    at.append(i)
                    for c, v in zip(columns, (start, len(part) // 4, zlib.crc32(part), total)):
                        c.append(v)
            keys = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [keys, *[pa.array(c, pa.int64()) for c in columns]], names=[f.name for f in out.fields]
            )

    return docs.select(key, text).mapInArrow(pieces, out)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: longest first, each into the first bin with room.

    The bins' free room is the lowest row of a tournament tree whose inner nodes hold the
    larger of their two children, so the first bin with room is found by one descent.
    Items of equal length keep their order.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for item in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[item]), 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[item], offsets[item] = node - leaves, capacity - tree[node]
        tree[node] -= need
        node //= 2
        while node:
            room = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == room:
                break
            tree[node] = room
            node //= 2
    return bins, offsets


def pack(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 2,
    capacity: int = 4096,
    group_pieces: int = 4096,
    seed: int = 5,
) -> DataFrame:
    """Pack documents into sequences of ``capacity`` tokens, first-fit decreasing.

    A document longer than ``capacity`` is cut into full pieces and a rest. Pieces go to
    groups at random, about ``group_pieces`` in each however many documents there are,
    and every group is packed by itself. A group leaves room in its last sequences only.

    ``tokenizer`` is a path that executors can read. NULL texts count as empty: they have
    the end token alone. Rows repeated, or with a NULL key, are documents of their own.
    Other columns are ignored; an empty table gives no pieces. Returns the key, ``start``,
    ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id`` and ``offset``.
    """
    pieces = stage(cut(docs, tokenizer, key, text, end_id, capacity).withColumn("_dealt", F.rand(seed)))
    groups = max(1, round(pieces.count() / group_pieces))
    out = T.StructType([*pieces.schema.fields[:-1], *[T.StructField(c, T.LongType()) for c in ("sequence_id", "offset")]])

    def fill(name: tuple, group: pd.DataFrame) -> pd.DataFrame:
        # the order of arrival is not fixed, the drawn number is
        group = group.sort_values(["_dealt", "start", "ids_crc32"], kind="stable")
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=(int(name[0]) << 32) + bins, offset=offsets)[[f.name for f in out.fields]]

    dealt = pieces.withColumn("_group", F.floor(F.col("_dealt") * groups))
    return dealt.groupBy("_group").applyInPandas(fill, out)
