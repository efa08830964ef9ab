"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescast.sources.staging import stage

LETTERS = re.compile(r"[^\W\d_]+")
SIZES = (1, 2, 3, 4)
#: words that are counted together, so that a text of any length takes bounded memory
PART_WORDS = 200_000
#: distinct letters of a text that are numbered in 16 bits
ALPHABET = 0xFFFF
FLUSH = 300_000


def words_of(text: str | None) -> Counter:
    """Lower-case runs of letters with their counts."""
    return Counter(LETTERS.findall((text or "").lower()))


def grams_of(word: str) -> list[str]:
    """N-grams of a word between two spaces, none of spaces alone."""
    padded = f" {word} "
    return [g for n in SIZES for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) != " "]


def word_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """Occurrences of each word in the texts of each language; summed per task first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            made = [(name, w, n) for name, c in sums.items() for w, n in c.items()]
            sums.clear()
            cols = list(zip(*made)) or [[], [], []]
            kinds = (pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["lang", "word", "n"])

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums.setdefault(name, Counter()).update(words_of(value.as_py()))
                if sum(map(len, sums.values())) > FLUSH:
                    yield flush()
        yield flush()

    counted = docs.select(lang, text).mapInArrow(rows, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", length: int = 400) -> DataFrame:
    """The ``length`` most frequent n-grams of each language, ranked from 0.

    Counts run over all texts with a language. Ties are broken by code point. Returns
    ``lang``, ``gram``, ``rank``; no labelled text gives no rows.
    """
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = word_counts(known.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")), "text", "lang")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], int] = {}
        for batch in batches:
            for name, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                for gram in grams_of(word):
                    sums[name, gram] = sums.get((name, gram), 0) + n
            if len(sums) > FLUSH:
                yield made(sums)
                sums = {}
        yield made(sums)

    def made(sums: dict[tuple[str, str], int]) -> pa.RecordBatch:
        names, grams = zip(*sums) if sums else ((), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(grams, pa.string()), pa.array(sums.values(), pa.int64())],
            names=["lang", "gram", "n"],
        )

    summed = counts.mapInArrow(rows, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the best of each of many slices, then the best of those
    slices = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(64))).orderBy(F.desc("n"), "gram")
    first = summed.withColumn("r", F.row_number().over(slices)).filter(F.col("r") <= length)
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = first.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < length)
    return stage(ranked.select("lang", "gram", "rank"))


def packed(points: np.ndarray) -> np.ndarray:
    """All n-grams of letters between single spaces as numbers, in the order of their letters.

    ``points`` begin and end with the space, which is the smallest of them, and fit 16 bits.
    """
    letter, up = points != points[0], points << np.uint64(48)
    two = up[:-1] | up[1:] >> np.uint64(16)
    three = two[:-1] | up[2:] >> np.uint64(32)
    four = three[:-1] | up[3:] >> np.uint64(48)
    inner = letter[1:-1]
    return np.concatenate([up[letter], two, three[inner], four[inner[:-1] & inner[1:]]])


def counted(grams: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, ascending, and how often each is there."""
    if weights is None:
        grams = np.sort(grams)
    else:
        order = np.argsort(grams)
        grams, weights = grams[order], weights[order]
    starts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    counts = np.diff(starts, append=len(grams)) if weights is None else np.add.reduceat(weights, starts)
    return grams[starts], counts


class Ranker:
    """Places of a text's n-grams against those of every profile.

    An n-gram is one number of four letters of 16 bits, so a text is counted by one sort.
    Letters beyond 16 bits are numbered within their text, in their order.
    """

    def __init__(self, profiles: list[tuple[str, str, int]], length: int):
        self.langs = sorted({p[0] for p in profiles})
        self.length = length
        grams = sorted({p[1] for p in profiles})
        self.place = {g: i for i, g in enumerate(grams)}
        # one place more, for n-grams of no profile
        self.ranks = np.full((len(self.langs), len(grams) + 1), length, np.int64)
        for name, gram, rank in profiles:
            self.ranks[self.langs.index(name), self.place[gram]] = rank
        plain = [g for g in grams if max(g) <= "\uffff"]
        self.numbers = np.array([sum(ord(c) << (48 - 16 * i) for i, c in enumerate(g)) for g in plain], np.uint64)
        self.number_at = np.array([self.place[g] for g in plain], np.int64)

    def places(self, words: list[str]) -> np.ndarray:
        """Places in the profiles of the text's ``length`` most frequent n-grams, in order."""
        alphabet = sorted({" "}.union(*words))
        if len(alphabet) > ALPHABET:
            counts = Counter(g for w in words for g in grams_of(w))
            top = sorted(counts, key=lambda g: (-counts[g], g))[: self.length]
            return np.array([self.place.get(g, len(self.place)) for g in top], np.int64)
        wide = alphabet[-1] > "\uffff"
        codes = np.array([ord(c) for c in alphabet], np.uint64)
        found, at = None, 0
        while at < len(words):
            part = words[at : at + PART_WORDS]
            at += len(part)
            points = np.frombuffer(f" {' '.join(part)} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
            if wide:
                points = np.searchsorted(codes, points).astype(np.uint64) + np.uint64(1)
            one = counted(packed(points))
            found = one if found is None else counted(*map(np.concatenate, zip(found, one)))
        grams, counts = found
        if len(grams) > self.length:
            least = np.partition(counts, len(counts) - self.length)[len(counts) - self.length]
            grams, counts = grams[counts >= least], counts[counts >= least]
        top = grams[np.lexsort((grams, -counts))][: self.length]
        if wide:
            letters = [[int(g) >> shift & 0xFFFF for shift in (48, 32, 16, 0)] for g in top]
            named = ["".join(alphabet[i - 1] for i in one if i) for one in letters]
            return np.array([self.place.get(g, len(self.place)) for g in named], np.int64)
        if not len(self.numbers):
            return np.full(len(top), len(self.place))
        near = np.minimum(np.searchsorted(self.numbers, top), len(self.numbers) - 1)
        return np.where(self.numbers[near] == top, self.number_at[near], len(self.place))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of the smallest out-of-place distance, and how clearly it is.

        A gram at place i of the text and j of the profile is |i - j| out of place, or the
        profile's length if it is missing. The score is one less the distance over its
        largest possible value. ``und`` and 0 without a letter or a profile; ties go to
        the first name in code-point order.
        """
        words = LETTERS.findall((text or "").lower())
        if not words or not self.langs:
            return "und", 0.0
        ranks = self.ranks[:, self.places(words)]
        away = np.where(ranks == self.length, self.length, np.abs(ranks - np.arange(ranks.shape[1])))
        distance = away.sum(axis=1)
        best = int(np.argmin(distance))
        return self.langs[best], float(1 - distance[best] / (self.length * ranks.shape[1]))


def identify(docs: DataFrame, profiles: DataFrame, key: list[str | Column], text: str = "text", length: int = 400) -> DataFrame:
    """Predict the language of each text: ``lang_pred`` and ``score``, beside the columns ``key``.

    ``profiles`` come from ``learn_profiles``: ``length`` rows for each language, so they
    are sent to the tasks. NULL texts and texts without a letter are ``und``. Rows are
    independent: repeated rows and NULL keys stay. An empty table gives no rows.
    """
    listed = [(r["lang"], r["gram"], r["rank"]) for r in profiles.collect()]
    kept = docs.select(*key)
    out = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept.schema)}, lang_pred string, score double"
    sent = docs.sparkSession.sparkContext.broadcast(listed)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(sent.value, length)
        for batch in batches:
            made = [ranker.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            langs, scores = zip(*made) if made else ((), ())
            columns = [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return docs.select(*key, F.col(text).alias("_text")).mapInArrow(rows, out)
