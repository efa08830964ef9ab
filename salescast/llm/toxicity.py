"""Toxicity: a learned lexicon, its misspellings, and the context of every hit."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescast.llm.labelled import Logistic, labelled_texts
from salescast.sources.staging import stage

WORD = re.compile(r"\w+")
STEM_SIZES = range(3, 8)
SEEN = 400_000
WINDOW = 6
NAMES = ["_total", "_most", "_abuse", "_quoted"]

# fixed values: words that report what someone else says, pairs of quotation marks
REPORTING = frozenset(
    """said says say called calls quote quoted quotes wrote writes word words term slur insult insults
    dit disait mot insulte sagte sagt wort zitat beleidigung dijo dice palabra insulto""".split()
)
QUOTES = (('"', '"'), ("“", "”"), ("„", "“"), ("«", "»"), ("»", "«"), ("‘", "’"))


class Lexicon:
    """Levenshtein automaton of a trie of terms and stems, made deterministic as it is used.

    A state is a set of (trie node, edits so far); the automaton accepts a word within one
    edit of a term of five letters or more, two of nine or more, with the first letter
    right. Stems accept any word that begins with them, within one edit if the stem has
    five letters or more. ``exceptions`` are words that look like a term, or like the
    beginning of a stem, and are none.
    """

    def __init__(self, terms: dict[str, float], stems: dict[str, float], exceptions: frozenset[str] = frozenset()):
        self.terms, self.stems, self.exceptions = terms, stems, exceptions
        self.children: list[dict[str, int]] = [{}]
        self.term_at: dict[int, str] = {}
        self.stem_at: dict[int, str] = {}
        for words, ends in ((terms, self.term_at), (stems, self.stem_at)):
            for word in sorted(words):
                node = 0
                for char in word:
                    if char not in self.children[node]:
                        self.children[node][char] = len(self.children)
                        self.children.append({})
                    node = self.children[node][char]
                ends[node] = word
        self.most = max([0, *map(self.edits, terms), *map(self.stem_edits, stems)])
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.begun: list[tuple[int, str] | None] = []  # of each state, the closest stem that ends there
        self.start = self._state({(0, 0)})

    @staticmethod
    def edits(term: str) -> int:
        return 0 if len(term) < 5 else 1 if len(term) < 9 else 2

    @staticmethod
    def stem_edits(stem: str) -> int:
        return 0 if len(stem) < 5 else 1

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        least: dict[int, int] = {}
        queue = list(pairs)
        while queue:
            node, e = queue.pop()
            if least.get(node, self.most + 1) <= e:
                continue
            least[node] = e
            if node and e < self.most:
                queue += [(c, e + 1) for c in self.children[node].values()]  # a letter is missing
        key = frozenset(least.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            ends = ((e, self.stem_at[n]) for n, e in key if n in self.stem_at)
            self.begun.append(min((x for x in ends if x[0] <= self.stem_edits(x[1])), default=None))
            self.moves.append({})
        return self.states[key]

    def _move(self, state: int, char: str) -> int:
        after = set()
        for node, e in self.sets[state]:
            child = self.children[node].get(char)
            if child is not None:
                after.add((child, e))
            if node and e < self.most:
                after.add((node, e + 1))  # a letter too many
                after.update((c, e + 1) for c in self.children[node].values())  # another letter
        self.moves[state][char] = found = self._state(after) if after else -1
        return found

    def match(self, word: str) -> tuple[str, int] | None:
        """The closest term, or stem, and the number of edits."""
        state, near = self.start, None
        for i, char in enumerate(word):
            after = self.moves[state].get(char, -2)
            state = self._move(state, char) if after == -2 else after
            if state < 0:
                break
            begun = self.begun[state]
            if begun is not None:
                if begun[0] == 0:
                    return begun[1], 0
                near = begun if near is None else min(near, begun)
        best = near
        if state >= 0:
            ends = ((e, self.term_at[n]) for n, e in self.sets[state] if n in self.term_at)
            term = min((x for x in ends if x[0] <= self.edits(x[1])), default=None)
            if term is not None and (best is None or term[0] <= best[0]):
                best = term
        if best is None or best[0] and word in self.exceptions:
            return None
        return best[1], best[0]


class Scorer:
    """Features of a text: its hits, weighed by term, edits and context."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.hits: dict[str, float] = {}
        self.clean: set[str] = set()

    def weight(self, word: str) -> float:
        found = self.lexicon.match(word)
        if found is None:
            return 0.0
        term, edits = found
        return self.lexicon.terms.get(term, self.lexicon.stems.get(term, 0.0)) * 0.8**edits

    def features(self, text: str | None) -> tuple[float, ...]:
        """log(1 + weighed hits), largest hit, log(1 + hits as abuse), log(1 + hits in quotation)."""
        low = (text or "").lower()
        distinct = set(WORD.findall(low))
        for word in distinct - self.clean - self.hits.keys():
            weight = self.weight(word)
            if weight:
                self.hits[word] = weight
            else:
                self.clean.add(word)
        if len(self.clean) > SEEN:
            self.clean.clear()
        if distinct.isdisjoint(self.hits):
            return 0.0, 0.0, 0.0, 0.0
        total = most = abuse = quoted = 0.0
        tokens = list(WORD.finditer(low))
        marks = quotations(low)
        for i, token in enumerate(tokens):
            weight = self.hits.get(token[0])
            if not weight:
                continue
            # the window around the hit says whether it is used or reported
            near = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
            inside = any(a < token.start() < b for a, b in marks)
            reported = any(t[0] in REPORTING for t in near)
            factor = (0.4 if inside else 1.0) * (0.7 if reported else 1.0)
            total += weight * factor
            most = max(most, weight * factor)
            abuse += factor == 1.0
            quoted += factor < 1.0
        return math.log1p(total), most, math.log1p(abuse), math.log1p(quoted)


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans between quotation marks of one line, of 300 characters at most."""
    found = []
    for first, last in QUOTES:
        if first in text:
            found += [m.span() for m in re.finditer(f"{first}[^{first}{last}\n]{{1,300}}{last}", text)]
    return found


def likelihood(toxic: Column, clean: Column, total: dict[int, float]) -> Column:
    """Log-likelihood ratio (G squared) of a word's numbers of texts against equal shares of both kinds."""
    both = (toxic + clean) / (total[1] + total[0])
    found = F.lit(0.0)
    for n, label in ((toxic, 1), (clean, 0)):
        for there, share in ((n, both), (total[label] - n, 1 - both)):
            found += F.when((there > 0) & (share > 0), there * F.log(there / (total[label] * share))).otherwise(0.0)
    return 2 * found


def sure_from(steps: list[tuple[int, int, int]], false_share: float) -> float:
    """The least log-likelihood ratio of which at most ``false_share`` of the words above are there by chance.

    ``steps`` are the numbers of words by four times their ratio, rounded down, and four times
    the ratio that they had if all their texts were toxic: words that cannot reach a ratio
    at all are none that could by chance. By chance a ratio is as large with the probability of
    a squared normal.
    """
    least = math.inf
    for step in sorted({s for s, _, _ in steps if s > 0}, reverse=True):
        above = sum(n for s, _, n in steps if s >= step)
        tried = sum(n for _, most, n in steps if most >= step)
        if tried * math.erfc(math.sqrt(step / 8)) <= false_share * above:
            least = step / 4
    return least


def learn_lexicon(sample: DataFrame, least: float = 2.0, odds: float = 20.0, false_share: float = 0.05) -> Lexicon:
    """Terms and stems that mark toxic texts, from a bounded sample of labelled texts.

    A term is taken if it is in ``least`` toxic texts or more, whatever their share, and
    ``odds`` times as often there as in others, with a log-likelihood ratio so large that
    of all words with such a ratio at most ``false_share`` are expected by chance, which
    follows the sample at any size (see ``sure_from``): a language or source may hold a small share of the toxic texts. A stem is the longest beginning that five such
    words or more have in common. Texts count less the more near copies they have, told by
    the smallest hashes of their word triples, or else the words of one copied text would
    be terms. Terms that begin with a stem stay, for their misspellings. Words of clean texts
    within the edits of a term or stem are exceptions.
    """
    numbered = stage(sample.withColumn("row", F.monotonically_increasing_id()))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            least = []
            for value in batch.column(1).to_pylist():
                words = WORD.findall(value.lower())
                triples = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
                least.append(
                    [min(xxhash.xxh64_intdigest(t, seed) >> 1 for t in triples) for seed in range(4)]
                )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(least, pa.list_(pa.int64()))], names=["row", "keys"])

    keyed = numbered.select("row", "text").mapInArrow(keys, "row long, keys array<long>")
    each = stage(keyed.select("row", F.posexplode("keys").alias("at", "key")))
    copies = each.join(each.groupBy("at", "key").count(), ["at", "key"]).groupBy("row").agg(F.max("count").alias("n"))
    weighed = stage(numbered.join(copies, "row").select("label", (1 / F.col("n")).alias("w"), "text"))
    total = {r["label"]: r["w"] for r in weighed.groupBy("label").agg(F.sum("w").alias("w")).collect()}
    if not total.get(1) or not total.get(0):
        return Lexicon({}, {})

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {(kind, label): Counter() for kind in ("word", "stem") for label in (0, 1)}
        for batch in batches:
            for label, w, value in zip(*(c.to_pylist() for c in batch.columns)):
                words = {x for x in WORD.findall(value.lower()) if not x.isdigit()}
                stems = {x[:n] for x in words for n in STEM_SIZES if len(x) > n}
                for kind, found in (("word", words), ("stem", stems)):
                    into = sums[kind, label]
                    for x in found:
                        into[x] += w
        rows = [(kind, x, label, w) for (kind, label), c in sums.items() for x, w in c.items()]
        for at in range(0, len(rows), 100_000):
            columns = zip(*rows[at : at + 100_000])
            kinds = (pa.string(), pa.string(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["kind", "x", "label", "w"])

    made = weighed.mapInArrow(counts, "kind string, x string, label int, w double")
    summed = stage(
        made.groupBy("kind", "x").agg(
            F.sum(F.when(F.col("label") == 1, F.col("w")).otherwise(0.0)).alias("toxic"),
            F.sum(F.when(F.col("label") == 0, F.col("w")).otherwise(0.0)).alias("clean"),
        )
    )
    share, other = F.col("toxic") / total[1], (F.col("clean") + 0.5) / total[0]
    words = summed.filter("kind = 'word'")
    begun = words.filter("toxic > 0 and clean < toxic").select(
        F.explode(F.array(*[F.when(F.length("x") > n, F.substring("x", 1, n)) for n in STEM_SIZES])).alias("x")
    )
    begun = begun.filter("x is not null").groupBy("x").count()
    ratio = likelihood(F.col("toxic"), F.col("clean"), total)
    marked = F.when((F.col("toxic") >= least - 1e-6) & (share >= odds * other), ratio).otherwise(0.0)
    texts = F.col("toxic") + F.col("clean")
    possible = likelihood(F.least(texts, F.lit(float(total[1]))), F.lit(0.0), total)
    steps = summed.filter("kind = 'word'").groupBy(
        F.floor(4 * marked).cast("int").alias("step"), F.floor(4 * possible).cast("int").alias("most")
    ).count()
    # no more rows than words of the bounded sample
    sure = sure_from([tuple(r) for r in steps.collect()], false_share)
    telling = ratio >= sure
    # weights such as thirds do not add up to whole numbers
    marking = summed.filter((F.col("toxic") >= least - 1e-6) & (share >= odds * other) & telling).withColumn("odds", F.log(share / other))
    # the sample is bounded, so its words in so many texts are too
    terms = {r["x"]: r["odds"] for r in marking.filter("kind = 'word'").collect()}
    stems = marking.filter("kind = 'stem'").join(begun, "x").filter("count >= 5")
    longest: dict[str, float] = {}
    rows = {r["x"]: (r["toxic"], r["odds"]) for r in stems.collect()}
    for x in sorted(rows, key=lambda x: (len(x), x)):
        if any(x.startswith(s) for s in longest):
            continue
        best = x
        while more := [y for y in rows if len(y) == len(best) + 1 and y.startswith(best) and rows[y][0] >= 0.97 * rows[x][0]]:
            best = more[0]
        longest[best] = rows[best][1]
    terms = {t: v for t, v in terms.items() if len(t) > 2}
    top = max([*terms.values(), *longest.values()], default=1.0)
    terms, longest = ({x: v / top for x, v in d.items()} for d in (terms, longest))
    first = Lexicon(terms, longest)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [x for x in batch.column(0).to_pylist() if x not in first.terms and (m := first.match(x)) and m[1]]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string())], names=["x"])

    clean = words.filter("clean > 0").select("x").mapInArrow(alike, "x string")
    return Lexicon(terms, longest, frozenset(r["x"] for r in clean.collect()))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, keep: list, key: str = "doc_id", text: str = "text", label: str = "toxic",
    per_label: int = 4000,
) -> DataFrame:
    """Score every whole text from 0 to 1, beside the columns ``keep``.

    The lexicon, and a logistic regression on the hits of a text, are learned from at most
    ``per_label`` labelled texts of each kind that are not held out. Texts are all that is
    scored: NULL and empty ones have no hits. With one kind of label only, or none, all
    scores are 0. Rows are independent, so repeated ones and NULL keys stay. An empty table
    gives no rows. Returns ``keep``, ``score`` and ``hits`` (weighed, log). Rows whose columns
    may have these names are kept as one struct.
    """
    sample = labelled_texts(docs, labels, label, per_label, key, text)
    lexicon = learn_lexicon(sample)
    terms, stems, exceptions = lexicon.terms, lexicon.stems, lexicon.exceptions
    sent = docs.sparkSession.sparkContext.broadcast((terms, stems, exceptions))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Lexicon(*sent.value))
        for batch in batches:
            found = np.array([scorer.features(t.as_py()) for t in batch.column(batch.num_columns - 1)]).reshape(-1, 4)
            columns = [pa.array(c) for c in found.T]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *NAMES])

    def featured(rows: DataFrame) -> DataFrame:
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
        return rows.mapInArrow(features, kinds + "".join(f", {n} double" for n in NAMES))

    got = np.array([tuple(r) for r in featured(sample.select("label", "text")).collect()]).reshape(-1, 5)
    names = NAMES
    if len(set(got[:, 0])) == 2:
        model = Logistic(got[:, 1:], got[:, 0])
        each = zip(names, model.mean, model.scale, model.w[1:])
        z = sum(((F.col(n) - float(m)) * float(w / s) for n, m, s, w in each), F.lit(float(model.w[0])))
        score = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))
    else:
        score = F.lit(0.0)
    scored = featured(docs.select(*keep, F.col(text).alias("_text")))
    return scored.select(*scored.columns[:-4], score.alias("score"), F.col(NAMES[0]).alias("hits"))
