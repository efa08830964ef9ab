"""Toxicity and quality: the learned operators."""

import random
from itertools import product

import numpy as np
import pytest
from helpers import clashing, odd_docs, prose
from pyspark.sql import functions as F

from salescast.llm.quality import Attention, FEATURES, bags, encode, passages, score_quality
from salescast.llm.queries import op2_toxicity, op3_quality
from salescast.llm.toxicity import Lexicon, Scorer, learn_lexicon, quotations, score_toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_levenshtein_distance():
    terms = {"idiot": 1.0, "trash": 1.0, "disgusting": 1.0, "scum": 1.0}
    lexicon = Lexicon(terms, {"vequ": 1.0}, frozenset({"thrash"}))
    draw = random.Random(2)
    words = set(terms) | {"vequité", "veq", "thrash", "vquité"}
    for _ in range(3000):
        w = list(draw.choice(list(terms)))
        for _ in range(draw.randint(0, 3)):
            at = draw.randrange(len(w) + 1)
            w[at : at + draw.randint(0, 1)] = draw.choice(["", "x", "s", "i"])
        words.add("".join(w))
    for w in words:
        want = {t: distance(w, t) for t in terms if w[:1] == t[0]}
        want = min(((d, t) for t, d in want.items() if d <= Lexicon.edits(t)), default=None)
        if w.startswith("vequ"):
            assert lexicon.match(w) == ("vequ", 0)
        elif want is None or w == "thrash":
            assert lexicon.match(w) is None
        elif want[0] <= 1:  # with more, edits at the first letter may tie
            assert lexicon.match(w) == (want[1], want[0])


def test_quotation_counts_less_than_abuse():
    scorer = Scorer(Lexicon({"idiot": 1.0}, {}))
    abuse = scorer.features("you are an idiot and will stay one")
    quoted = scorer.features('she said the word "idiot" was used')
    missing = scorer.features("nothing here")
    assert abuse[0] > quoted[0] > missing[0] == 0 and abuse[2] > 0 == quoted[2] and quoted[3] > 0
    assert scorer.features("you idi0t")[0] > 0 and scorer.features(None) == (0, 0, 0, 0)
    assert quotations('a "b" « c » d') == [(2, 5), (6, 11)]


def planted(spark, n=240):
    """Toxic texts have a bad word, in part misspelled; poor ones have one passage of junk."""
    draw = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        words = prose(i, 150).split()
        toxic, poor = i % 4 == 0, i % 3 == 0
        if toxic:
            for _ in range(4):
                words.insert(draw.randrange(len(words)), draw.choice(["grumlik", "zabbot"]))
        if poor:
            words[40:100] = [f"{w}###" for w in words[40:100]]
        docs.append((i, " ".join(words), "en", "a", 0))
        if i % 5:
            labels.append((i, int(not poor), int(toxic)))
    docs.append((9000, prose(1, 100) + " grumllik zabbott", "en", "a", 0))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(
        labels, "doc_id long, quality int, toxic int"
    )


def test_planted_labels_are_learned(spark):
    docs, labels = planted(spark)
    toxic = {r.doc_id: r.score for r in score_toxicity(docs, labels, ["doc_id"]).collect()}
    good = {r.doc_id: r.score for r in score_quality(docs, labels, ["doc_id"]).collect()}
    assert all((toxic[i] >= 0.5) == (i % 4 == 0) for i in range(240)) and toxic[9000] >= 0.5
    assert sum((good[i] >= 0.5) == (i % 3 != 0) for i in range(240)) > 230


@pytest.mark.parametrize("query, label", [(op2_toxicity, "toxic"), (op3_quality, "quality")])
def test_held_out_accuracy(spark, query, label):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(F.col(label).isNotNull())
    got = query(spark, folder).filter("held_out").join(labels, "doc_id")
    assert got.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0] > 0.97


def test_odd_rows(spark):
    _, labels = planted(spark)
    docs = clashing(odd_docs(spark))
    odd = labels.unionByName(spark.createDataFrame([(1, None, None), (None, 1, 1), (1, 0, 1), (1, 1, 0)], labels.schema))
    for score in (score_toxicity, score_quality):
        got = score(docs, odd, [F.struct("*").alias("_doc")])
        assert got.count() == docs.count() and got.filter("score is null or score < 0 or score > 1").count() == 0
        assert got.select("_doc.*").columns == docs.columns
        assert score(docs.limit(0), odd, ["doc_id"]).count() == 0
        assert score(docs, labels.limit(0), ["doc_id"]).count() == docs.count()


def test_passages_are_the_whole_text():
    for text in ("", "a", prose(1, 1000), "x" * 5000, " " * 900):
        assert "".join(passages(text)) == text
    assert passages(None) == [""] and len(encode("")) == FEATURES


def test_gradient_lowers_the_loss_and_matches_differences():
    draw = np.random.default_rng(0)
    x, starts = draw.normal(size=(30, FEATURES)), np.array([0, 4, 5, 12, 20])
    y = np.array([0, 1, 1, 0, 1.0])
    first, last = (Attention.fit(x, starts, y, steps=n, decay=0) for n in (1, 200))

    def loss(m):
        p = m.forward(x, starts)["score"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    assert loss(last) < 0.1 < loss(first)
    weights = last.forward(x, starts)["a"]
    assert np.add.reduceat(weights, starts) == pytest.approx(np.ones(5))


def test_misspelled_word_families(spark):
    """Words of one beginning are a stem; what is misspelled in the beginning is found as well."""
    lexicon = Lexicon({"bocoteka": 1.0}, {"achlich": 1.0, "boco": 1.0}, frozenset({"aclicht"}))
    assert lexicon.match("achlichen") == ("achlich", 0) and lexicon.match("achlixhen") == ("achlich", 1)
    assert lexicon.match("aclichen") == ("achlich", 1) and lexicon.match("aclicht") is None
    assert lexicon.match("bcoxxx") is None and lexicon.match("bicoteka") == ("bocoteka", 1)
    assert lexicon.match("bocoteka") == ("boco", 0) and lexicon.match("xchlichen") is None
    draw, family = random.Random(8), ["grumlika", "grumliko", "grumlike", "grumliku", "grumliki", "grumlikost"]
    docs, labels = [], []
    for i in range(240):
        words = prose(i, 150).split()
        if i % 4 == 0:
            for _ in range(4):
                words.insert(draw.randrange(len(words)), draw.choice(family))
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    docs.append((9000, prose(1, 100) + " grxmlika gumliko"))
    got = score_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), ["doc_id"])
    scores = {r.doc_id: r.score for r in got.collect()}
    assert scores[9000] >= 0.5 and all((scores[i] >= 0.5) == (i % 4 == 0) for i in range(240))


def test_language_with_few_toxic_texts(spark):
    """A word in 7 of 400 toxic texts (1.75 %) is a term, though another one is in all the others."""
    draw, docs, labels = random.Random(9), [], []
    for i in range(1600):
        words = prose(i, 60).split()
        if i % 4 == 0:
            words.insert(draw.randrange(len(words)), "zabbot" if i < 28 else "grumlik")
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    sample = spark.createDataFrame([(t, lab) for (_, t), (_, lab) in zip(docs, labels)], "text string, label int")
    lexicon = learn_lexicon(sample)
    assert {"zabbot", "grumlik"} <= lexicon.terms.keys() and len(lexicon.terms) < 6
