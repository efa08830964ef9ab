import random
from collections import Counter

from helpers import clashing, odd_docs
from pyspark.sql import functions as F

from salescast.llm import langid
from salescast.llm.langid import grams_of, identify, learn_profiles, words_of
from salescast.llm.queries import op7_language


def brute_profiles(docs, length):
    counts = {}
    for lang, text in docs:
        if lang is not None and text is not None:
            c = counts.setdefault(lang, Counter())
            for w, n in words_of(text).items():
                for g in grams_of(w):
                    c[g] += n
    return {lang: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:length]] for lang, c in counts.items()}


def brute_predict(text, profiles, length):
    counts = Counter()
    for w, n in words_of(text).items():
        for g in grams_of(w):
            counts[g] += n
    if not counts or not profiles:
        return "und", 0.0
    own = [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:length]]
    away = {}
    for lang, profile in profiles.items():
        place = {g: i for i, g in enumerate(profile)}
        away[lang] = sum(abs(place[g] - i) if g in place else length for i, g in enumerate(own))
    best = min(away, key=lambda x: (away[x], x))
    return best, 1 - away[best] / (length * len(own))


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 9000").select("doc_id", "lang", "text")
    for length in (30, 400):
        profiles = learn_profiles(docs, length=length)
        rows = docs.collect()
        want = brute_profiles([(r.lang, r.text) for r in rows], length)
        got = {}
        for r in sorted(profiles.collect(), key=lambda r: r["rank"]):
            got.setdefault(r.lang, []).append(r.gram)
        assert got == want
        found = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs, profiles, ["doc_id"], length=length).collect()}
        for r in rows:
            lang, score = brute_predict(r.text, want, length)
            assert found[r.doc_id][0] == lang and abs(found[r.doc_id][1] - score) < 1e-12


def test_letters_of_any_kind_and_parts_of_long_texts(monkeypatch):
    draw = random.Random(3)
    letters = "abcdeéßşжяא漢字" + "𐐨𐐩𐑎𝒶"
    texts = [" ".join("".join(draw.choices(letters[:n], k=draw.randint(1, 7))) for _ in range(m)) for n, m in ((5, 80), (12, 400), (17, 300), (17, 1))]
    texts += ["Aa aa A", "𐐀𐐨 𐐀 b", "x" * 3000, "1 2 _ !", "İstanbul ǅ ﬁ", ""]
    counts = [Counter(g for w, n in words_of(t).items() for g in grams_of(w) for _ in range(n)) for t in texts[:3]]
    for length in (20, 400):
        profiles = {f"l{i}": [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:length]] for i, c in enumerate(counts)}
        listed = [(lang, g, i) for lang, grams in profiles.items() for i, g in enumerate(grams)]
        for part, alphabet in ((200_000, 0xFFFF), (7, 0xFFFF), (7, 3)):
            monkeypatch.setattr(langid, "PART_WORDS", part)
            monkeypatch.setattr(langid, "ALPHABET", alphabet)
            ranker = langid.Ranker(listed, length)
            for text in [*texts, None]:
                lang, score = brute_predict(text, profiles, length)
                found = ranker.predict(text)
                assert found[0] == lang and abs(found[1] - score) < 1e-12
    assert langid.Ranker([("l", "𐐨", 0)], 5).predict("a b 𐐨")[0] == "l" and langid.Ranker([("l", "𐐨", 0)], 5).predict("a")[0] == "l"


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    got = op7_language(spark, folder).filter("held_out").join(truth.filter("lang is not null"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_odd_rows(spark):
    docs = clashing(odd_docs(spark))
    profiles = learn_profiles(docs)
    got = identify(docs, profiles, ["doc_id", "rank"]).collect()
    assert len(got) == docs.count()
    assert {r.lang_pred for r in got if r.doc_id in (2, 3, 5, 6)} == {"und"}
    nothing = learn_profiles(docs.limit(0))
    assert {r.lang_pred for r in identify(docs, nothing, ["doc_id"]).collect()} == {"und"}
    assert identify(docs.limit(0), profiles, ["doc_id"]).count() == 0
