import hashlib
import math
import random
import re
from collections import Counter

import pytest
import xxhash
from helpers import as_rows, clashing, odd_docs, prose
from pyspark.sql import functions as F

from salescast.llm import fingerprints as fp
from salescast.llm.queries import op1_fingerprints


def mix(h, seed):
    first = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42)
    return xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), first)


def words(text):
    return {w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w}


def brute_lexicon(texts, band=fp.BAND):
    counts = Counter(w for t in texts for w in words(t))
    low, high = math.log(1 / band[0]), math.log(1 / band[1])
    return {w for w, n in counts.items() if low <= math.log(len(texts) / n) <= high}


def brute_print(text, lexicon):
    slots, whole = [None] * fp.SLOTS, 0
    for w in words(text):
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        whole ^= h
        if w not in lexicon:
            continue
        lot, value, at = mix(h, 7), mix(h, 11) & 0xFFFFFFFF, 0
        for shift, (parts, taken) in zip((0, 8, 24), fp.SUBSETS):
            part = lot >> shift & parts - 1
            if part < taken:
                slots[at + part] = (slots[at + part] or 0) ^ value
            at += taken
    if all(s is None for s in slots):
        return f"~{whole:016x}"
    return "".join("." * 8 if s is None else f"{s:08x}" for s in slots)


def brute_likeness(a, b):
    if a[0] == "~" or b[0] == "~":
        return float(a == b)
    found, at = 0.0, 0
    for level, (_, taken) in enumerate(fp.SUBSETS):
        pairs = [(a[8 * i : 8 * i + 8], b[8 * i : 8 * i + 8]) for i in range(at, at + taken)]
        pairs = [p for p in pairs if p != (fp.EMPTY, fp.EMPTY)]
        if len(pairs) >= (1 if level == 0 else fp.ENOUGH):
            found = sum(x == y for x, y in pairs) / len(pairs)
        at += taken
    return found


def test_query_against_brute_force(spark, tmp_path):
    texts = [prose(i, 5 + 37 * i % 160) for i in range(60)] + ["", "x", prose(3, 80)]
    texts[10] = texts[9]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op1_fingerprints(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    lexicon = brute_lexicon(texts)
    prints = [brute_print(t, lexicon) for t in texts]
    for i, text in enumerate(texts):
        q, after = len(text) // 4, texts[(i + 1) % len(texts)]
        edited = text[: len(text) - q] + after[:q]
        r = got[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == prints[i] and r.edited_fingerprint == brute_print(edited, lexicon)
        assert r.near_edited == pytest.approx(brute_likeness(prints[i], r.edited_fingerprint))
        assert r.near_next == pytest.approx(brute_likeness(prints[i], prints[(i + 1) % len(texts)]))
    assert got[10].fingerprint == got[9].fingerprint


def test_both_ways_to_join_agree(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i % 7, 40)) for i in range(30)], "doc_id long, text string")
    known = fp.lexicon(docs)
    small = as_rows(fp.fingerprint(docs, known, ["text"], ["doc_id"]))
    monkeypatch.setattr("salescast.operators.joins.MAX_BROADCAST_ROWS", 0)
    assert as_rows(fp.fingerprint(docs, known, ["text"], ["doc_id"])) == small


def test_odd_rows(spark):
    docs = clashing(odd_docs(spark)).withColumn("place", F.monotonically_increasing_id())
    known = fp.lexicon(docs)
    got = {r.place: r.text for r in fp.fingerprint(docs, known, ["text"], ["place"]).collect()}
    assert len(got) == docs.count()
    texts = {r.place: r.text for r in docs.collect()}
    for a in got:
        assert (got[a] == got[a] and got[a] is not None) and ((texts[a] or "") != "" or got[a] == "~" + "0" * 16)
    assert fp.fingerprint(docs.limit(0), known, ["text"], ["place"]).count() == 0
    assert fp.lexicon(docs.limit(0)).count() == 0


def test_next_over_null_and_equal_keys(spark):
    rows = [(None, "a"), (1, "b"), (1, "c"), (None, None), (9, "d")]
    docs = spark.createDataFrame(rows, "k long, v string")
    got = as_rows(fp.with_next(docs, "k", "v").select("k", "v", "_next"))
    assert got == sorted([(None, None, "a"), (None, "a", "b"), (1, "b", "c"), (1, "c", "d"), (9, "d", None)], key=repr)


def test_plan_has_no_python(spark):
    plan = op1_fingerprints(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    for name in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"):
        assert name not in plan


def test_large_group_of_near_copies(spark, tmp_path):
    """A third of the rows are copies of one text with one word replaced: none of its terms is in the lexicon."""
    draw, base = random.Random(4), prose(500, 400).split()
    texts = [prose(i, 150) for i in range(120)]
    for i in range(60):
        copy = list(base)
        copy[draw.randrange(400)] = f"other{i}"
        texts.append(" ".join(copy))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op1_fingerprints(spark, str(tmp_path)).collect()}
    copies = [got[i] for i in range(120, 179)]
    assert all(r.fingerprint[0] == "~" and len(r.fingerprint) == 8 * fp.SLOTS + 1 for r in copies)
    assert all(r.near_next > 0.5 for r in copies) and min(r.near_edited for r in copies) > 0.3
    assert all(got[i].fingerprint[0] != "~" for i in range(120)) and got[119].near_next == 0
    pairs = spark.createDataFrame([("~" + "0" * 16, "~" + "0" * 16), ("~" + "0" * 16, copies[0].fingerprint), (got[0].fingerprint, copies[0].fingerprint)], "a string, b string")
    assert [r[0] for r in pairs.select(fp.likeness(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]
