import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import clashing, odd_docs, prose
from tokenizers import Tokenizer

import sentencepiece
from salescast.llm import alignment as A
from salescast.llm.queries import op12_alignment, tokenizer_file

FILES = [tokenizer_file(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
ODD = [
    "<|endoftext|> and <s></s> <unk> <0x41>", "a▁b", "▁", " ", "\n\n\t x  y  z", "x" * 3000, "1" * 900 + " " * 700, "\u0000a\x1cb",
    "İstanbul naïve é ́x 漢字🙂 ÀÉÎ 'tis don't WE'LL", "a" * 5 + "�", "﻿start", None, "",
]


def brute(texts):
    """Per text: n_a, n_b, n_groups, n_links, groups, n_best, count_sum; by plain loops over bytes."""
    whole, pieces = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    whole.encode_special_tokens = True
    letters = {c: b for b, c in A.byte_letters().items()}
    spans, counts = [], Counter()
    for text in texts:
        a = whole.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        as_bytes = [
            [bytes(letters[c] for c in whole.id_to_token(i)) for i in a],
            [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b],
        ]
        if any(b"".join(x) != b" " + (text or "").encode() for x in as_bytes):
            a, b, as_bytes = [], [], [[], []]
        ends = [np.cumsum([len(x) for x in each]).tolist() for each in as_bytes]
        linked, j = [], 0
        for i, end in enumerate(ends[0]):
            start = ends[0][i - 1] if i else 0
            while ends[1][j] <= start:
                j += 1
            k = j
            while k < len(b) and (ends[1][k - 1] if k else 0) < end:
                linked.append((a[i], b[k]))
                k += 1
        counts.update(linked)
        cuts, groups, last = sorted(set(ends[0]) & set(ends[1])), [], 0
        for cut in cuts:
            one = [",".join(str(t) for t, e in zip(ids, es) if last < e <= cut) for ids, es in zip((a, b), ends)]
            groups.append("|".join(one))
            last = cut
        spans.append((len(a), len(b), len(groups), linked, ";".join(groups)))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [
        (na, nb, ng, len(li), sum(counts[p] == most[p[1]] for p in li), sum(counts[p] for p in li), g)
        for na, nb, ng, li, g in spans
    ]


def rows(found):
    return sorted((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in found.collect())


@pytest.mark.parametrize("room", [500_000, 300, 0])
def test_against_brute_force(spark, monkeypatch, room):
    monkeypatch.setattr(A, "ROUND", 5000)
    texts = [*ODD, *[prose(i, 1 + 37 * i % 400) for i in range(40)], *[ODD[0]] * 5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = brute(texts)
    assert rows(A.align(docs, *FILES, room=room)) == sorted(want)
    assert any(w[0] == 0 for w, t in zip(want, texts) if t) and all(w[0] for w, t in zip(want, texts) if t and "▁" not in t)
    digests = {r.doc_id: r.groups for r in A.align(docs, *FILES, digest=True).collect()}
    assert digests == {i: hashlib.sha256(w[-1].encode()).hexdigest() if w[0] else "" for i, w in enumerate(want)}


def test_long_texts_have_lanes(monkeypatch):
    draw, pair = random.Random(4), A.pair_of(*FILES)
    texts = [" ".join(draw.choice(["x" * draw.randint(1, 90), " ", "漢字", "tion"]) for _ in range(3000)), "short one", "y " * 2000]
    whole = A.aligned(pair, texts, False)
    for lane in (1, 7, 1 << 30):
        monkeypatch.setattr(A, "LANE", lane)
        found = A.aligned(pair, texts, False)
        for x, y in zip(whole, found):
            assert all(np.array_equal(a, b) for a, b in zip(x, y))


def test_numbers_that_do_not_fit_are_parted(spark, monkeypatch):
    texts = ["a a a a a a a a a a a a a a a a a a a b", "c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = rows(A.align(docs, *FILES))
    monkeypatch.setattr(A, "MOST_TIMES", 4)
    pair = A.pair_of(*FILES)
    codes = A.aligned(pair, texts, False)[5][0]
    assert (codes >> (2 * A.ID_BITS)).max() == 3 and (codes >> (2 * A.ID_BITS)).sum() == 20 and want == sorted(brute(texts))


def test_merges_in_another_order_go_through_the_whole_tokenizer():
    import json

    said = json.load(open(FILES[0], encoding="utf-8"))
    assert A.ranked(said)
    said["model"]["merges"][:2] = said["model"]["merges"][1::-1]
    assert not A.ranked(said)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    want = rows(A.align(docs, *FILES))
    assert rows(A.align(clashing(docs).withColumn("codes", docs.text), *FILES)) == want
    assert want == sorted(brute([r.text for r in docs.collect()]))
    assert A.align(docs.limit(0), *FILES).count() == 0


def test_query_over_all_documents(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = {i: w for i, w in zip(texts, brute(list(texts.values())))}
    found = op12_alignment(spark, folder).collect()
    assert len(found) == len(want)
    for r in found:
        w = want[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == w[:6]
        assert r.groups_sha256 == (hashlib.sha256(w[6].encode()).hexdigest() if w[0] else "")
