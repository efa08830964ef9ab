import random
import zlib
from collections import defaultdict

import numpy as np
from helpers import clashing, odd_docs, prose

from salescast.llm.packing import WordTokenizer, first_fit_decreasing, pack
from salescast.llm.queries import tokenizer_file


def brute_first_fit(lengths, capacity):
    room, out = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        if at == len(room):
            room.append(capacity)
        out.append((i, at, capacity - room[at]))
        room[at] -= lengths[i]
    return sorted(out)


def test_tournament_tree_is_first_fit_decreasing():
    draw = random.Random(1)
    for n in (0, 1, 2, 3, 7, 64, 300):
        lengths = np.array([draw.randint(1, 100) for _ in range(n)], np.int64)
        bins, offsets = first_fit_decreasing(lengths, 100)
        assert [(i, b, o) for i, (b, o) in enumerate(zip(bins.tolist(), offsets.tolist()))] == brute_first_fit(lengths.tolist(), 100)


def test_pieces_of_words_are_the_whole_text():
    words = WordTokenizer(tokenizer_file())
    texts = [
        "İstanbul' IT'S it's don't <|endoftext|>x ΑΣ ας café's ª µ 12ab AB12 -a 'tis ß ŉ \x1c a\x1cb 漢字 🙂x \t a\r\nb",
        "", " ", None, "é ́x a b", "word### WORD!! (x) «mot» naïve, Ünïted... ''' 's", "x" * 5000,
    ]
    for text in texts * 2:
        whole = words.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(words.encode(text), "<u4").tolist() == whole


def check_round_trip(rows, docs, capacity):
    words = WordTokenizer(tokenizer_file())
    want = sorted(words.encode(t) + (2).to_bytes(4, "little") for t in docs)
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        assert r.length > 0
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    found = sorted((r.doc_tokens, r.start, r.length, r.ids_crc32) for r in rows)
    made = sorted(
        (len(ids) // 4, s, min(capacity, len(ids) // 4 - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)]))
        for ids in want
        for s in range(0, len(ids) // 4, capacity)
    )
    assert found == made
    return bins


def test_round_trip_and_padding(spark):
    docs = [(i, prose(i, 1 + i * 13 % 900)) for i in range(150)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bins = check_round_trip(pack(frame, tokenizer_file(), capacity=512, group_pieces=100).collect(), [t for _, t in docs], 512)
    tokens = sum(length for b in bins.values() for _, length in b)
    assert tokens / (512 * len(bins)) > 0.95


def test_odd_rows(spark):
    docs = clashing(odd_docs(spark))
    rows = pack(docs, tokenizer_file()).collect()
    check_round_trip(rows, [r.text for r in docs.select("text").collect()], 4096)
    assert pack(docs.limit(0), tokenizer_file()).count() == 0
