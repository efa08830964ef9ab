import random

import numpy as np
import pytest
from helpers import clashing, odd_docs, prose

from salescast.llm import jaccard as J
from salescast.llm.graph import components


def shingle_set(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(docs, n, percent):
    """Smallest reachable id of each (id, text)."""
    sets = [(i, shingle_set(t, n)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                one, two = find(i), find(j)
                root[max(one, two)] = min(one, two)
    return {i: (len(s), find(i)) for i, s in sets}


def family(seed, base, copies, most):
    """Near copies on both sides of the threshold."""
    draw = random.Random(seed)
    made = []
    for _ in range(copies):
        words = base.split()
        for _ in range(draw.randint(0, max(1, int(len(words) * most)))):
            words[draw.randrange(len(words))] = f"new{draw.random()}"
        made.append(" ".join(words))
    return made


@pytest.mark.parametrize("words, percent, block", [(4, 85, 512), (5, 80, 3)])
def test_components_against_brute_force(spark, monkeypatch, words, percent, block):
    monkeypatch.setattr(J, "BLOCK", block)
    texts = [prose(1000 + i, 3 + i) for i in range(40)]
    for i, size in enumerate((5, 9, 14, 20, 33, 60, 120, 400, 900)):
        texts += family(i, prose(i, size), 14, 0.06)
    texts += [texts[3].upper(), " ".join(texts[50].split()), "", None, "one", "ONE", "one two"]
    docs = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(frame, words=words, percent=percent).collect()}
    assert got == brute(docs, words, percent)


def test_similar_sets_share_a_signature():
    draw = np.random.default_rng(1)
    for size in (3, 7, 12, 13, 20, 30, 50, 90, 200, 700, 3000):
        for _ in range(30):
            a = np.unique(draw.integers(0, 1 << 63, size, dtype=np.uint64))
            drop = draw.integers(0, max(1, int(0.16 * len(a))) + 1)
            b = a[drop:]
            extra = draw.integers(0, 3)
            b = np.unique(np.concatenate([b, draw.integers(0, 1 << 63, extra, dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 85 * (len(a) + len(b) - common) and len(np.setxor1d(a, b)):
                assert len(np.intersect1d(J.signatures(a, 85), J.signatures(b, 85)))


def test_odd_rows(spark):
    docs = clashing(odd_docs(spark))
    got = J.jaccard_components(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert by[1] == [(57, 1), (57, 1)] and by[7] == [(57, 1)]
    assert by[2] == [(0, 2)] and by[3] == [(0, 3)] and by[5] == [(0, 5)]
    assert sorted(by[None], key=str) == [(0, None), (37, None)]
    assert J.jaccard_components(docs.limit(0)).count() == 0


def test_null_keys_link_others(spark):
    base = prose(1, 100)
    a, b = family(5, base, 2, 0.01)
    rows = [(None, base), (5, a), (9, b), (9, prose(77, 50))]
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.n_shingles == 97 and r.doc_id) == [(5, 5), (9, 5)]
    assert [r.component_id for r in got if r.doc_id is None] == [5]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 500)]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 130)}


def test_sketches_rule_out_no_similar_pair():
    draw = np.random.default_rng(3)
    for size in (1, 5, 40, 300, 9000):
        a = np.unique(draw.integers(0, 1 << 63, size, dtype=np.uint64))
        for share in (0, 0.05, 0.5):
            b = np.unique(np.concatenate([a[int(share * len(a)):], draw.integers(0, 1 << 63, int(share * size) + 1, dtype=np.uint64)]))
            one, two = J.sketch(a), J.sketch(b)
            least = min(len(one), len(two))
            apart = int(np.bitwise_count(J.folded(one, least) ^ J.folded(two, least)).sum())
            assert apart <= len(np.setxor1d(a, b))


def test_only_pairs_across_components_are_made(spark):
    sets = [(i, np.unique(np.random.default_rng(i % 9).integers(0, 1 << 63, 100, dtype=np.uint64))) for i in range(30)]
    frame = spark.createDataFrame([(i, len(h), bytearray(J.sketch(h).tobytes())) for i, h in sets], "id long, n long, sketch binary")
    labelled = spark.createDataFrame([(1, i, i % 4) for i in range(30)] + [(2, 0, 0), (2, 4, 0)], "sig long, id long, root long")
    got = {tuple(r) for r in J.pairs_across(labelled, frame, 85).collect()}
    assert got == {(i, j) for i in range(30) for j in range(i) if i % 9 == j % 9 and i % 4 != j % 4}


def test_arrow_batches_are_bounded(spark):
    from salescast.llm.batches import MOST, SETTING, bound_batches

    before = spark.conf.get(SETTING)
    for given, want in (("64m", str(MOST)), ("1m", "1m"), ("2048kb", "2048kb"), ("67108864b", str(MOST))):
        spark.conf.set(SETTING, given)
        bound_batches(spark)
        assert spark.conf.get(SETTING).removesuffix("b") == want.removesuffix("b")
    spark.conf.set(SETTING, before)


def test_more_links_join_known_components(spark):
    import random

    from salescast.llm.graph import components
    from salescast.llm.jaccard import joined

    draw = random.Random(8)
    links = [(draw.randint(0, 60), draw.randint(0, 60)) for _ in range(50)]
    frame = lambda some: spark.createDataFrame(some, "a long, b long")
    for cut in (0, 20, 45, 50):
        found = joined(components(frame(links[:cut])), frame(links[cut:]))
        want = {r.id: r.root for r in components(frame(links)).collect()}
        got = {r.id: r.root for r in found.collect()}
        assert found.count() == len(got) and got == want


def test_texts_are_moved_only_for_pairs_that_sketches_leave_open(spark, monkeypatch, join_way):
    texts = [prose(2000 + i, 60) for i in range(12)]
    texts += [t + " more" for t in texts[:4]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = J.stage(J.sets_of(docs, "doc_id", "text", 4))
    ids = {r.key: r.id for r in sets.collect()}
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    wanted = []

    def noted(some, *rest, made=J.texts_of):
        wanted.extend(r.id for r in some.collect())
        return made(some, *rest)

    monkeypatch.setattr(J, "texts_of", noted)
    frame = spark.createDataFrame([(ids[i], ids[j]) for i, j in pairs], "a long, b long")
    got = {(r.a, r.b): r.similar for r in J.verified(frame, sets, J.each_once(sets), docs, "doc_id", "text", 4, 85).collect()}
    assert got == {(ids[i], ids[j]): i == j + 12 for i, j in pairs}
    assert sorted(wanted) == sorted(ids[i] for i in (0, 1, 2, 3, 12, 13, 14, 15))


def test_sets_that_share_a_signature_only_move_no_texts(spark, monkeypatch):
    draw, base = random.Random(9), prose(5, 60).split()
    texts = []
    for _ in range(40):
        words = list(base)
        for place in draw.sample(range(4, 56), 2):
            words[place] = f"new{draw.random()}"
        texts.append(" ".join(words))
    other = prose(6, 80)
    texts += [other, other + " more"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = {r.key: r.id for r in J.sets_of(docs, "doc_id", "text", 4).collect()}
    found = {(r.a, r.b) for r in J.candidates(docs, "text", 4, 85).collect()}
    near = [(i, j) for i in range(42) for j in range(i) if (brute([(0, texts[j]), (1, texts[i])], 4, 85))[1][1] == 0]
    moved = set()

    def noted(some, *rest, made=J.texts_of):
        moved.update(r.id for r in some.collect())
        return made(some, *rest)

    monkeypatch.setattr(J, "texts_of", noted)
    got = {r.doc_id: r.component_id for r in J.jaccard_components(docs).collect()}
    assert got == {i: want for i, (_, want) in brute(list(enumerate(texts)), 4, 85).items()}
    assert len(found) > 5 and moved == {ids[i] for pair in near for i in pair}


def test_shuffles_of_what_is_staged_are_removed(spark):
    import time

    cleaned = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files, names = manager.getAllFiles(), []
        for i in range(files.size()):
            names.append(files.apply(i).getName())
        return {n for n in names if n.startswith("shuffle_")}

    before = shuffles(), spark.conf.get(cleaned, "false")
    kept = J.stage(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count())
    for _ in range(50):
        if not (left := shuffles() - before[0]):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(cleaned, "false") == before[1]
    assert sorted(r["count"] for r in kept.collect()) == [142, 143, 143, 143, 143, 143, 143]
