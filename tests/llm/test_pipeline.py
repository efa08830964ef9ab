from helpers import clashing, odd_docs

import corpus_pipeline as P
from salescast.llm.packing import WordTokenizer
from salescast.llm.queries import QUERIES, op6_search, tokenizer_file
from salescast.llm.secrets import spans
from salescast.llm.sql import SEARCH
from salescast.llm.toxicity import score_toxicity
from test_jaccard import brute
from test_mixing import brute_targets

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{FOLDER}/labels.parquet")
    bad = {r.doc_id for r in score_toxicity(docs, labels, ["doc_id"]).collect() if r.score >= 0.5}
    kept = P.stage(P.without_toxic(spark, docs, FOLDER))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - bad and bad
    one = P.stage(P.without_near_copies(spark, kept, FOLDER))
    groups = brute([(r.doc_id, r.text) for r in kept.collect()], P.WORDS, P.PERCENT)
    assert {r.doc_id for r in one.collect()} == {g for _, g in groups.values()}
    clean = P.stage(P.without_secrets(spark, one, FOLDER))
    texts = {r.doc_id: r.text for r in one.collect()}
    for r in clean.collect():
        assert r.n_chars == len(r.text) and (r.text == texts[r.doc_id]) == (not spans(texts[r.doc_id], 10.0))
    taken = P.stage(P.mixed(spark, clean, FOLDER))
    sizes = {}
    for r in clean.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.encode().split())
    got = {}
    for r in taken.collect():
        got[r.source] = got.get(r.source, 0) + len(r.text.encode().split())
    longest = max(len(r.text.encode().split()) for r in clean.collect())
    for source, target in brute_targets(sizes).items():
        assert abs(got.get(source, 0) - target) <= 2 * longest
    for frame in (kept, one, clean, taken):
        assert frame.columns == columns
    words = WordTokenizer(tokenizer_file())
    tokens = sum(len(words.encode(r.text)) // 4 + 1 for r in taken.collect())
    assert sum(r.length for r in P.packed(spark, taken, FOLDER).collect()) == tokens


def test_stages_take_odd_rows(spark):
    docs = clashing(odd_docs(spark))
    for frame in (docs, docs.limit(0)):
        for _, step in P.STAGES[:-1]:
            frame = P.stage(step(spark, frame, FOLDER))
            assert frame.columns == docs.columns
        P.packed(spark, frame, FOLDER).collect()
    one = P.without_near_copies(spark, docs, FOLDER)
    # rows of one text: 1, 1 and 7; the other eight stay
    assert one.count() == 9


def test_run_and_registration(spark):
    assert P.run(spark, FOLDER).count() > 0
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_search_against_sql(spark):
    import duckdb

    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    found = connection.execute(SEARCH)
    columns = [c[0] for c in found.description]
    assert sorted(map(tuple, op6_search(spark, FOLDER).select(columns).collect())) == sorted(found.fetchall())
