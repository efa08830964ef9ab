import duckdb
import pytest
from helpers import clashing, odd_docs, prose
from pyspark.sql import functions as F

from salescast.llm.mixing import mix, targets, word_count
from salescast.llm.order import sums_ahead
from salescast.llm.queries import QUERIES
from salescast.llm.sql import MIX


def brute_targets(sizes, cycle=(5, 2, 1), limit=3):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: cycle[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left, open_ = total - sum(fixed.values()), [s for s in sizes if s not in fixed]
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > limit * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: limit * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 5, None: 100}, {"a": 0, "b": 0}, {"a": 7}, {"x": 1, "y": 2, "z": 3, "é": 100000, "Z": 0},
    {f"s{i}": i * i % 97 for i in range(40)},
])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in targets(frame).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_sources_come_near_their_targets(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", prose(i, 1 + i * 7 % 90)) for i in range(600)] + [(9999, "s0", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(7)
    got = mix(docs, word_count("text")).collect()
    again = mix(docs.repartition(2), word_count("text")).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    assert len(got) == 601 and all(0 <= r.taken <= 3 * r.size for r in got)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, abs=2 * max(r.size for r in own))


@pytest.mark.parametrize("name", ["op10_mixing"])
def test_query_against_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    found = connection.execute(MIX)
    columns = [c[0] for c in found.description]
    got = QUERIES[name](spark, folder).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(found.fetchall())


def test_odd_rows(spark):
    docs = clashing(odd_docs(spark))
    got = mix(docs, word_count("text"))
    assert got.count() == docs.count() and {r.target for r in got.collect()} != {"own target"}
    assert {r.source_size for r in got.filter("source is null").collect()} == {100}
    assert mix(docs.limit(0), word_count("text")).count() == 0


def test_sums_ahead(spark):
    frame = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v")).repartition(6)
    got = sums_ahead(frame, [F.col("v")], ["v"]).collect()
    assert all(r.v_ahead == r.v * (r.v - 1) // 2 for r in got)
