import random
import re
from collections import Counter
from itertools import permutations

import duckdb
from helpers import clashing, odd_docs, prose

from salescast.llm.interaction import audit_documents, prefixes
from salescast.llm.queries import op11_interaction
from salescast.llm.sql import INTERACTION

LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    """One row for each part, order and step, by running the filters over the documents."""
    good, toxic = ({i for i, *y in labels if y[at] == 1 and i is not None} for at in (0, 1))
    rows, least = [], {}
    for i, text, part in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and least[text] < i,
        }
        rows.append((part or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out, shapley = [], Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            alive = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in alive if f in r[1]]
                alive = [r for r in alive if f not in r[1]]
                mine = [r for r in rows if r[0] == part and f in r[1]]
                shapley[part, f] += len(gone)
                out.append((part, "".join(order), step, len(alive), len(gone), len(mine) - len(gone),
                            sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f))
    return sorted((*r[:-1], shapley[r[0], r[-1]]) for r in out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def rows(found):
    return sorted(map(tuple, found.select(*COLUMNS).collect()))


def drawn(seed, n):
    draw = random.Random(seed)
    docs = []
    for i in range(n):
        text = prose(draw.randint(0, n // 2), draw.choice([20, 199, 200, 260]))
        if draw.random() < 0.3:
            text = " ".join(text.split()[:9] * 40)
        if draw.random() < 0.3:
            text = text.upper()
        if draw.random() < 0.3:
            text += " #"
        docs.append((i, draw.choice([text, text, None, ""]), draw.choice(["en", "de", None, ""])))
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, n, 2)]
    return docs, labels


def test_against_brute_force(spark, join_way):
    docs, labels = drawn(1, 120)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    known = spark.createDataFrame([*labels, *labels[:9], (None, 1, 1)], LABELS)
    assert rows(audit_documents(frame, known)) == brute(docs, labels)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    labels = [(1, 1, 0), (3, 0, 1), (None, 1, 1), (4, None, 1)]
    known = spark.createDataFrame(labels, LABELS)
    found = rows(audit_documents(clashing(docs).withColumn("part", docs.text), clashing(known)))
    assert found == brute([(r.doc_id, r.text, r.lang) for r in docs.collect()], labels)
    assert audit_documents(docs.limit(0), known).count() == 0
    none = rows(audit_documents(docs.limit(1), known.limit(0)))
    assert len(none) == 600 and all(r[7] == r[8] == 0 for r in none)


def test_each_set_of_earlier_filters_once(spark):
    failing = {n: spark.createDataFrame([(i,) for i in ids], "_row long") for n, ids in {"A": [1, 2], "B": [2, 3], "C": [2]}.items()}
    found = {(r._row, r.filter, r.ahead): r.redundant for r in prefixes(failing).collect()}
    assert len(found) == 5 * 4
    assert found[2, "A", ""] is False and found[2, "A", "BC"] is True and found[1, "A", "BC"] is False and found[3, "B", "AC"] is False


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    base = duckdb.connect()
    for name in ("documents", "labels"):
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = base.execute(INTERACTION).fetchall()
    assert rows(op11_interaction(spark, folder)) == sorted(want)
    assert any(r[5] for r in want) and any(r[7] for r in want)
