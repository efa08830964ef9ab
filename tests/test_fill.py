import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from salescast.functions import bucket
from salescast.operators.fill import nb_apply, nb_candidates, nb_classes, nb_fill, nb_fit, null_profile
from salescast.sources.staging import stage


def brute_force(known, rows, alpha=1.0):
    """Score every class for every row. ``known``: (class, attrs); ``rows``: attrs."""
    classes = sorted({c for c, _ in known})
    answers = []
    for attrs in rows:
        scores = {}
        for c in classes:
            mine = [a for k, a in known if k == c]
            score = math.log(len(mine) / len(known))
            for i, value in enumerate(attrs):
                if value is None:
                    continue
                values = {a[i] for _, a in known if a[i] is not None}
                labelled = [a[i] for a in mine if a[i] is not None]
                hits = sum(v == value for v in labelled)
                score += math.log((hits + alpha) / (len(labelled) + alpha * len(values)))
            scores[c] = round(score, 9)
        top = max(scores.values())
        answers.append(min(c for c in classes if scores[c] == top))
    return answers


def test_golden(spark, join_way):
    rows = [
        (1, "x", "p"), (2, "x", "p"), (3, "x", "q"), (4, "y", "q"), (5, "y", "q"),
        (6, None, "p"), (7, None, "q"), (8, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, g string, a string")
    counts = nb_fit(df, "g", ["a"])
    out = {r.id: r for r in nb_apply(df, counts, "g", ["a"]).collect()}
    assert {i: r.g for i, r in out.items()} == {
        1: "x", 2: "x", 3: "x", 4: "y", 5: "y", 6: "x", 7: "y", 8: "x"
    }
    assert {i for i, r in out.items() if r.g_was_null} == {6, 7, 8}


@pytest.mark.parametrize("alpha", [1.0, 0.3])
def test_equals_scoring_every_class(spark, join_way, alpha):
    def attr(i, step, n):
        return None if i % 11 == step else f"v{(i * i + step * i) % n}"

    rows = [
        (
            i,
            None if i % 6 == 0 else f"class{(i * 7 + i // 5) % 23:02d}",
            "common" if i % 3 == 0 else attr(i, 2, 9),
            attr(i, 5, 14),
            "new" if i % 60 == 0 else attr(i, 7, 4),
        )
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "id int, g string, a string, b string, c string")
    attrs = ["a", "b", "c"]
    counts = nb_fit(df, "g", attrs)
    got = {r.id: r.g for r in nb_apply(df, counts, "g", attrs, alpha).collect()}
    known = [(r[1], r[2:]) for r in rows if r[1] is not None]
    gaps = [r for r in rows if r[1] is None]
    want = dict(zip((r[0] for r in gaps), brute_force(known, [r[2:] for r in gaps], alpha)))
    assert len(got) == 400
    assert {i: got[i] for i in want} == want


CLASSES = 10_000


@pytest.fixture(scope="module")
def many_classes(spark):
    """60,000 rows of 10,000 classes: an attribute that tells classes apart, and two that hardly do."""
    i = F.col("id")

    def noise(seed, n):
        return F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(n))

    cls = F.when(noise(9, 8) == 0, noise(1, 40)).otherwise(i % CLASSES)
    rows = spark.range(60_000).select(
        "id",
        cls.cast("int").alias("g"),
        F.when(noise(2, 5) > 0, cls * 7 % 500).otherwise(noise(3, 500)).cast("int").alias("a"),
        F.when(noise(4, 3) > 0, cls % 6).otherwise(noise(5, 6)).cast("int").alias("b"),
        noise(6, 4).cast("int").alias("c"),
    )
    gaps = spark.range(400).select(
        "id",
        F.lit(None).cast("int").alias("g"),
        F.when(noise(7, 9) > 0, noise(11, 520)).cast("int").alias("a"),
        F.when(noise(8, 5) > 0, noise(12, 6)).cast("int").alias("b"),
        F.when(noise(10, 4) > 0, noise(13, 4)).cast("int").alias("c"),
    )
    folder = stage(rows.unionByName(gaps))
    return folder, nb_fit(folder, "g", ["a", "b", "c"])


def test_few_pairs_of_many_classes(spark, many_classes):
    df, counts = many_classes
    attrs = ["a", "b", "c"]
    known = df.filter("g is not null").toPandas()
    tables = []
    for a in attrs:
        table = np.zeros((CLASSES, int(known[a].max()) + 1))
        np.add.at(table, (known["g"], known[a]), 1)
        tables.append(table)
    sizes = np.bincount(known["g"], minlength=CLASSES)
    classes = np.flatnonzero(sizes)
    want, seen = {}, 0
    gaps = df.filter("g is null").select(attrs).distinct().collect()
    for row in gaps:
        score = np.log(sizes[classes] / len(known))
        has = np.zeros(len(classes), bool)
        for value, table in zip(row, tables):
            if value is not None:
                hits = table[classes, value] if value < table.shape[1] else 0
                score = score + np.log((hits + 1) / (sizes[classes] + (table.sum(0) > 0).sum()))
                has |= hits > 0
        seen += has.sum()
        want[tuple(row)] = classes[np.argmax(np.round(score, 9))]
    got = {(r.a, r.b, r.c): r.cls for r in nb_classes(df, counts, "g", attrs).collect()}
    assert got == want
    pairs = nb_candidates(df, counts, "g", attrs).count()
    assert pairs < seen / 10, (pairs, seen)


def test_numeric_target_gets_the_mean_of_its_bucket(spark, join_way):
    rows = [(1, 10, "p"), (2, 14, "p"), (3, 11, "p"), (4, 31, "q"), (5, 35, "q"),
            (6, None, "p"), (7, None, "q")]
    df = spark.createDataFrame(rows, "id int, size int, a string")
    counts = nb_fit(df, "size", ["a"], width=10)
    out = {r.id: r.size for r in nb_apply(df, counts, "size", ["a"], width=10).collect()}
    assert out == {1: 10.0, 2: 14.0, 3: 11.0, 4: 31.0, 5: 35.0, 6: 35 / 3, 7: 33.0}


def test_targets_are_filled_from_original_values(spark, join_way):
    rows = [("x", "p"), ("x", "p"), ("y", "q"), ("y", "q"), ("y", "q"), ("x", None),
            (None, "p"), (None, None)]
    df = spark.createDataFrame(rows, "g string, a string")
    one = nb_fill(df, {"g": ["a"], "a": ["g"]})
    two = nb_fill(df, {"a": ["g"], "g": ["a"]})
    cols = ["g", "a", "g_was_null", "a_was_null"]
    assert sorted(one.select(cols).collect()) == sorted(two.select(cols).collect())
    assert one.filter(F.col("g").isNull() | F.col("a").isNull()).count() == 0
    # the last row knows nothing: each gap gets the commoner class
    both = one.filter("g_was_null and a_was_null").first()
    assert (both.g, both.a) == ("x", "p")  # three of each class of g; ties go to the smaller


def test_nothing_missing_and_nothing_known(spark):
    full = spark.createDataFrame([("x", "p"), ("y", "q")], "g string, a string")
    assert sorted(r.g for r in nb_fill(full, {"g": ["a"]}).collect()) == ["x", "y"]
    empty = spark.createDataFrame([(None, "p")], "g string, a string")
    row = nb_fill(empty, {"g": ["a"]}).first()
    assert row.g is None and row.g_was_null
    with pytest.raises(ValueError):
        nb_apply(full, nb_fit(full, "g", ["a"]), "g", ["a"], alpha=0)


def test_agrees_with_spark_naive_bayes(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    rows = [(i, f"g{(i * 5) % 3}", f"a{i % 4}", f"b{i % 3}") for i in range(240)]
    gaps = [(1000 + i, None, f"a{i % 4}", f"b{i % 3}") for i in range(12)]
    df = spark.createDataFrame(rows + gaps, "id int, g string, a string, b string")
    known = df.filter("g is not null")
    stages = [
        StringIndexer(inputCol="g", outputCol="label", stringOrderType="alphabetAsc"),
        StringIndexer(inputCols=["a", "b"], outputCols=["ai", "bi"]),
        OneHotEncoder(inputCols=["ai", "bi"], outputCols=["av", "bv"], dropLast=False),
        VectorAssembler(inputCols=["av", "bv"], outputCol="features"),
        NaiveBayes(modelType="multinomial", smoothing=1.0),
    ]
    stages[0].setHandleInvalid("keep")
    model = Pipeline(stages=stages).fit(known)
    theirs = {
        r.id: f"g{int(r.prediction)}" for r in model.transform(df.filter("g is null")).collect()
    }
    ours = {r.id: r.g for r in nb_fill(df, {"g": ["a", "b"]}).filter("g_was_null").collect()}
    assert ours == theirs


def test_null_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (None, None), (4, "b")], "n int, t string")
    got = {r["column"]: (r.n_rows, r.n_null, r.null_share) for r in null_profile(df).collect()}
    assert got == {"n": (4, 1, 0.25), "t": (4, 2, 0.5)}


def test_bucket_floors(spark):
    df = spark.createDataFrame([(9.99,), (10.0,), (-0.5,)], "v double")
    got = [r[0] for r in df.select(bucket(F.col("v"), 10)).collect()]
    assert got == [0, 1, -1]


HELPERS = ["value", "mask", "n_rows", "cls", "score", "gain", "attr", "win", "mean", "n", "total", "cell", "unseen_0", "log_prior", "neg"]


@pytest.mark.parametrize("at", range(0, len(HELPERS), 5))
def test_attributes_of_any_name(spark, join_way, at):
    """Columns named as those made on the way, as attributes and beside them."""
    plain = spark.range(60).select(
        "id", F.when(F.col("id") % 4 != 0, F.concat(F.lit("m"), (F.col("id") % 3).cast("string"))).alias("maker"),
        *[(F.col("id") % (i + 2)).alias(f"a{i}") for i in range(5)],
    )
    names = HELPERS[at : at + 5]
    own = plain.withColumnsRenamed({f"a{i}": n for i, n in enumerate(names)})
    want = nb_fill(plain, {"maker": [f"a{i}" for i in range(5)]})
    got = nb_fill(own, {"maker": names})
    assert got.columns == [*own.columns, "maker_was_null"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
