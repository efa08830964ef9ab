import math
import random

import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from salescast.operators.gaussian import distributions, gaussian_classes, gaussian_fill, merged, moments

NUMBERS = ["size", "value"]


def made(spark, n=300, seed=2):
    rng = random.Random(seed)
    centre = {"a": (0, 100), "b": (3, 140), "c": (8, 90)}
    rows = []
    for i in range(n):
        c = rng.choice("abc")
        rows.append((i, c, rng.gauss(centre[c][0], 1.0), rng.gauss(centre[c][1], 15.0)))
    return spark.createDataFrame(rows, "id int, kind string, size double, value double")


def classes(df, table, **options):
    return {r.id: (r.cls, r.score) for r in gaussian_classes(df, table, NUMBERS, "id", **options).collect()}


def test_as_sparks_own(spark):
    df = made(spark)
    vectors = VectorAssembler(inputCols=NUMBERS, outputCol="features").transform(df)
    indexed = StringIndexer(inputCol="kind", outputCol="label", stringOrderType="alphabetAsc").fit(vectors).transform(vectors)
    model = NaiveBayes(modelType="gaussian").fit(indexed)
    known = {r.cls: r for r in distributions(moments(df, "kind", NUMBERS), 2).collect()}
    for i, c in enumerate("abc"):
        assert known[c].log_prior == pytest.approx(model.pi[i], abs=1e-9)
        for j in range(2):
            assert known[c][f"mean_{j}"] == pytest.approx(model.theta.toArray()[i, j], rel=1e-9)
            assert known[c][f"var_{j}"] == pytest.approx(model.sigma.toArray()[i, j], rel=1e-9)
    want = {r.id: "abc"[int(r.prediction)] for r in model.transform(indexed).collect()}
    assert {k: v[0] for k, v in classes(df, moments(df, "kind", NUMBERS)).items()} == want


def test_brute_force_with_gaps_and_blocks(spark):
    df = made(spark).withColumns({
        "size": F.when(F.col("id") % 7 != 0, F.col("size")),
        "value": F.when(F.col("id") % 11 == 0, F.lit(float("nan"))).when(F.col("id") % 5 != 0, F.col("value")),
        "kind": F.when(F.col("id") % 4 != 0, F.col("kind")),
    })
    rows = [[r.id, r.kind, *[None if v is None or math.isnan(v) else v for v in (r.size, r.value)]] for r in df.collect()]
    known = [r for r in rows if r[1]]
    spread = []
    for j in (2, 3):
        xs = [r[j] for r in known if r[j] is not None]
        spread.append(sum(x * x for x in xs) / len(xs) - (sum(xs) / len(xs)) ** 2)
    table, want = moments(df, "kind", NUMBERS), {}
    for r in rows:
        scores = {}
        for c in "abc":
            own = [k for k in known if k[1] == c]
            score = math.log(len(own) / len(known))
            for j in (2, 3):
                if r[j] is None:
                    continue
                xs = [k[j] for k in own if k[j] is not None]
                mean = sum(xs) / len(xs)
                var = sum(x * x for x in xs) / len(xs) - mean**2 + 1e-9 * max(spread)
                score += -0.5 * (math.log(2 * math.pi * var) + (r[j] - mean) ** 2 / var)
            scores[c] = score
        best = max(scores, key=scores.get)
        want[r[0]] = best, pytest.approx(scores[best], abs=1e-7)
    assert classes(df, table) == want
    assert classes(df, table, block=1) == want
    filled = {r.id: (r.kind, r.kind_was_null) for r in gaussian_fill(df, "kind", NUMBERS, "id").collect()}
    assert filled == {r[0]: (r[1] or want[r[0]][0], r[1] is None) for r in rows}


def test_moments_of_parts(spark):
    df = made(spark)
    parts = [moments(df.filter(F.col("id") % 3 == i), "kind", NUMBERS) for i in range(3)]
    got = {r.cls: r for r in merged(*parts).collect()}
    for r in moments(df, "kind", NUMBERS).collect():
        for c in r.asDict():
            assert got[r.cls][c] == (r[c] if c == "cls" else pytest.approx(r[c], rel=1e-9))


def test_alike_values_ties_empty_and_clashing(spark):
    rows = [(1, "b", 1.0, None), (2, "a", 1.0, None), (3, None, 1.0, None), (4, None, None, None)]
    df = spark.createDataFrame(rows, "id int, kind string, size double, value double")
    got = {r.id: r.kind for r in gaussian_fill(df, "kind", NUMBERS, "id").collect()}
    assert got == {1: "b", 2: "a", 3: "a", 4: "a"}
    none = gaussian_fill(df.filter("kind is null"), "kind", NUMBERS, "id").collect()
    assert [(r.kind, r.kind_was_null) for r in none] == [(None, True)] * 2
    assert gaussian_fill(df.limit(0), "kind", NUMBERS, "id").count() == 0
    with pytest.raises(ValueError):
        gaussian_fill(df.withColumn("_fill", F.lit(1)), "kind", NUMBERS, "id")
    names = ["score", "cls", "n", "_block", "_classes"]
    odd = df.select("id", "kind", "size", *[F.lit(1.0).alias(c) for c in names])
    assert gaussian_fill(odd, "kind", [*names, "size"], "id").count() == 4
