import pytest
from pyspark.sql import functions as F

from salescast.operators.encode import (
    likelihood_apply,
    likelihood_fit,
    likelihood_oof,
)

GOLDEN = [("a", 1), ("a", 0), ("a", 1), ("b", 0), ("c", None), ("c", 1), (None, 0)]


@pytest.fixture
def labelled(spark):
    return spark.createDataFrame(GOLDEN, "cat string, y int")


def test_golden_stats(labelled):
    rows = {r.cat: r for r in likelihood_fit(labelled, ["cat"], "y", m=2).collect()}
    assert {c: (r.n, r.s) for c, r in rows.items()} == {
        "a": (3, 2.0), "b": (1, 0.0), "c": (1, 1.0), None: (1, 0.0)
    }
    want = {"a": 0.6, "b": 1 / 3, "c": 2 / 3, None: 1 / 3}
    for cat, value in want.items():
        assert rows[cat].likelihood == pytest.approx(value)


def test_apply_keeps_null_and_gives_unseen_the_prior(spark, labelled, join_way):
    stats = likelihood_fit(labelled, ["cat"], "y", m=2)
    new = spark.createDataFrame(
        [(1, "a"), (2, "zzz"), (3, None), (4, "c")], "id int, cat string"
    )
    got = {r.id: r.likelihood for r in likelihood_apply(new, stats, ["cat"]).collect()}
    assert got == pytest.approx({1: 0.6, 2: 0.5, 3: 1 / 3, 4: 2 / 3})
    fixed = likelihood_apply(new, stats, ["cat"], prior=0.25)
    assert {r.id: r.likelihood for r in fixed.collect()}[2] == 0.25


def test_no_smoothing_and_no_label(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("a", 0)], "cat string, y int")
    got = {r.cat: r.likelihood for r in likelihood_fit(df, ["cat"], "y", m=0).collect()}
    assert got == {"a": 0.5, "b": 0.5}
    none = spark.createDataFrame([("a", None)], "cat string, y int")
    assert likelihood_fit(none, ["cat"], "y", m=2).first().likelihood is None
    with pytest.raises(ValueError):
        likelihood_fit(df, ["cat"], "y", m=-1)


def test_golden_out_of_fold(spark, join_way):
    rows = [("a", 1, 0), ("a", 0, 1), ("b", 1, 0), ("b", 1, 1)]
    df = spark.createDataFrame(rows, "cat string, y int, fold int")
    got = {
        (r.cat, r.fold): r.likelihood
        for r in likelihood_oof(df, ["cat"], "y", "fold", m=2, n_folds=2).collect()
    }
    assert got == pytest.approx(
        {("a", 0): 1 / 3, ("a", 1): 1.0, ("b", 0): 2 / 3, ("b", 1): 1.0}
    )


def test_own_label_has_no_part(spark):
    rows = [(i, f"c{i % 7}", i % 3 * 0.37) for i in range(200)]
    changed = [(i, c, 99.9 if i == 17 else y) for i, c, y in rows]
    values = []
    for data in (rows, changed):
        df = spark.createDataFrame(data, "id int, cat string, y double")
        out = likelihood_oof(df, ["cat"], "y", "id", m=3)
        values.append({r.id: r.likelihood for r in out.collect()})
    assert values[0][17] == values[1][17]
    other = 24  # same category, another fold
    assert values[0][other] != values[1][other]


def test_hot_key_gives_whole_results(spark, join_way):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i}", i % 2) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, cat string, y int")
    out = likelihood_oof(df, ["cat"], "y", "id", m=2).collect()
    assert sorted(r.id for r in out) == list(range(900))
    for r in out[:50] + out[-50:]:
        rest = [y for i, c, y in rows if i % 5 != r.id % 5]
        same = [y for i, c, y in rows if i % 5 != r.id % 5 and c == r.cat]
        prior = sum(rest) / len(rest)
        assert r.likelihood == pytest.approx((sum(same) + 2 * prior) / (len(same) + 2))


def test_agrees_with_spark_target_encoder(spark):
    from pyspark.ml.feature import TargetEncoder

    rows = [(float(i % 6), float(i % 4 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "cat double, y double")
    encoder = TargetEncoder(
        inputCols=["cat"],
        outputCols=["theirs"],
        labelCol="y",
        targetType="binary",
        smoothing=20.0,
        handleInvalid="keep",
    )
    new = spark.createDataFrame([(float(c),) for c in range(8)], "cat double")
    both = likelihood_apply(
        encoder.fit(df).transform(new), likelihood_fit(df, ["cat"], "y"), ["cat"]
    )
    assert both.count() == 8
    assert both.filter(F.abs(F.col("theirs") - F.col("likelihood")) > 1e-12).count() == 0
