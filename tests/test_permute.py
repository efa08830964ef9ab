import random

import pytest
from pyspark.sql import functions as F

from salescast.operators.evaluate import rolling_accuracy
from salescast.operators.permute import permutation_importance, shuffled_place


def made(spark, n=400):
    rng = random.Random(8)
    rows = [(f"r{i}", rng.random(), rng.random(), rng.random()) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, strong double, weak double, noise double")
    return df.withColumn("y", 3 * F.col("strong") + 0.5 * F.col("weak"))


def importance(df, **options):
    guess = lambda rows: rows.withColumn("guess", 3 * F.col("strong") + 0.5 * F.col("weak") + 0 * F.col("noise"))
    loss = (F.col("y") - F.col("guess")) ** 2
    return permutation_importance(df, ["noise", "strong", "weak"], guess, loss, "id", **options)


def test_places_are_a_permutation(spark):
    df = made(spark)
    first = {r.id: r.place for r in shuffled_place(df, "id", "s", "place").collect()}
    assert sorted(first.values()) == list(range(1, 401))
    again = {r.id: r.place for r in shuffled_place(df.repartition(7), "id", "s", "place").collect()}
    other = {r.id: r.place for r in shuffled_place(df, "id", "t", "place").collect()}
    assert again == first != other


def test_planted_feature_first_and_noise_nothing(spark, join_way):
    df = made(spark)
    rows = {r.feature: r for r in importance(df).collect()}
    assert [f for f, r in sorted(rows.items(), key=lambda x: x[1]["rank"])] == ["strong", "weak", "noise"]
    assert rows["noise"].importance == rows["noise"].loss == rows["strong"].base_loss == 0.0
    # twice the variance of what the feature adds
    assert rows["strong"].importance == pytest.approx(2 * 9 / 12, rel=0.2)
    assert rows["weak"].importance == pytest.approx(2 * 0.25 / 12, rel=0.2)
    assert {r.n_rows for r in rows.values()} == {400}


def test_rerun_is_equal_whatever_the_partitions(spark):
    df = made(spark)
    want = sorted(map(str, importance(df).collect()))
    assert sorted(map(str, importance(df.repartition(5)).collect())) == want
    assert sorted(map(str, importance(df, seed=1).collect())) != want


def test_empty_unknown_losses_and_clashing(spark):
    df = made(spark, 20)
    assert [(r.n_rows, r.importance) for r in importance(df.limit(0)).collect()] == []
    some = importance(df.withColumn("y", F.when(F.col("id") != "r3", F.col("y")))).collect()
    assert {r.n_rows for r in some} == {19}
    with pytest.raises(ValueError):
        importance(df.withColumn("_place", F.lit(1)))


def contacts(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", "c", None]), rng.randint(1, 28), int(rng.random() < 0.4)) for _ in range(400)]
    rows += [("a", None, 1), ("b", 3, None)]
    df = spark.createDataFrame(rows, "who string, d int, buy int")
    return rows, df.withColumn("ts", F.to_timestamp_ntz(F.concat(F.lit("2024-01-"), F.lpad(F.col("d").cast("string"), 2, "0")), F.lit("yyyy-MM-dd")))


def test_rolling_origins_against_brute_force(spark):
    rows, df = contacts(spark)
    got = {str(r.cutoff): r for r in rolling_accuracy(df, ["who"], "buy", "ts", ["2024-01-01", "2024-01-08", "2024-01-15", "2024-02-20"], 7, 5.0, 0.4).collect()}
    for cutoff, day in (("2024-01-08", 8), ("2024-01-15", 15)):
        known = [r for r in rows if r[1] is not None and r[2] is not None]
        past = [r for r in known if r[1] < day]
        later = [r for r in known if day <= r[1] < day + 7]
        prior = sum(r[2] for r in past) / len(past)
        p = {}
        for who in {r[0] for r in later}:
            own = [r[2] for r in past if r[0] == who]
            p[who] = (sum(own) + 5 * prior) / (len(own) + 5)
        r = got[cutoff]
        assert (r.n_train, r.n_rows) == (len(past), len(later))
        assert r.accuracy == pytest.approx(sum((p[x[0]] >= 0.4) == (x[2] == 1) for x in later) / len(later))
        assert r.brier == pytest.approx(sum((x[2] - p[x[0]]) ** 2 for x in later) / len(later), abs=1e-9)
        alone = rolling_accuracy(df, ["who"], "buy", "ts", [cutoff], 7, 5.0, 0.4).first()
        assert alone == r
    # nothing known before, and nothing after
    assert (got["2024-01-01"].n_train, got["2024-01-01"].accuracy) == (0, None)
    assert (got["2024-02-20"].n_rows, got["2024-02-20"].accuracy) == (0, None)
    assert got["2024-01-01"].n_rows > 0 and got["2024-02-20"].n_train == 400


def test_rolling_refuses_repeated_cutoffs(spark):
    _, df = contacts(spark)
    with pytest.raises(ValueError):
        rolling_accuracy(df, ["who"], "buy", "ts", ["2024-01-08", "2024-01-08"])
