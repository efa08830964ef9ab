from pyspark.sql import functions as F

from salescast.plans.run import run


def test_three_files_in_and_results_out(spark, tmp_path):
    ts = F.concat(F.lit("2024-01-"), F.lpad((F.col("id") % 20 + 1).cast("string"), 2, "0"))
    rows = spark.range(800).select(
        "id",
        (F.col("id") % 17).alias("user"),
        (F.col("id") * 5 % 23).alias("item"),
        F.concat(ts, F.lit(" 10:00:00")).alias("ts"),
        (F.col("id") % 6 + 1).alias("offer"),
        (F.col("id") % 6 < 2).cast("int").alias("buy"),
        F.when(F.col("id") % 6 < 2, 3).alias("qty"),
    )
    items = spark.range(23).select(
        F.col("id").alias("item"),
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("m"), F.col("id") % 3)).alias("maker"),
        F.concat(F.lit("k"), F.col("id") % 2).alias("kind"),
        (F.col("id") + 1).alias("price"),
    )
    paths = {n: str(tmp_path / n) for n in ("train", "items", "score", "out")}
    rows.filter("id < 600").write.option("header", True).csv(paths["train"])
    items.write.option("header", True).csv(paths["items"])
    rows.filter("id >= 600").drop("buy", "qty").write.option("header", True).csv(paths["score"])
    with open(paths["train"] + "/part-bad.csv", "w") as file:
        file.write("id,user,item,ts,offer,buy,qty\n1000,not a number,1,2024-01-01 10:00:00,1,0,\n")
    contact = "id long, user long, item long, ts timestamp_ntz, offer double"
    run(
        spark,
        paths
        | {
            "schemas": {
                "train": contact + ", buy int, qty double",
                "items": "item long, maker string, kind string, price double",
                "score": contact,
            },
            "roles": {
                "row_id": "id", "user": "user", "item": "item", "ts": "ts", "buy": "buy",
                "amount": "qty", "price": "price", "origin": "2024-01-01", "peers": "kind",
                "gaps": {"maker": ["kind"]}, "nominal": [["maker"], ["user"]],
                "offer": "offer",
            },
            "trees": {"maxIter": 3, "maxDepth": 3},
            "holdout": "2024-01-16",
        },
    )
    scores = spark.read.parquet(paths["out"] + "/scores")
    assert scores.count() == 200
    wrong = scores.filter(F.col("buy_predicted") != (F.col("id") % 6 < 2).cast("int"))
    assert wrong.count() == 0
    total = spark.read.parquet(paths["out"] + "/forecast")
    assert total.agg(F.sum("n_rows")).first()[0] == 200
    tried = spark.read.parquet(paths["out"] + "/accuracy").first()
    assert (tried.n_rows, tried.accuracy, tried.n_untimed) == (150, 1.0, 0) and tried.majority_share < 0.7
    bad = {r.file: r.n_rejected for r in spark.read.parquet(paths["out"] + "/rejected/counts").collect()}
    assert bad == {"train": 1, "items": 0, "score": 0}
    assert "not a number" in spark.read.parquet(paths["out"] + "/rejected/train").first().line
    layers = spark.read.parquet(paths["out"] + "/importance").groupBy("layer").agg(F.sum("importance"))
    assert {r.layer for r in layers.collect()} == {"buy", "amount"}
