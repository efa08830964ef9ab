import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salescast.operators.fill import nb_fill
from salescast.sources import read_table, shared_folder, sound_rows, stage, write_scores

ITEMS = T.StructType(
    [
        T.StructField("item", T.LongType()),
        T.StructField("maker", T.StringType()),
        T.StructField("size", T.DoubleType()),
        T.StructField("since", T.DateType()),
    ]
)


def write(path, text):
    path.write_text(text)
    return str(path)


def test_empty_fields_become_null(spark, tmp_path):
    path = write(tmp_path / "items.csv", "item,maker,size,since\n1,ab,2.5,2020-01-02\n2,,,\n")
    assert read_table(spark, path, ITEMS).collect() == [
        (1, "ab", 2.5, dt.date(2020, 1, 2)),
        (2, None, None, None),
    ]


def test_bad_input_fails_or_is_kept_apart(spark, tmp_path):
    path = write(tmp_path / "bad.csv", "item,maker,size,since\n1,ab,x,2020-01-02\n2,cd,1,\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_table(spark, path, ITEMS).collect()
    read = read_table(spark, path, ITEMS, corrupt_col="raw")
    assert [r.raw for r in read.collect() if r.raw] == ["1,ab,x,2020-01-02"]
    good = sound_rows(read, "raw")
    assert [r.item for r in good.collect()] == [2]
    assert good.columns == ["item", "maker", "size", "since"]


def test_bad_input_is_not_filled(spark, tmp_path):
    text = "item,maker,size,since\n" + "".join(f"{i},m{i % 2},1,\n" for i in range(8))
    path = write(tmp_path / "gaps.csv", text + "90,,1,\n91,,zzz,\n")
    rows = sound_rows(read_table(spark, path, ITEMS, corrupt_col="raw"), "raw")
    filled = nb_fill(rows, {"maker": ["size"]})
    assert [r.item for r in filled.filter("maker_was_null").collect()] == [90]


def test_other_separator_and_folder_of_files(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    for i in range(3):
        write(folder / f"{i}.csv", f"item|maker|size|since\n{i}|a|1|\n")
    read = read_table(spark, str(folder), ITEMS, sep="|")
    assert sorted(r.item for r in read.collect()) == [0, 1, 2]


def test_scores_are_written_once(spark, tmp_path):
    df = spark.range(10).withColumn("day", F.col("id") % 2)
    path = str(tmp_path / "scores")
    write_scores(df, path, ("day",))
    assert spark.read.parquet(path).count() == 10
    with pytest.raises(PySparkException):
        write_scores(df, path)


def test_stage_reads_back_what_was_written(spark):
    df = spark.range(5).withColumn("t", F.when(F.col("id") > 2, "x"))
    staged = stage(df)
    assert sorted(staged.collect(), key=str) == sorted(df.collect(), key=str)
    assert shared_folder(spark).removeprefix("file:") in staged.inputFiles()[0]


class FakeSession:
    """Only what ``shared_folder`` asks of a session."""

    def __init__(self, master, named):
        self.master, self.folder = master, None
        self.conf, self.sparkContext = {"spark.checkpoint.dir": named} if named else {}, self

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder_is_the_named_one():
    assert shared_folder(FakeSession("yarn", "hdfs:///shared")) == "hdfs:///shared"
    assert "salescast-" in shared_folder(FakeSession("local[2]", None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(FakeSession("spark://host:7077", None))
