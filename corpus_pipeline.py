"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before it kept. All but the last return the columns of
documents; a column that is missing there is not needed, and others are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescast.llm.batches import bound_batches
from salescast.llm.jaccard import jaccard_components
from salescast.llm.mixing import mix, word_count
from salescast.llm.packing import pack
from salescast.llm.queries import tokenizer_file
from salescast.llm.secrets import masked
from salescast.llm.toxicity import score_toxicity
from salescast.operators.joins import fits_broadcast
from salescast.sources.staging import stage

WORDS, PERCENT = 5, 80
TOXIC = 0.5


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below ``TOXIC``; NULL and empty texts stay."""
    bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(docs, labels, [F.struct("*").alias("_doc")])
    return scored.filter(F.col("score") < TOXIC).select("_doc.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near copies.

    Near copies share 80 % of their five-word shingles or more. Texts without words stay.
    Where ids are NULL or repeated, rows are numbered and the first row of a group stays.
    """
    key, rows = "doc_id", docs
    if docs.groupBy(key).count().filter("count > 1 or doc_id is null").limit(1).count():
        key, rows = "_row", stage(docs.withColumn("_row", F.monotonically_increasing_id()))
    groups = stage(jaccard_components(rows, key, "text", WORDS, PERCENT))
    kept = groups.filter(F.col(key) == F.col("component_id")).select(key)
    kept = F.broadcast(kept) if fits_broadcast(kept) else kept
    return rows.join(kept, key, "left_semi").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, each secret replaced by its kind in brackets; ``n_chars`` follows."""
    bound_batches(spark)
    return masked(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share asks for, or not at all."""
    taken = mix(docs.select(F.struct("*").alias("_doc"), "source", "doc_id", word_count("text").alias("_words")), F.col("_words"))
    copies = taken.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return copies.select("_doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 4,096 tokens."""
    bound_batches(spark)
    return pack(docs, tokenizer_file())


STAGES = [
    ("toxicity", without_toxic),
    ("near_copies", without_near_copies),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]

#: a learned classifier and a tokenizer cannot be written in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what each keeps is written once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
