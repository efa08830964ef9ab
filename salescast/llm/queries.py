"""The corpus operators as queries over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salescast.llm.alignment import align
from salescast.llm.descent import near_vectors
from salescast.llm.fingerprints import fingerprint, lexicon, likeness, with_next
from salescast.llm.hamming import sign_code, top_k
from salescast.llm.html import extract
from salescast.llm.interaction import audit_documents
from salescast.llm.jaccard import jaccard_components
from salescast.llm.labelled import held_out
from salescast.llm.langid import identify, learn_profiles
from salescast.llm.mixing import mix, word_count
from salescast.llm.packing import pack
from salescast.llm.quality import score_quality
from salescast.llm.secrets import find_secrets
from salescast.llm.sql import INTERACTION, MIX, SEARCH
from salescast.llm.toxicity import score_toxicity
from salescast.sources.staging import stage


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = lexicon(docs)
    paired = with_next(docs, "doc_id", "text")
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("_next", F.lit(1), quarter))
    texts = paired.select("_range", "_place", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    texts = texts.withColumn("edited_sha256", F.sha2("edited", 256))
    key, keep = ["_range", "_place"], ["doc_id", "n_chars", "edited_sha256"]
    prints = stage(fingerprint(texts, known, ["text", "edited"], key, keep))
    # the next document's: within the range, or the first of the next range
    order = Window.partitionBy("_range").orderBy("_place")
    firsts = prints.filter("_place = 1").select("_range", F.col("text").alias("first"))
    ring = Window.orderBy("_range")  # one row per range
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("first").over(ring), F.first("first").over(whole))
    firsts = firsts.select("_range", after.alias("_after"))
    joined = prints.withColumn("_lead", F.lead("text").over(order)).join(firsts, "_range")
    following = F.coalesce("_lead", "_after")
    return joined.select(
        *keep,
        F.col("text").alias("fingerprint"),
        F.col("edited").alias("edited_fingerprint"),
        likeness(F.col("text"), F.col("edited")).alias("near_edited"),
        likeness(F.col("text"), following).alias("near_next"),
    )


def scored(rows: DataFrame, least: float) -> DataFrame:
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = (table(spark, folder, name) for name in ("documents", "labels"))
    return scored(score_toxicity(docs, labels, ["doc_id", held_out().alias("held_out")]), 0.5)


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = (table(spark, folder, name) for name in ("documents", "labels"))
    return scored(score_quality(docs, labels, ["doc_id", held_out().alias("held_out")]), 0.3)


def op4_html(spark: SparkSession, folder: str) -> DataFrame:
    found = extract(table(spark, folder, "pages"), ["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op5_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


def op6_search(spark: SparkSession, folder: str) -> DataFrame:
    codes = table(spark, folder, "embeddings").select("vec_id", sign_code("embedding", 64).alias("code"))
    return top_k(codes, codes.filter("vec_id % 20 = 0"), words=4)


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    kept_back = held_out(parts=4, part=2)
    profiles = learn_profiles(docs.filter(~kept_back))
    return identify(docs, profiles, ["doc_id", kept_back.alias("held_out")])


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = find_secrets(table(spark, folder, "documents"))

    def listed(spans: Column) -> Column:
        shown = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(shown, ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("secrets", lambda s: s["kind"] != "guess")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), tokenizer_file())


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    sized = docs.select("doc_id", "source", word_count("text").alias("words"))
    return mix(sized, sized["words"]).select("doc_id", "size", "source_size", "target", "taken")


def op11_interaction(spark: SparkSession, folder: str) -> DataFrame:
    return audit_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    files = [tokenizer_file(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return align(table(spark, folder, "documents"), *files, digest=True).withColumnRenamed("groups", "groups_sha256")


def op13_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_html": op4_html,
    "op5_jaccard": op5_jaccard,
    "op6_search": op6_search,
    "op7_language": op7_language,
    "op8_secrets": op8_secrets,
    "op9_packing": op9_packing,
    "op10_mixing": op10_mixing,
    "op11_interaction": op11_interaction,
    "op12_alignment": op12_alignment,
    "op13_near_vectors": op13_near_vectors,
}

ORACLE = {"op6_search": SEARCH, "op10_mixing": MIX, "op11_interaction": INTERACTION}
