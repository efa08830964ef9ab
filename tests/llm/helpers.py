import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def word(draw, n=300):
    return "".join(draw.choice(["ba", "re", "to", "mi", "ku", "sel"]) for _ in range(draw.randint(1, 4))) + str(draw.randint(0, n))


def prose(seed, words):
    draw = random.Random(seed)
    return " ".join(word(draw) for _ in range(words))


def odd_docs(spark):
    """NULLs in every column, empty and long texts, ties, repeated rows."""
    long = prose(1, 30_000)
    rows = [
        (1, prose(2, 60), "en", "a", 10), (1, prose(2, 60), "en", "a", 10), (2, None, "en", "a", None),
        (3, "", None, "b", 0), (None, prose(3, 40), "en", None, 5), (None, None, None, None, None),
        (4, long, "de", "b", len(long)), (5, "  \n\t ", "de", "a", 5), (6, "1 2 3 !!", "en", "a", 8),
        (7, prose(2, 60), "fr", None, 1), (8, "Straße 😀 \u0000 naïve", "fr", "c", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


def clashing(docs):
    """More columns, of names that operators use themselves."""
    from pyspark.sql import functions as F

    names = ["row", "key", "id", "n", "score", "hits", "size", "target", "copies", "term", "version", "start", "length", "_row", "_part", "_term", "host", "rank", "label", "_key", "_doc_key", "other"]
    return docs.withColumns({n: F.lit(f"own {n}") for n in names})


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
