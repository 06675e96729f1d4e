"""Small fixtures that every operator's tests share."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=False):
    """documents from (doc_id, text[, lang[, source]]) rows; extra adds columns with names that operators use."""
    full = [(*r, *[None] * (4 - len(r)), len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        for name in ("size", "score", "kept", "shard_id", "digest", "bands", "mark", "h", "copies", "source_size", "target", "held_out", "n_words", "item_id", "slot", "below", "homes", "bits", "s", "b", "part", "component_id", "node", "rep", "spot", "words", "codes"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def odd_rows():
    """Null, empty, wordless, long and repeated texts, null ids and sources."""
    return [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", None), (4, "word", None, "a"),
        (5, "long " * 60_000, "en", "b"), (6, "same text here", "en", "a"), (6, "same text here", "en", "a"),
        (None, "a row without an id", "en", "a"), (7, "x" * 100_000, "de", "b"), (8, "é ü ß 日本   😀", "de", "c"), (9, "!!! ### ???", "en", "c"),
    ]


def sentence(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def vocabulary(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(n)]
