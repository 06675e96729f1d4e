"""Okapi BM25 as column expressions, and the sizing of Bloom filters."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def idf(df: Column, num_docs: Column) -> Column:
    """ln((N - df + 0.5) / (df + 0.5)): negative for terms in over half of the documents."""
    return F.log((num_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def tf_part(tf: Column, doc_len: Column, avg_doc_len: Column, k1: float, b: float) -> Column:
    """tf / (tf + k1 * (1 - b + b * length / average length)), without a k1 + 1 factor."""
    relative = F.when(avg_doc_len > 0, doc_len.cast("double") / avg_doc_len).otherwise(F.lit(0.0))
    return tf.cast("double") / (tf + F.lit(float(k1)) * (F.lit(1.0 - b) + F.lit(float(b)) * relative))


def bloom_hashes(fpr: float) -> int:
    return max(1, round(-math.log2(fpr)))


def bloom_bits(entries: Column, fpr: float) -> Column:
    """ceil(n ln p / ln(1 / 2**ln 2)) bits for n entries."""
    return F.ceil(entries * F.lit(math.log(fpr)) / F.lit(math.log(1 / 2 ** math.log(2)))).cast("long")
