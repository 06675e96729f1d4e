"""Ranked retrieval over index tables, for one query or a table of them.

Query terms are rows (query_id, position, field, term), or counted, (query_id, qfield, term,
qtf, position); a null field means every field.  The exact mode sums the contributions of all terms; the hybrid mode takes candidates from the terms
below the high-df threshold and lets the frequent terms only re-score them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import tf_part
from ..storage import stored
from .build import IndexConfig, few_or_all

KEYS = ["shard", "field", "term"]


def boost_column(boosts: Sequence[float] | None) -> Column:
    return F.lit(1.0) if not boosts else F.element_at(F.array(*(F.lit(float(x)) for x in boosts)), F.col("field") + 1)


def count_terms(query_terms: DataFrame) -> DataFrame:
    """(query_id, qfield, term, qtf, position): repeats of a term are counted, its first position stays."""
    return query_terms.groupBy("query_id", F.col("field").alias("qfield"), "term").agg(F.count("*").alias("qtf"), F.min("position").alias("position"))


def match_terms(wanted: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, shard, field, term, df, idf, is_high_df, qtf, position) of the counted terms that exist.

    The terms of one query all have a null field, or all have one.
    """
    found = wanted.join(terms, "term").where(F.col("qfield").isNull() | (F.col("qfield") == F.col("field")))
    return found.select("query_id", *KEYS, "df", "idf", "is_high_df", "qtf", "position")


def contributions(matched: DataFrame, posts: DataFrame, shards: DataFrame, config: IndexConfig, boosts: Sequence[float] | None = None, *keep: str) -> DataFrame:
    """(query_id, shard, doc_id, part, keep...) for each matched term and document."""
    rows = matched.join(posts, KEYS).join(F.broadcast(shards), "shard")  # a row for each shard
    part = F.col("qtf") * F.col("idf") * boost_column(boosts) * tf_part(F.col("tf"), F.col("doc_len"), F.col("avg_doc_len"), config.k1, config.b)
    return rows.select("query_id", "shard", "doc_id", part.alias("part"), *keep)


def by_document(posts: DataFrame, matched: DataFrame, parts: int) -> DataFrame:
    """The postings of matched terms, each once, dealt out by document.

    The contributions to a query and document are then made in one task, so they are summed
    where they are made: postings are shuffled, not the far more rows of queries and documents.
    """
    return posts.join(F.broadcast(matched.select(*KEYS).distinct()), KEYS, "left_semi").repartition(parts, "shard", "doc_id")


def exact_scores(matched: DataFrame, posts: DataFrame, shards: DataFrame, config: IndexConfig, max_df: int | None = None, boosts: Sequence[float] | None = None) -> DataFrame:
    """(query_id, shard, doc_id, score) of every document with a term of df <= max_df."""
    used = matched if max_df is None else matched.where(F.col("df") <= max_df)
    return contributions(used, posts, shards, config, boosts).groupBy("query_id", "shard", "doc_id").agg(F.sum("part").alias("score"))


def hybrid_scores(matched: DataFrame, posts: DataFrame, shards: DataFrame, champions: DataFrame, config: IndexConfig, max_df: int | None = None, boosts: Sequence[float] | None = None, few: bool = False) -> DataFrame:
    """Scores of candidates only.

    Per query and shard, the documents of low-df terms (of df <= max_df) are the candidates.
    Where there are none, the champions of the high-df term of smallest df are, ties going to
    the first field, then the first position.  High-df terms then add to candidates alone,
    each occurrence once, and max_df does not concern them.

    With few candidates, of a number the caller has checked, they are sent to the postings of
    high-df terms, which are filtered before they are scored.  Without, all parts are summed in
    one pass, and a document counts if one of its parts makes it a candidate.
    """
    low = matched.where("NOT is_high_df")
    if max_df is not None:
        low = low.where(F.col("df") <= max_df)
    high = matched.where("is_high_df")
    # every matched term has a posting, so a low-df term alone tells that there are candidates
    seeded = high.join(low.select("query_id", "shard").distinct(), ["query_id", "shard"], "left_anti")
    order = W.partitionBy("query_id", "shard").orderBy("df", "field", "position")
    seed = seeded.withColumn("r", F.row_number().over(order)).where("r = 1").select("query_id", *KEYS)
    by_seed = seed.join(champions, KEYS).select("query_id", "shard", "doc_id", F.lit(0.0).alias("part"))
    key = ["query_id", "shard", "doc_id"]
    if few:
        candidates = contributions(low, posts, shards, config, boosts).unionByName(by_seed).groupBy(*key).agg(F.sum("part").alias("part"))
        near = F.broadcast(candidates.select("shard", "doc_id").distinct())
        high_parts = contributions(high, posts.join(near, ["shard", "doc_id"], "left_semi"), shards, config, boosts)
        high_parts = high_parts.join(F.broadcast(candidates.select(*key)), key, "left_semi")
        return candidates.unionByName(high_parts).groupBy(*key).agg(F.sum("part").alias("score"))
    used = matched if max_df is None else matched.where(F.col("is_high_df") | (F.col("df") <= max_df))
    parts = contributions(used, posts, shards, config, boosts, "is_high_df")
    sums = parts.groupBy(*key).agg(F.sum("part").alias("score"), F.min("is_high_df").alias("all_high"))
    # a champion has a posting of its seed, so it is among the sums
    seeds = few_or_all(stored(by_seed.select(*key, F.lit(True).alias("is_seeded"))))
    return sums.join(seeds, key, "left").where("NOT all_high OR is_seeded").drop("all_high", "is_seeded")


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score): the k best of each query, by score to 6 decimals, then doc_id."""
    rounded = scores.select("query_id", "doc_id", F.round("score", 6).alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return rounded.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def top_k_single(scores: DataFrame, k: int) -> DataFrame:
    """The same for one query, as an ordered limit."""
    return scores.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)
