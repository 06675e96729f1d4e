"""A search index over the text columns of a corpus, as a set of Parquet tables."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import query_tokens, tokens
from ..operators import build, search
from ..operators.build import BROADCAST_ROWS, IndexConfig
from ..sources import from_documents, read_corpus
from ..storage import shared_path, stored

TABLES = ("corpus", "postings", "doc_stats", "tf_counts", "term_stats", "shard_stats", "champions")
RECORD_KEYS = 1000
#: A file of postings is of about so many tokens, and of so many bits of the doc_ids of one list.
PART_TOKENS, LIST_BITS = 1 << 21, 18
#: A task of a batch of queries sums about so many contributions.
PART_PARTS = 1 << 21


class SearchIndex:
    """Ranked keyword search.

    >>> index = SearchIndex.index_file(spark, "songs.csv", ["title", "artist"])
    >>> index.search("red moon", k=10)                 # doc_id, score
    >>> index.search({"title": "moon"}, boosts={"title": 2})
    >>> index.search_records("red moon")               # the records, with their scores
    >>> index.save("/shared/songs"); SearchIndex.load(spark, "/shared/songs")
    """

    def __init__(self, spark: SparkSession, path: str, fields: Sequence[str], config: IndexConfig):
        self.spark, self.path, self.fields, self.config = spark, path, list(fields), config
        for name in TABLES:
            try:
                table = spark.read.parquet(f"{path}/{name}")
            except AnalysisException as error:
                if name != "tf_counts" or error.getCondition() != "PATH_NOT_FOUND":
                    raise
                table = build.tf_counts(self.postings)  # saved before the index kept this table
            setattr(self, name, table)

    # -- building -----------------------------------------------------------------------------

    @classmethod
    def build(cls, corpus: DataFrame, fields: Sequence[str], config: IndexConfig = IndexConfig(), path: str | None = None) -> SearchIndex:
        """Index the fields of a corpus that has a unique doc_id; tables go to path or the shared folder.

        Null texts count as empty.  Postings are dealt out by list and range of doc_id, so a very
        frequent term is spread over many files, and sorted by term in each file, so a query reads few pages of it.
        """
        have = {c.lower() for c in corpus.columns}
        if missing := [c for c in ("doc_id", *fields) if c.lower() not in have]:
            raise ValueError(f"no such columns: {', '.join(missing)}")
        if not fields:
            raise ValueError("name at least one field to index")
        spark = corpus.sparkSession
        path = path or shared_path(spark)

        def put(name: str, df: DataFrame) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
            return spark.read.parquet(f"{path}/{name}")

        kept = put("corpus", build.with_shards(corpus.drop("shard"), config).sortWithinPartitions("doc_id"))
        lengths = put("doc_stats", build.document_lengths(kept, fields, config))
        shards = put("shard_stats", build.shard_statistics(lengths, config))
        # a list lies in as many files as it has ranges of doc_id; no pass over the texts is needed to find bounds
        tokens_in_all = lengths.agg(F.sum("doc_len")).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens_in_all // PART_TOKENS + 1)
        dealt = build.postings(kept, fields, config).repartition(parts, *build.LIST, F.shiftright("doc_id", LIST_BITS))
        # term first: it tells rows apart in the first bytes that a sort compares
        posts = put("postings", dealt.sortWithinPartitions("term", "field", "shard", "doc_id"))
        counts = put("tf_counts", build.tf_counts(posts))
        by_term = lambda df, *more: df.repartitionByRange("term", "field", "shard").sortWithinPartitions("term", "field", "shard", *more)
        terms = put("term_stats", by_term(build.term_statistics(counts, shards)))
        put("champions", by_term(build.champion_lists(posts, terms, config.champion_size, counts), "rank"))
        about = {"fields": list(fields), "config": {f.name: getattr(config, f.name) for f in dataclasses.fields(config) if f.init}}
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")
        return cls(spark, path, fields, config)

    @classmethod
    def index_file(cls, spark: SparkSession, path: str, fields: Sequence[str], config: IndexConfig = IndexConfig(), key: str | None = None, multiline: bool = True, **where: Any) -> SearchIndex:
        """Index a .csv, .json / .jsonl or .parquet path; a CSV file without line breaks in its cells can be split with multiline=False."""
        return cls.build(read_corpus(spark, path, fields, key, multiline=multiline), fields, config, **where)

    @classmethod
    def index_documents(cls, spark: SparkSession, documents: Any, config: IndexConfig = IndexConfig(), **where: Any) -> SearchIndex:
        """Index strings, rows, dicts, a pandas frame or series, or a DataFrame: all of its columns."""
        corpus = from_documents(spark, documents)
        return cls.build(corpus, [c for c in corpus.columns if c != "doc_id"], config, **where)

    # -- persistence --------------------------------------------------------------------------

    def save(self, path: str) -> None:
        """Write all tables and the configuration below path, replacing what is there."""
        if path.rstrip("/") == self.path.rstrip("/"):
            return
        for name in (*TABLES, "metadata"):
            (getattr(self, name) if name in TABLES else self.spark.read.parquet(f"{self.path}/{name}")).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SearchIndex:
        try:
            row = spark.read.parquet(f"{path}/metadata").first()
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            raise RuntimeError(f"no index at {path}") from error
        about = json.loads(row["about"])
        stop = about["config"]["stopwords"]
        config = IndexConfig(**about["config"] | {"stopwords": stop if isinstance(stop, str) else tuple(stop)})
        return cls(spark, path, about["fields"], config)

    # -- queries ------------------------------------------------------------------------------

    def _by_field(self, given: Mapping[str, float] | Sequence[float] | None) -> list[float] | None:
        if given is None or len(given) == 0:
            return None
        if isinstance(given, Mapping):
            if unknown := set(given) - set(self.fields):
                raise ValueError(f"no such fields: {', '.join(sorted(unknown))}")
            return [float(given.get(f, 1.0)) for f in self.fields]
        if len(given) != len(self.fields):
            raise ValueError(f"{len(self.fields)} boosts are needed, not {len(given)}")
        return [float(x) for x in given]

    def _terms(self, query: str | Sequence[str] | Mapping[str, str]) -> dict[tuple[int | None, str], list[int]]:
        """The positions of each (field, term); text searches all fields, a list or mapping its own field each."""
        if isinstance(query, str):
            parts = [(None, query)]
        elif isinstance(query, Mapping):
            self._by_field({f: 1.0 for f in query})
            parts = [(self.fields.index(f), t or "") for f, t in query.items()]
        elif isinstance(query, (list, tuple)):
            if len(query) > len(self.fields):
                raise ValueError(f"there are {len(self.fields)} fields, not {len(query)}")
            parts = [(k, t or "") for k, t in enumerate(query)]
        else:
            raise ValueError(f"a query is text, a list or a mapping, not {type(query).__name__}")
        words = [(f, t) for f, text in parts for t in query_tokens(text, self.config.fold, self.config.banned)]
        found: dict[tuple[int | None, str], list[int]] = {}
        for position, word in enumerate(words):
            found.setdefault(word, []).append(position)
        return found

    def _literal(self, terms: dict[tuple[int | None, str], list[int]]) -> DataFrame:
        """The counted terms of one query as an inline table, whose size the planner knows."""
        rows = (F.struct(F.lit(0).cast("long").alias("query_id"), F.lit(f).cast("int").alias("qfield"), F.lit(t).alias("term"), F.lit(len(at)).cast("long").alias("qtf"), F.lit(at[0]).alias("position")) for (f, t), at in terms.items())
        return self.spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))

    def _scores(self, wanted: DataFrame, literal: list[str] | None, mode: str, max_df: int | None, boosts: Sequence[float] | None) -> DataFrame:
        if mode not in ("exact", "hybrid"):
            raise ValueError(f"mode is 'exact' or 'hybrid', not {mode!r}")
        posts, terms = self.postings, self.term_stats
        if literal is not None:  # the terms reach the Parquet scans as a filter
            terms = terms.where(F.col("term").isin(literal))
            if mode == "exact" and max_df is not None:  # those that are too frequent are never read
                terms = terms.where(F.col("df") <= max_df)
                literal = [r[0] for r in terms.select("term").distinct().collect()]
            posts = posts.where(F.col("term").isin(literal))
        matched = search.match_terms(wanted, terms)
        if literal is not None and mode == "exact":
            # a row for each term, field and shard at most; the postings of a frequent term stay where they are
            few_terms = len(literal) * len(self.fields) * self.config.num_shards <= BROADCAST_ROWS
            return search.exact_scores(F.broadcast(matched) if few_terms else matched, posts, self.shard_stats, self.config, max_df, boosts)
        if literal is None:
            matched = stored(matched)
        is_low = ~F.col("is_high_df") if max_df is None else ~F.col("is_high_df") & (F.col("df") <= max_df)
        used = F.lit(True) if max_df is None else (F.col("df") <= max_df if mode == "exact" else F.col("is_high_df") | (F.col("df") <= max_df))
        total = lambda c: F.coalesce(F.sum(F.when(c, F.col("df"))), F.lit(0))
        n_terms, n_low, n_used, n_lists = matched.agg(F.count("*"), total(is_low), total(used), F.count_distinct("query_id", "shard")).first()
        few = n_low + self.config.champion_size * n_lists <= BROADCAST_ROWS
        if n_terms <= BROADCAST_ROWS:  # the postings of a frequent term stay where they are
            if literal is None and (mode == "exact" or not few):  # many queries ask for the same postings: they meet by document
                posts = search.by_document(posts, matched, n_used // PART_PARTS + 1)
            matched = F.broadcast(matched)
        if mode == "exact":
            return search.exact_scores(matched, posts, self.shard_stats, self.config, max_df, boosts)
        return search.hybrid_scores(matched, posts, self.shard_stats, self.champions, self.config, max_df, boosts, few)

    def search(
        self,
        query: str | Sequence[str] | Mapping[str, str] | None,
        k: int = 10,
        max_df: int | None = None,
        boosts: Mapping[str, float] | Sequence[float] | None = None,
        mode: str = "hybrid",
        auto_widen: bool = False,
    ) -> DataFrame:
        """(doc_id, score) of the k best documents, by score to 6 decimals, then doc_id.

        auto_widen doubles max_df until something is found or every term is within it.
        """
        terms = self._terms(query) if query is not None else {}
        by_field = self._by_field(boosts)
        if not terms or k <= 0:
            return self.spark.createDataFrame([], "doc_id long, score double")
        given = self._literal(terms)
        words = sorted({t for _, t in terms})
        if auto_widen and max_df is not None:  # every matched term has postings, so the least df tells what finds something
            df = F.when(F.col("is_high_df"), F.lit(0)).otherwise(F.col("df")) if mode == "hybrid" else F.col("df")
            least = search.match_terms(given, self.term_stats.where(F.col("term").isin(words))).agg(F.min(df)).first()[0] or 0
            while max_df < least:
                max_df = max(1, max_df * 2)
        found = search.top_k_single(self._scores(given, words, mode, max_df, by_field), k)
        return found

    def search_records(self, query: str | Sequence[str] | Mapping[str, str] | None, **options: Any) -> DataFrame:
        """The columns of the source of the k best documents, with score, best first.

        Up to RECORD_KEYS results are looked up by a filter on doc_id, which the scan of the corpus
        prunes by; more are joined.
        """
        found = self.search(query, **options)
        corpus = self.corpus.drop("shard", "score")
        if options.get("k", 10) <= RECORD_KEYS:
            rows = [tuple(r) for r in found.collect()]
            found = self.spark.createDataFrame(rows, "doc_id long, score double")
            corpus = corpus.where(F.col("doc_id").isin([r[0] for r in rows]))
        if options.get("k", 10) <= BROADCAST_ROWS:  # at most k rows
            found = F.broadcast(found)
        joined = corpus.join(found, "doc_id")
        return joined.orderBy(F.desc("score"), "doc_id")

    def query_terms(self, queries: DataFrame) -> DataFrame:
        """Term rows of a table with query_id and text, or with query_id and columns named like fields."""
        if "text" in queries.columns and "text" not in self.fields or self.fields == ["text"]:
            parts = [(None, "text")]
        else:
            parts = [(self.fields.index(f), f) for f in self.fields if f in queries.columns]
        out = None
        for field, name in parts:
            rows = queries.select(F.col("query_id").cast("long").alias("query_id"), F.posexplode(tokens(F.col(name), self.config.fold)).alias("position", "term"))
            rows = rows.withColumn("field", F.lit(field).cast("int"))
            out = rows if out is None else out.unionByName(rows)
        return build.indexed_terms(out, self.config)

    def search_batch(self, queries: DataFrame, k: int = 10, max_df: int | None = None, boosts: Mapping[str, float] | Sequence[float] | None = None, mode: str = "hybrid") -> DataFrame:
        """(query_id, doc_id, score): the k best documents of every query of a table, in one job."""
        scores = self._scores(search.count_terms(self.query_terms(queries)), None, mode, max_df, self._by_field(boosts))
        return search.top_k(scores, k)

    # -- reports ------------------------------------------------------------------------------

    def report(self) -> DataFrame:
        return build.index_report(self.postings, self.doc_stats, self.term_stats)

    def columns(self) -> list[str]:
        """The columns of a record: indexed ones first, then the others, then score."""
        return [*self.fields, *(c for c in self.corpus.columns if c not in (*self.fields, "doc_id", "shard")), "score"]
