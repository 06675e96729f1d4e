"""The registered queries of the search engine, over whole tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import ENGLISH_STOPWORDS, tokens
from .operators import build
from .operators.build import IndexConfig
from .plans import SearchIndex
from .storage import shared_path
from .streaming import stream_search

GLOBAL = IndexConfig()
TEXT = ["text"]
PART = ["p_name", "p_brand", "p_type"]
_ENGLISH = IndexConfig(stopwords="english")
_SHARDED = IndexConfig(num_shards=4)
_UNICODE = IndexConfig(fold="unicode")
_built: dict[tuple, SearchIndex] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _index(spark: SparkSession, sf_dir: str, fields: list[str] = TEXT, config: IndexConfig = GLOBAL) -> SearchIndex:
    """The index of documents or part, built once for a session and directory, as an index is meant to be used."""
    key = (spark.sparkContext.applicationId, sf_dir, tuple(fields), config)
    if key not in _built:
        corpus = _table(spark, sf_dir, "documents") if fields == TEXT else _table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "doc_id")
        _built[key] = SearchIndex.build(corpus, fields, config)
    return _built[key]


# -- SQL pieces ---------------------------------------------------------------------------------

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_VALID = "(length(term) > 1 OR ascii(term) > 127 OR regexp_matches(term, '^[0-9A-Za-z]$'))"


def _base(fields: list[str] = TEXT, stop: str = "", first_line: bool = False, thr: str = "0.01", shards: int = 1) -> str:
    """CTEs corpus, tokens, lengths, posts, shards, dfs, terms for an index."""
    table, key = ("documents", "doc_id") if fields == TEXT else ("part", "p_partkey")
    flat = "split_part(coalesce({f}, ''), chr(10), 1)" if first_line else "replace(coalesce({f}, ''), chr(10), ' ')"
    parts = " UNION ALL ".join(f"SELECT doc_id, shard, {k} AS field, unnest(string_split(translate({flat.format(f=f)}, '{_LOWER}', '{_UPPER}'), ' ')) AS term FROM corpus" for k, f in enumerate(fields))
    shard = "0" if shards == 1 else f"least({key} // ((SELECT count(*) FROM {table}) // {shards}), {shards - 1})::INTEGER"
    return f"""
corpus AS (SELECT {key} AS doc_id, {shard} AS shard, * EXCLUDE ({key}) FROM {table}),
tokens AS (SELECT * FROM ({parts}) WHERE term <> ''),
lengths AS (SELECT c.doc_id, c.shard, count(t.term)::INTEGER AS doc_len FROM corpus c LEFT JOIN tokens t ON c.doc_id = t.doc_id GROUP BY ALL),
posts AS (SELECT t.shard, t.field, t.term, t.doc_id, count(*)::INTEGER AS tf FROM tokens t WHERE {_VALID}{stop} GROUP BY ALL),
shards AS (SELECT shard, count(*) AS num_docs, avg(doc_len)::DOUBLE AS avg_doc_len, floor({thr}::DOUBLE * count(*))::BIGINT AS min_df FROM lengths GROUP BY shard),
dfs AS (SELECT shard, field, term, count(*) AS df FROM posts GROUP BY ALL),
terms AS (SELECT d.*, ln((num_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf, df >= min_df AS is_high_df FROM dfs d JOIN shards USING (shard))"""


def _parts(boost: str = "1.0") -> str:
    return f"""
parts AS (
  SELECT m.query_id, m.shard, p.doc_id, m.is_high_df, m.df,
    qtf * idf * ({boost})::DOUBLE * (tf / (tf + 1.2::DOUBLE * (1 - 0.4::DOUBLE + 0.4::DOUBLE * doc_len / avg_doc_len))) AS part
  FROM matched m JOIN posts p USING (shard, field, term) JOIN lengths l ON l.doc_id = p.doc_id JOIN shards s ON s.shard = m.shard)"""


def _asked(words: list[tuple[int | None, str]]) -> str:
    rows = ", ".join(f"(0, {p}, {'NULL' if f is None else f}::INTEGER, '{t}')" for p, (f, t) in enumerate(words))
    return f"asked(query_id, position, qfield, term) AS (VALUES {rows})"


_MATCHED = """
matched AS (
  SELECT query_id, t.shard, t.field, t.term, t.df, t.idf, t.is_high_df, count(*) AS qtf, min(position) AS position
  FROM asked a JOIN terms t ON a.term = t.term AND (a.qfield IS NULL OR a.qfield = t.field) GROUP BY ALL)"""


def _top(source: str, k: int, batch: bool = False) -> str:
    if batch:
        return f"SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM (SELECT query_id, doc_id, round(sum(part), 6) AS score FROM {source} GROUP BY ALL)) WHERE r <= {k}"
    return f"SELECT doc_id, round(sum(part), 6) AS score FROM {source} GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {k}"


def _exact(words: list[tuple[int | None, str]], k: int, where: str = "true", boost: str = "1.0", **base: object) -> str:
    return f"WITH {_asked(words)}, {_base(**base)}, {_MATCHED}, {_parts(boost)}, used AS (SELECT * FROM parts WHERE {where}) {_top('used', k)}"


def _hybrid(asked: str, k: int, max_df: int = 10**9, boost: str = "1.0", batch: bool = False, **base: object) -> str:
    return f"""WITH {asked}, {_base(**base)}, {_MATCHED}, {_parts(boost)},
low AS (SELECT * FROM parts WHERE NOT is_high_df AND df <= {max_df}),
seeds AS (
  SELECT query_id, shard, field, term FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, shard ORDER BY df, field, position) AS r FROM matched m
    WHERE is_high_df AND NOT EXISTS (SELECT 1 FROM low WHERE low.query_id = m.query_id AND low.shard = m.shard)) WHERE r = 1),
champions AS (
  SELECT query_id, shard, doc_id FROM (
    SELECT query_id, p.shard, p.doc_id, row_number() OVER (PARTITION BY query_id, p.shard ORDER BY tf DESC, p.doc_id DESC) AS r
    FROM seeds JOIN posts p USING (shard, field, term)) WHERE r <= 1000),
candidates AS (SELECT query_id, shard, doc_id FROM low UNION SELECT * FROM champions),
used AS (SELECT * FROM low UNION ALL
  SELECT * FROM parts p WHERE is_high_df AND EXISTS (SELECT 1 FROM candidates c WHERE c.query_id = p.query_id AND c.shard = p.shard AND c.doc_id = p.doc_id))
{_top('used', k, batch)}"""


def _free(text: str) -> list[tuple[int | None, str]]:
    return [(None, t) for t in text.split(" ")]


_STOP = " AND term NOT IN (" + ", ".join(f"'{w}'" for w in ENGLISH_STOPWORDS) + ")"

# -- build-side queries ---------------------------------------------------------------------------


def tokenize(spark, sf_dir):
    rows = build.token_rows(_table(spark, sf_dir, "documents"), TEXT)
    return rows.groupBy("doc_id", "term").agg(F.count("*").alias("n"))


def tokenize_first_line(spark, sf_dir):
    config = IndexConfig(first_line_only=True)
    return build.token_rows(_table(spark, sf_dir, "documents"), TEXT, config).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


def tokenize_pages(spark, sf_dir):
    rows = build.token_rows(_table(spark, sf_dir, "pages"), ["html"], keep=("page_id",))
    return rows.groupBy("page_id").agg(F.count("*").alias("n_tokens"), F.countDistinct("term").alias("n_terms"))


def valid_tokens(spark, sf_dir):
    rows = build.indexed_terms(build.token_rows(_table(spark, sf_dir, "documents"), TEXT))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_valid"))


def stopword_filter(spark, sf_dir):
    rows = build.indexed_terms(build.token_rows(_table(spark, sf_dir, "documents"), TEXT), _ENGLISH)
    return rows.groupBy("term").agg(F.count("*").alias("n"))


def postings_tf(spark, sf_dir):
    return _index(spark, sf_dir).postings.select("shard", "field", "term", "doc_id", "tf")


def doc_length(spark, sf_dir):
    return _index(spark, sf_dir).doc_stats


def doc_freq(spark, sf_dir):
    return build.document_frequencies(_index(spark, sf_dir).postings)


def doc_freq_part(spark, sf_dir):
    return build.document_frequencies(_index(spark, sf_dir, PART).postings)


def shard_stats(spark, sf_dir):
    stats = _index(spark, sf_dir, config=_SHARDED).shard_stats
    return stats.select("shard", "num_docs", F.round("avg_doc_len", 6).alias("avg_doc_len"), "min_df")


def idf_table(spark, sf_dir):
    return _index(spark, sf_dir).term_stats.select("shard", "field", "term", "df", F.round("idf", 6).alias("idf"))


def high_df_terms(spark, sf_dir):
    return _index(spark, sf_dir).term_stats.where("is_high_df").select("shard", "field", "term", "df")


def champion_lists(spark, sf_dir):
    return _index(spark, sf_dir).champions


def tf_histogram(spark, sf_dir):
    index = _index(spark, sf_dir)
    return build.tf_histogram(index.postings, index.term_stats, index.tf_counts)


def bloom_params(spark, sf_dir):
    index = _index(spark, sf_dir)
    return build.bloom_parameters(build.tf_histogram(index.postings, index.term_stats, index.tf_counts), index.config.bloom_fpr)


def bloom_filters(spark, sf_dir):
    """The bits set in the Bloom filters of the index of part, at 1 % false positives."""
    index = _index(spark, sf_dir, PART)
    return build.bloom_counts(build.bloom_filters(index.postings, index.term_stats, 0.01, index.tf_counts))


def bloom_filters_documents(spark, sf_dir):
    """The bits set in the Bloom filters of the index of documents, at the configured rate."""
    index = _index(spark, sf_dir)
    return build.bloom_counts(build.bloom_filters(index.postings, index.term_stats, index.config.bloom_fpr, index.tf_counts))


def vocabulary(spark, sf_dir):
    return build.vocabulary(_index(spark, sf_dir).postings)


def index_report(spark, sf_dir):
    return _index(spark, sf_dir).report()


def posting_gaps(spark, sf_dir):
    index = _index(spark, sf_dir)
    return build.posting_gaps(index.postings, terms=index.term_stats)


def tf_runs(spark, sf_dir):
    index = _index(spark, sf_dir)
    return build.tf_runs(index.postings, terms=index.term_stats).select("shard", "field", "term", "run", "tf", "repeats")


# -- retrieval ------------------------------------------------------------------------------------


def okapi_exact_topk(spark, sf_dir):
    return _index(spark, sf_dir).search("the Thention reed erblest", k=20, mode="exact")


def okapi_repeated_term(spark, sf_dir):
    return _index(spark, sf_dir).search("reed reed from thention", k=20, mode="exact")


def okapi_max_df(spark, sf_dir):
    return _index(spark, sf_dir).search("the and reed erth of", k=20, mode="exact", max_df=400)


def okapi_stopwords(spark, sf_dir):
    return _index(spark, sf_dir, config=_ENGLISH).search("the reed of erth and", k=20, mode="exact")


def okapi_hybrid_low(spark, sf_dir):
    return _index(spark, sf_dir).search("the thereed erthth and reed erstre", k=20)


def okapi_hybrid_all_high(spark, sf_dir):
    return _index(spark, sf_dir).search("the of and in from", k=20)


def okapi_boosted(spark, sf_dir):
    return _index(spark, sf_dir, PART).search("red BRASS Brand#23 STEEL steel", k=25, mode="exact", boosts={"p_name": 2.0, "p_brand": 1.5})


def okapi_fielded(spark, sf_dir):
    return _index(spark, sf_dir, PART).search({"p_name": "part", "p_type": "BRASS", "p_brand": "Brand#1"}, k=25, mode="exact")


def okapi_hybrid_fielded(spark, sf_dir):
    return _index(spark, sf_dir, PART).search(["part 7", "Brand#1", "BRASS"], k=25, boosts=[2.0, 1.0, 1.0])


def okapi_sharded_topk(spark, sf_dir):
    return _index(spark, sf_dir, config=_SHARDED).search("the thereed erthth and reed", k=20)


def auto_widen(spark, sf_dir):
    return _index(spark, sf_dir).search("reed erth", k=20, mode="exact", max_df=1, auto_widen=True)


def topk_records(spark, sf_dir):
    found = _index(spark, sf_dir).search_records("the Thention reed erblest", k=20, mode="exact")
    return found.select("doc_id", "lang", "source", "n_chars", "text", F.format_string("%.6f", "score").alias("score"))


def topk_quality(spark, sf_dir):
    """Results restricted by a label: a join after ranking."""
    found = _index(spark, sf_dir).search("the Thention reed erblest", k=1000, mode="exact")
    return found.join(_table(spark, sf_dir, "labels").where("quality = 1"), "doc_id").select("doc_id", "score")


def _benchmark_queries(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def okapi_batch(spark, sf_dir):
    return _index(spark, sf_dir).search_batch(_benchmark_queries(spark, sf_dir), k=10, mode="exact")


def okapi_batch_hybrid(spark, sf_dir):
    return _index(spark, sf_dir).search_batch(_benchmark_queries(spark, sf_dir), k=10)


def _written(spark, sf_dir, kind):
    path = f"{shared_path(spark)}/documents.{kind}"
    out = _table(spark, sf_dir, "documents").write
    (out.option("header", True).option("escape", '"').option("quoteAll", True).csv if kind == "csv" else out.json)(path)
    index = SearchIndex.index_file(spark, path, TEXT, key="doc_id")
    return index.search("the Thention reed erblest", k=20, mode="exact")


def csv_roundtrip(spark, sf_dir):
    return _written(spark, sf_dir, "csv")


def json_roundtrip(spark, sf_dir):
    return _written(spark, sf_dir, "json")


def save_load_topk(spark, sf_dir):
    path = shared_path(spark)
    _index(spark, sf_dir).save(path)
    return SearchIndex.load(spark, path).search("the thereed erthth and reed erstre", k=20)


#: In-memory documents: strings, rows of two fields, and dicts, as a caller would hold them.
_SONGS = ["The red moon", "a blue moon over the sea", "red red sun", "the sea the sea the sea", "", "moon , moon", "Straight to the red sea", "a sun of the moon", "rain on the road"]


def memory_docs_topk(spark, sf_dir):
    return SearchIndex.index_documents(spark, list(_SONGS)).search("the red moon sea", k=20, mode="exact")


def memory_rows_topk(spark, sf_dir):
    rows = [(t, f"band {k % 3}") for k, t in enumerate(_SONGS)]
    return SearchIndex.index_documents(spark, rows).search({"c0": "moon sea", "c1": "2"}, k=20, mode="exact", boosts={"c0": 2.0})


def memory_dicts_topk(spark, sf_dir):
    rows = [{"title": t, "artist": f"band {k % 3}"} for k, t in enumerate(_SONGS)]
    return SearchIndex.index_documents(spark, rows).search({"title": "moon sea", "artist": "2"}, k=20, mode="exact", boosts={"title": 2.0})


def parquet_topk(spark, sf_dir):
    return SearchIndex.index_file(spark, f"{sf_dir}/documents.parquet", TEXT, key="doc_id").search("the Thention reed erblest", k=20, mode="exact")


def parquet_records(spark, sf_dir):
    """The records of an indexed Parquet file, in the order of the index's columns."""
    index = SearchIndex.index_file(spark, f"{sf_dir}/documents.parquet", TEXT, key="doc_id")
    found = index.search_records("the Thention reed erblest", k=20, mode="exact")
    return found.select("doc_id", *index.columns())


def unicode_fold_topk(spark, sf_dir):
    return _index(spark, sf_dir, config=_UNICODE).search("étre ÉCHÊ que de", k=20, mode="exact")


def bloom_probe(spark, sf_dir):
    """Documents that the Bloom filters of part's index let through for each high-df term, at 1 %: all of its own, and few others."""
    index = _index(spark, sf_dir, PART)
    filters = build.bloom_filters(index.postings, index.term_stats, 0.01, index.tf_counts)
    probes = index.postings.join(index.term_stats.where("is_high_df").select("shard", "field", "term"), ["shard", "field", "term"], "left_semi")
    found = build.bloom_matches(probes.select("shard", "field", "term", "doc_id"), filters, 0.01)
    return found.groupBy("shard", "field", "term").agg(F.countDistinct("doc_id").alias("n_found"))


def stream_static(spark, sf_dir):
    """A stream of the benchmark texts answered against the static index."""
    schema = _table(spark, sf_dir, "benchmark").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "benchmark.parquet").parquet(sf_dir)
    out = shared_path(spark)
    stream = stream_search(_index(spark, sf_dir), source.select(F.col("item_id").alias("query_id"), "text"), f"{out}/answers", f"{out}/state", k=10, mode="exact")
    stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/answers").select("query_id", "doc_id", "score")


QUERIES = {
    f.__name__: f
    for f in (
        tokenize, tokenize_first_line, tokenize_pages, valid_tokens, stopword_filter, postings_tf, doc_length, doc_freq, doc_freq_part,
        shard_stats, idf_table, high_df_terms, champion_lists, tf_histogram, bloom_params, bloom_filters, bloom_filters_documents, vocabulary, index_report,
        posting_gaps, tf_runs, okapi_exact_topk, okapi_repeated_term, okapi_max_df, okapi_stopwords, okapi_hybrid_low,
        okapi_hybrid_all_high, okapi_boosted, okapi_fielded, okapi_hybrid_fielded, okapi_sharded_topk, auto_widen, topk_records,
        topk_quality, okapi_batch, okapi_batch_hybrid, csv_roundtrip, json_roundtrip, save_load_topk, memory_docs_topk, memory_rows_topk, memory_dicts_topk,
        parquet_topk, parquet_records, unicode_fold_topk, bloom_probe, stream_static,
    )
}

_FLAG = _free("THE THENTION REED ERBLEST")
_LOWQ = f"{_asked(_free('THE THEREED ERTHTH AND REED ERSTRE'))}"
_BENCH = f"asked AS (SELECT item_id AS query_id, i AS position, NULL::INTEGER AS qfield, w[i] AS term FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT item_id, list_filter(string_split(translate(replace(text, chr(10), ' '), '{_LOWER}', '{_UPPER}'), ' '), lambda x : x <> '') AS w FROM benchmark)))"
_VALUES = ", ".join(f"({k}::BIGINT, '{t}', 'band {k % 3}')" for k, t in enumerate(_SONGS))


def _memory(fields: list[str]) -> str:
    """The CTEs of an index over the in-memory documents."""
    base = _base(fields)
    table, key = ("documents", "doc_id") if fields == TEXT else ("part", "p_partkey")
    return base.replace(f"{key} AS doc_id", "doc_id").replace(f"EXCLUDE ({key}) FROM {table}", f"EXCLUDE (doc_id) FROM (VALUES {_VALUES}) AS v(doc_id, {'text, artist' if fields == TEXT else 'title, artist'})")


_TWO = [(0, "MOON"), (0, "SEA"), (1, "2")]

ORACLES = {
    "tokenize": f"WITH {_base()} SELECT doc_id, term, count(*) AS n FROM tokens GROUP BY ALL",
    "tokenize_first_line": f"WITH {_base(first_line=True)} SELECT doc_id, term, count(*) AS n FROM tokens GROUP BY ALL",
    "tokenize_pages": f"WITH t AS (SELECT page_id, unnest(string_split(translate(replace(coalesce(html, ''), chr(10), ' '), '{_LOWER}', '{_UPPER}'), ' ')) AS term FROM pages) SELECT page_id, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM t WHERE term <> '' GROUP BY page_id",
    "valid_tokens": f"WITH {_base()} SELECT doc_id, count(*) AS n_valid FROM tokens WHERE {_VALID} GROUP BY doc_id",
    "stopword_filter": f"WITH {_base()} SELECT term, count(*) AS n FROM tokens WHERE {_VALID}{_STOP} GROUP BY term",
    "postings_tf": f"WITH {_base()} SELECT shard, field, term, doc_id, tf FROM posts",
    "doc_length": f"WITH {_base()} SELECT shard, doc_id, doc_len FROM lengths",
    "doc_freq": f"WITH {_base()} SELECT shard, field, term, df FROM dfs",
    "doc_freq_part": f"WITH {_base(PART)} SELECT shard, field, term, df FROM dfs",
    "shard_stats": f"WITH {_base(shards=4)} SELECT shard, num_docs, round(avg_doc_len, 6) AS avg_doc_len, min_df FROM shards",
    "idf_table": f"WITH {_base()} SELECT shard, field, term, df, round(idf, 6) AS idf FROM terms",
    "high_df_terms": f"WITH {_base()} SELECT shard, field, term, df FROM terms WHERE is_high_df",
    "champion_lists": f"WITH {_base()} SELECT * FROM (SELECT shard, field, term, doc_id, tf, row_number() OVER (PARTITION BY shard, field, term ORDER BY tf DESC, doc_id DESC)::INTEGER AS rank FROM posts JOIN terms USING (shard, field, term) WHERE is_high_df) WHERE rank <= 1000",
    "tf_histogram": f"WITH {_base()} SELECT shard, field, term, tf, count(*) AS num_docs FROM posts JOIN terms USING (shard, field, term) WHERE is_high_df GROUP BY ALL",
    "bloom_params": f"WITH {_base()} SELECT shard, field, term, tf, count(*) AS num_docs, ceil(count(*) * ln(1e-8::DOUBLE) / ln(1 / pow(2::DOUBLE, ln(2::DOUBLE))))::BIGINT AS num_bits, round(-log2(1e-8::DOUBLE))::INTEGER AS num_hashes FROM posts JOIN terms USING (shard, field, term) WHERE is_high_df GROUP BY ALL",
    "bloom_filters": f"""WITH {_base(PART)}, sized AS (
  SELECT shard, field, term, tf, ceil(count(*) * ln(0.01::DOUBLE) / ln(1 / pow(2::DOUBLE, ln(2::DOUBLE))))::BIGINT AS num_bits FROM posts JOIN terms USING (shard, field, term) WHERE is_high_df GROUP BY ALL),
bits AS (
  SELECT shard, field, term, tf, num_bits, (('0x' || substr(md5(doc_id::VARCHAR), 1, 7))::BIGINT + unnest(range(0, 7)) * ('0x' || substr(md5(doc_id::VARCHAR), 8, 7))::BIGINT) % num_bits AS bit
  FROM posts JOIN sized USING (shard, field, term, tf))
SELECT shard, field, term, tf, num_bits, 7::INTEGER AS num_hashes, count(DISTINCT bit) AS n_set FROM bits GROUP BY ALL""",
    "bloom_filters_documents": f"""WITH {_base()}, sized AS (
  SELECT shard, field, term, tf, ceil(count(*) * ln(1e-8::DOUBLE) / ln(1 / pow(2::DOUBLE, ln(2::DOUBLE))))::BIGINT AS num_bits FROM posts JOIN terms USING (shard, field, term) WHERE is_high_df GROUP BY ALL),
bits AS (
  SELECT shard, field, term, tf, num_bits, (('0x' || substr(md5(doc_id::VARCHAR), 1, 7))::BIGINT + unnest(range(0, 27)) * ('0x' || substr(md5(doc_id::VARCHAR), 8, 7))::BIGINT) % num_bits AS bit
  FROM posts JOIN sized USING (shard, field, term, tf))
SELECT shard, field, term, tf, num_bits, 27::INTEGER AS num_hashes, count(DISTINCT bit) AS n_set FROM bits GROUP BY ALL""",
    "vocabulary": f"WITH {_base()} SELECT DISTINCT shard, field, term FROM posts",
    "index_report": f"WITH {_base()} SELECT (SELECT count(*) FROM lengths) AS num_docs, (SELECT sum(doc_len)::BIGINT FROM lengths) AS num_tokens, count(*) AS num_terms, sum(df)::BIGINT AS num_postings, count(*) FILTER (WHERE is_high_df) AS num_high_df_terms FROM terms",
    "posting_gaps": f"WITH {_base()} SELECT shard, field, term, doc_id, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY shard, field, term ORDER BY doc_id) AS gap FROM posts",
    "tf_runs": f"WITH {_base()}, t AS (SELECT *, coalesce((tf <> lag(tf) OVER w)::INTEGER, 0) AS turn FROM posts WINDOW w AS (PARTITION BY shard, field, term ORDER BY doc_id)), r AS (SELECT *, sum(turn) OVER (PARTITION BY shard, field, term ORDER BY doc_id)::BIGINT AS run FROM t) SELECT shard, field, term, run, tf, count(*) AS repeats FROM r GROUP BY ALL",
    "okapi_exact_topk": _exact(_FLAG, 20),
    "okapi_repeated_term": _exact(_free("REED REED FROM THENTION"), 20),
    "okapi_max_df": _exact(_free("THE AND REED ERTH OF"), 20, "df <= 400"),
    "okapi_stopwords": _exact(_free("REED ERTH"), 20, stop=_STOP),
    "okapi_hybrid_low": _hybrid(_LOWQ, 20),
    "okapi_hybrid_all_high": _hybrid(_asked(_free("THE OF AND IN FROM")), 20),
    "okapi_boosted": _exact(_free("RED BRASS BRAND#23 STEEL STEEL"), 25, boost="[2.0, 1.5, 1.0][m.field + 1]", fields=PART),
    "okapi_fielded": _exact([(0, "PART"), (2, "BRASS"), (1, "BRAND#1")], 25, fields=PART),
    "okapi_hybrid_fielded": _hybrid(_asked([(0, "PART"), (0, "7"), (1, "BRAND#1"), (2, "BRASS")]), 25, boost="[2.0, 1.0, 1.0][m.field + 1]", fields=PART),
    "okapi_sharded_topk": _hybrid(_asked(_free("THE THEREED ERTHTH AND REED")), 20, shards=4),
    "auto_widen": f"WITH {_asked(_free('REED ERTH'))}, {_base()}, {_MATCHED}, {_parts()}, used AS (SELECT * FROM parts WHERE df <= (SELECT min(w) FROM (SELECT 1::BIGINT << unnest(range(0, 40)) AS w) WHERE w >= (SELECT min(df) FROM matched))) {_top('used', 20)}",
    "topk_records": f"SELECT d.doc_id, lang, source, n_chars, text, printf('%.6f', score) AS score FROM ({_exact(_FLAG, 20)}) t JOIN documents d ON d.doc_id = t.doc_id",
    "topk_quality": f"SELECT t.doc_id, score FROM ({_exact(_FLAG, 1000)}) t JOIN labels l ON l.doc_id = t.doc_id WHERE quality = 1",
    "okapi_batch": f"WITH {_BENCH}, {_base()}, {_MATCHED}, {_parts()} {_top('parts', 10, True)}",
    "okapi_batch_hybrid": _hybrid(_BENCH, 10, batch=True),
    "csv_roundtrip": _exact(_FLAG, 20),
    "json_roundtrip": _exact(_FLAG, 20),
    "save_load_topk": _hybrid(_LOWQ, 20),
    "memory_docs_topk": f"WITH {_asked(_free('THE RED MOON SEA'))}, {_memory(TEXT)}, {_MATCHED}, {_parts()} {_top('parts', 20)}",
    "memory_rows_topk": f"WITH {_asked(_TWO)}, {_memory(['title', 'artist'])}, {_MATCHED}, {_parts('[2.0, 1.0][m.field + 1]')} {_top('parts', 20)}",
    "memory_dicts_topk": f"WITH {_asked([(1, 'MOON'), (1, 'SEA'), (0, '2')])}, {_memory(['artist', 'title'])}, {_MATCHED}, {_parts('[1.0, 2.0][m.field + 1]')} {_top('parts', 20)}",
    "parquet_topk": _exact(_FLAG, 20),
    "parquet_records": f"SELECT d.doc_id, text, lang, source, n_chars, score FROM ({_exact(_FLAG, 20)}) t JOIN documents d ON d.doc_id = t.doc_id",
    "unicode_fold_topk": _exact(_free("ÉTRE ÉCHÊ QUE DE"), 20).replace(f"translate(replace(coalesce(text, ''), chr(10), ' '), '{_LOWER}', '{_UPPER}')", "upper(replace(coalesce(text, ''), chr(10), ' '))"),
    "bloom_probe": f"WITH {_base(PART)} SELECT shard, field, term, df AS n_found FROM terms WHERE is_high_df",
    "stream_static": f"WITH {_BENCH}, {_base()}, {_MATCHED}, {_parts()} {_top('parts', 10, True)}",
}
