"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_conversations, loss_text
from .cotraining import score_quality
from .decontaminate import find_leaks
from .langid import identify_languages
from .mixing import BLOCK_BITS, BLOCK_WORDS, LEVELS, SEED, plan_mix
from .minhash import near_duplicates
from .passages import dedup_passages
from .rules import quality_rules
from .shards import shard_documents, text_bytes
from .toxicity import score_toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(_read(spark, sf_dir, "documents"))


TRICKY = r"\### Assistant: </turn> ok"


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    done = format_conversations(rows.unionByName(extra))
    loss = loss_text(F.col("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), shingle=2)


#: A limit that splits buckets several times over even on the smallest tables.
QUERY_SHARD_BYTES = 256 << 10


def op5_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").withColumn("n_bytes", text_bytes())
    return shard_documents(docs, QUERY_SHARD_BYTES).select("doc_id", "n_bytes", "shard_id", "shard_depth", "shard_bytes", "shard_oversize")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan_mix(_read(spark, sf_dir, "documents"))
    shards = F.array_join(F.transform("copies", lambda c: c["shard"].cast("string")), ",")
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).alias("taken"), shards.alias("shards"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_substring_dedup": op2_substring_dedup,
    "op6_chat_formatting": op6_chat_formatting,
    "op3_quality_cotraining": op3_quality_cotraining,
    "op4_language_id": op4_language_id,
    "op7_toxicity": op7_toxicity,
    "op5_extendible_sharding": op5_extendible_sharding,
    "op9_mix_sources": op9_mix_sources,
    "op10_quality_rules": op10_quality_rules,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
}

def sharding_sql(limit: int) -> str:
    """DuckDB SQL for op5 at a byte limit: the shallowest hash prefix that fits or cannot be split."""
    return f"""
WITH keyed AS (
  SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
levels AS (SELECT r, doc_id, n_bytes, h, d AS depth, h >> (60 - d) AS prefix FROM keyed, (SELECT unnest(range(0, 61))::INTEGER AS d)),
sums AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(DISTINCT h) AS hashes FROM levels GROUP BY ALL),
fits AS (SELECT r, levels.doc_id, n_bytes, depth, prefix, shard_bytes,
    row_number() OVER (PARTITION BY r ORDER BY depth) AS k
  FROM levels JOIN sums USING (depth, prefix) WHERE shard_bytes <= {limit} OR hashes = 1)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '-' ELSE lpad(bin(prefix), depth, '0') END AS shard_id,
  depth AS shard_depth, shard_bytes, shard_bytes > {limit} AS shard_oversize
FROM fits WHERE k = 1
"""


def _urn_sql(level: int) -> str:
    """One level of the splitting tree: t{level} (node, grp, source, q) halved into t{level + 1}, by two draws block by block."""
    def walk(urns: str, name: str) -> str:
        unit = f"('0x' || substr(md5('{SEED}/' || urn || '/' || r), 1, 13))::BIGINT / {float(1 << 52)!r}::DOUBLE"
        return f"""
{name}(urn, r, lack, went) AS (
  SELECT DISTINCT urn, n, lack, false FROM {urns}
  UNION ALL SELECT urn, r - 1, lack - hit::INTEGER, hit FROM (SELECT *, {unit} * r < lack AS hit FROM {name} WHERE r > 0))"""

    def drawn(urns: str, name: str, keys: str) -> str:
        return f"SELECT {keys}, count(w.urn)::BIGINT AS x FROM {urns} u LEFT JOIN {name} w ON w.urn = u.urn AND went AND n - r > upto - q AND n - r <= upto GROUP BY ALL"

    return f"""
a{level} AS (
  SELECT *, sum(q) OVER (PARTITION BY node ORDER BY grp)::BIGINT AS upto, sum(q) OVER (PARTITION BY node)::BIGINT AS n,
    sum(q) OVER (PARTITION BY node)::BIGINT // 2 AS lack, node::VARCHAR AS urn
  FROM (SELECT node, grp, sum(q)::BIGINT AS q FROM t{level} GROUP BY ALL)),{walk(f"a{level}", f"v{level}")},
g{level} AS MATERIALIZED ({drawn(f"a{level}", f"v{level}", "u.node, u.grp")}),
b{level} AS MATERIALIZED (
  SELECT t.*, sum(q) OVER (PARTITION BY t.node, t.grp ORDER BY source NULLS LAST)::BIGINT AS upto, sum(q) OVER (PARTITION BY t.node, t.grp)::BIGINT AS n,
    g.x AS lack, t.node || '/' || t.grp AS urn
  FROM t{level} t JOIN g{level} g ON g.node = t.node AND g.grp = t.grp),{walk(f"b{level}", f"w{level}")},
h{level} AS MATERIALIZED ({drawn(f"b{level}", f"w{level}", "u.node, u.grp, u.source, u.q")}),
t{level + 1} AS MATERIALIZED (SELECT 2 * node AS node, grp, source, x AS q FROM h{level} UNION ALL SELECT 2 * node + 1, grp, source, q - x FROM h{level})"""


def mixing_sql() -> str:
    """DuckDB SQL for op9, the splitting tree included."""
    return rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight
  FROM sized GROUP BY source),
steep AS (SELECT *, 2 * source_size AS cap, (2 * source_size)::DOUBLE / weight AS steep FROM sources),
filled AS (
  SELECT *, row_number() OVER o AS pos,
    (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0)::DOUBLE)
      / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM steep WINDOW o AS (ORDER BY steep, source NULLS LAST),
    b AS (ORDER BY steep, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
    least(cap::DOUBLE, coalesce(weight * (SELECT arg_min(level, pos) FROM filled WHERE steep >= level), cap)::DOUBLE) AS target,
    len(list_filter(range(0, {BLOCK_BITS}), lambda k : {BLOCK_WORDS}::BIGINT * (1::BIGINT << k) < source_size)) AS bits
  FROM filled),
placed AS (
  SELECT s.*, t.source_size, t.target, h >> (60 - bits)::INTEGER AS block
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
blocks AS (
  SELECT source, block, source_size, target, sum(size) AS words FROM placed GROUP BY ALL),
ends AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY block) AS upto FROM blocks),
quotas AS (
  SELECT *, upto - words AS low, least(target, source_size::DOUBLE) AS q0,
    least(greatest(target - source_size, 0), source_size::DOUBLE) AS q1 FROM ends),
takes AS MATERIALIZED (
  SELECT source, block, (q0 > 0 AND upto <= q0)::INTEGER + (q1 > 0 AND upto <= q1)::INTEGER AS n,
    CASE WHEN low < q1 AND q1 < upto THEN q1 - low WHEN low < q0 AND q0 < upto THEN q0 - low END AS part
  FROM quotas),
copies AS (SELECT source, block, unnest(range(0, n + (part IS NOT NULL)::INTEGER)) AS epoch, n FROM takes),
taken AS MATERIALIZED (
  SELECT *, epoch >= n AS partial, row_number() OVER (PARTITION BY source ORDER BY md5('{SEED}/' || block || '/' || epoch), block, epoch) AS rank FROM copies),
counts AS (SELECT source, count(*)::BIGINT AS q FROM taken GROUP BY source),
t0 AS MATERIALIZED (
  SELECT 0::BIGINT AS node, ('0x' || substr(md5(coalesce(source, '')), 1, 8))::BIGINT % (floor(sqrt((SELECT count(*) FROM counts) - 1))::BIGINT + 1) AS grp, source, q
  FROM counts),{",".join(_urn_sql(k) for k in range(LEVELS))},
shares AS (SELECT source, node AS shard, q, sum(q) OVER (PARTITION BY source ORDER BY node) AS upto FROM t{LEVELS}),
homes AS MATERIALIZED (
  SELECT t.source, t.block, t.epoch, t.partial, s.shard
  FROM taken t JOIN shares s ON t.source IS NOT DISTINCT FROM s.source AND t.rank > s.upto - s.q AND t.rank <= s.upto),
docs AS (
  SELECT p.*, part, row_number() OVER () AS row,
    coalesce(sum(size) OVER (PARTITION BY p.source, p.block ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM placed p JOIN takes t ON p.source IS NOT DISTINCT FROM t.source AND p.block = t.block)
SELECT doc_id, size, source_size, target, (size * count(epoch))::BIGINT AS taken, coalesce(string_agg(shard::VARCHAR, ',' ORDER BY epoch), '') AS shards
FROM docs d LEFT JOIN homes x ON d.source IS NOT DISTINCT FROM x.source AND d.block = x.block AND (NOT partial OR (before < part AND 2 * before + size <= 2 * part))
GROUP BY row, doc_id, size, source_size, target
"""


ORACLES = {
    "op5_extendible_sharding": sharding_sql(QUERY_SHARD_BYTES),
    "op8_minhash_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i : w[i] || ' ' || w[i + 1])) END AS s
  FROM words),
items AS (SELECT doc_id, unnest(s) AS x FROM sets),
codes AS (SELECT doc_id, hash(x) AS x FROM items),
common AS (
  SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n
  FROM codes p JOIN codes q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sets sa ON sa.doc_id = a JOIN sets sb ON sb.doc_id = b
  WHERE 100 * n >= 80 * (len(sa.s) + len(sb.s) - n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
comps AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN comps ON a = doc_id
""",
    "op9_mix_sources": mixing_sql(),
    "op6_chat_formatting": rf"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(regexp_replace(role, '[^\\<#]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) + 13)::BIGINT AS formatted_chars
FROM given GROUP BY conv_id
""",
}
