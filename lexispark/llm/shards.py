"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a document's hash.  A bucket is split on one
more bit only if it is over the byte limit, so shards have local depths of their own; a
bucket of a single row, or of rows whose hashes are equal in all bits, cannot be split and
is marked oversize.  Only bucket totals are ever compared; documents move once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

SHARD_BYTES = 16 << 20
BITS = 60


def hash_bits() -> Column:
    """The leading 60 bits of md5(doc_id, md5(text)) as a long; nulls count as empty strings."""
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def text_bytes() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")


def _prefix(bits: str, depth: int) -> Column:
    return F.shiftright(bits, BITS - depth)


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """The shards of (h, bytes) rows: depth, prefix, shard_bytes, shard_rows, oversize.

    A shard is the shallowest prefix whose total fits the limit and none of whose ancestors does.
    """
    cells = table(sizes.groupBy("h").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")))
    total = cells.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    shallow, out = 0, None
    deep = min(BITS, max(1, math.ceil(math.log2(max(1, total) / limit + 1)) + 3))
    while True:
        at = cells.groupBy(_prefix("h", deep).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.count("*").alias("hashes"))
        levels = at.select("*", F.explode(F.sequence(F.lit(shallow), F.lit(deep))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {deep} - depth)"))
        sums = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"), F.sum("hashes").alias("hashes"))
        # a prefix is split when it is too large and still has several hashes
        sums = table(sums.withColumn("split", (F.col("shard_bytes") > limit) & (F.col("hashes") > 1)))
        parents = sums.where("split").select((F.col("depth") + 1).alias("depth"), "prefix")
        reached = sums.select("*", F.shiftright("prefix", 1).alias("up")).join(parents.withColumnRenamed("prefix", "up"), ["depth", "up"], "left_semi")
        if shallow == 0:
            reached = reached.unionByName(sums.where("depth = 0").withColumn("up", F.lit(0).cast("long")))
        leaves = reached.where("not split").select("depth", "prefix", "shard_bytes", "shard_rows", (F.col("shard_bytes") > limit).alias("oversize"))
        out = leaves if out is None else out.unionByName(leaves)
        rest = reached.where(f"split and depth = {deep}").select("prefix")
        if deep == BITS or rest.isEmpty():
            return table(out)
        cells = table(cells.join(table(rest), _prefix("h", deep) == F.col("prefix"), "left_semi"))
        shallow, deep = deep, min(BITS, deep + 8)


def shard_documents(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """docs with shard_id, shard_depth, shard_bytes and shard_oversize; every row is kept once.

    shard_id is the shard's hash prefix in binary digits ('-' for the one shard of depth 0).
    shard_bytes is the UTF-8 size of the texts of the shard, at most ``limit`` unless the shard
    holds a single hash: one document over the limit, or repeated rows (same doc_id and text).

    Null or empty text counts 0 bytes; null doc_id hashes as an empty string; no rows give no
    rows.  Columns of docs are kept; one that is named like an added column is replaced.
    """
    added = ["shard_id", "shard_depth", "shard_bytes", "shard_oversize"]
    docs = docs.drop(*added)
    shards = directory(docs.select(hash_bits().alias("h"), text_bytes().alias("bytes")), limit)
    n = shards.count()
    top = math.ceil(math.log2(n)) + 1 if n > 1 else 0
    # the directory: each entry of `top` bits points to its shard, or to the few that lie below it
    slots = F.expr(f"CASE WHEN depth <= {top} THEN sequence(shiftleft(prefix, {top} - depth), shiftleft(prefix + 1, {top} - depth) - 1) ELSE array(shiftright(prefix, depth - {top})) END")
    entries = shards.withColumn("__slot", F.explode(slots)).groupBy("__slot").agg(F.collect_list(F.struct("depth", "prefix", "shard_bytes", "oversize")).alias("__below"))
    keyed = docs.withColumn("__h", hash_bits())
    found = keyed.join(table(entries), _prefix("__h", top) == F.col("__slot"), "left")
    mine = found.withColumn("__s", F.expr(f"filter(__below, x -> shiftright(__h, {BITS} - x.depth) = x.prefix)[0]"))
    name = F.expr("CASE WHEN __s.depth = 0 THEN '-' ELSE lpad(bin(__s.prefix), __s.depth, '0') END")
    return mine.select(*docs.columns, name.alias("shard_id"), F.col("__s.depth").alias("shard_depth"), F.col("__s.shard_bytes").alias("shard_bytes"), F.col("__s.oversize").alias("shard_oversize"))
