"""Shared helpers: tables in the cluster's shared folder, hashing, sampling, joins on hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored as table  # noqa: F401  tables in the shared folder

WORD = r"[^\x20\x09-\x0D]+"
HOT_KEYS = 1024
#: Key filters: bits for each key, bits of a piece, and how many pieces (of 1 KiB) there are at most.
KEY_BITS, PIECE_BITS, FILTER_PIECES = 16, 8192, 1 << 15


def join_split(rows: DataFrame, side: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with side, which has one row for each key, and n: how many of ``total`` rows hold it.

    Keys of more than total / HOT_KEYS rows, of which there are fewer than HOT_KEYS, come to the
    rows by broadcast; only the other rows are shuffled by key.  So no key is too much for a task.
    """
    is_hot = F.col("n") * HOT_KEYS > F.lit(max(1, total))
    hot = side.where(is_hot)
    keys = [r[0] for r in hot.select(key).collect()]  # fewer than HOT_KEYS
    if not keys:
        return rows.join(side, key, how)
    among = F.coalesce(F.col(key).isin(keys), F.lit(False))
    return rows.where(among).join(F.broadcast(hot), key).unionByName(rows.where(~among).join(side.where(~is_hot), key, how))


def mark_likely(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """rows with a boolean ``__likely``: true for each row whose ``key`` is in ``keys``, and for few others.

    ``keys`` has one column of 64-bit hashes.  They become a Bloom filter in pieces, which comes to
    the rows by broadcast (2 bytes a key, 32 MiB at most), so rows that cannot match need no shuffle.
    Beyond 2^24 keys the pieces fill up and more rows are marked in vain; none is ever missed.
    """
    keys = keys.toDF("__key")
    n_keys = keys.count()
    if n_keys == 0:
        return rows.withColumn("__likely", F.lit(False))
    n = min(FILTER_PIECES, -(-n_keys * KEY_BITS // PIECE_BITS))
    piece = lambda k: F.pmod(k, F.lit(n)).cast("int")
    spots = lambda k: F.array(*(F.pmod(F.xxhash64(k, F.lit(seed)), F.lit(PIECE_BITS)).cast("int") for seed in range(4)))
    bits = keys.select(piece(F.col("__key")).alias("__piece"), F.explode(spots(F.col("__key"))).alias("__spot"))
    words = bits.groupBy("__piece", F.shiftright("__spot", 6).alias("__word")).agg(F.expr("bit_or(shiftleft(1L, __spot & 63))").alias("__set"))
    by_word = words.groupBy("__piece").agg(F.map_from_entries(F.collect_list(F.struct("__word", "__set"))).alias("__map"))
    pieces = table(by_word.select("__piece", F.expr(f"transform(sequence(0, {PIECE_BITS // 64 - 1}), i -> coalesce(try_element_at(__map, i), 0L))").alias("__words")))
    asked = rows.withColumns({"__piece": piece(key), "__spots": spots(key)}).join(F.broadcast(pieces), "__piece", "left")
    hit = F.expr("forall(__spots, s -> (shiftrightunsigned(get(__words, shiftright(s, 6)), s & 63) & 1L) = 1L)")
    return asked.withColumn("__likely", F.coalesce(hit, F.lit(False))).drop("__piece", "__spots", "__words")


def sums_before(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with a column for each of ``sums``: the total of that expression over all rows before, in the order.

    Rows are dealt into ranges of the order; each range is summed on its own and starts from the
    ranges before it, so the only window over everything has one row for each range.
    """
    placed = table(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__range", F.shiftrightunsigned("__at", 33))
    earlier = (Window.unboundedPreceding, -1)
    parts = placed.groupBy("__range").agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    starts = parts.select(F.col("__range").alias("__r"), *(F.coalesce(F.sum(f"__{n}").over(Window.orderBy("__range").rowsBetween(*earlier)), F.lit(0)).alias(f"__{n}") for n in sums))
    inside = Window.partitionBy("__range").orderBy("__at").rowsBetween(*earlier)
    out = placed.join(starts, F.col("__range") == F.col("__r"))
    return out.select(*df.columns, *((F.col(f"__{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n) for n, c in sums.items()))


def unit_hash(*columns: Column | str, seed: str) -> Column:
    """A double in [0, 1) that depends on the columns and the seed alone."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    return h.cast("double") / F.lit(float(1 << 53))


def crc_bucket(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n."""
    return F.crc32(F.col(column).cast("string")) % n
