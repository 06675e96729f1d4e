"""Substring dedup by hashing lines, the sentences inside them, and blocks of words.

A unit is a line, or a sentence inside a line of several, or the rest of a sentence from a
capitalised word on, or a block: the words from one cut to the first cut ``min_words`` or more
behind it.  Every unit has ``min_words`` words or more; shorter lines are part of blocks.
Cuts are the ends of the text and about one word in ``CUT_EVERY``, picked by the hash of the
word and of the next.  So they depend on near words only, and a passage that was pasted into the
middle of a line, or of a sentence, is found from about its first cut to its last one.  Units are
word sequences in lower case, hashed to 128 bits from running sums over the words of a text, so a
unit costs the same however long it is.  Digests are grouped globally and the occurrence of lowest
rank (doc_id, then offset) stays.  Every other occurrence goes, with its offsets in the original
text kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_split, table

MIN_WORDS = 8
CUT_EVERY = 10
FLUSH_UNITS = 200_000
#: Whether a code point is white space, as str.split takes it; none is beyond U+3000.
_SPACES = np.array([chr(c).isspace() for c in range(0x3002)])
#: Whether a code point is an upper-case letter; those beyond U+0600 open no unit.
_UPPER = np.array([chr(c).isupper() for c in range(0x600)])
_STOPS = np.array([ord(c) for c in ".!?"], np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _codes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of a text, which of them are in words, and where its words start."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    solid = ~_SPACES[np.minimum(code, len(_SPACES) - 1)]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    return code, solid, np.flatnonzero(first)


def _word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word in lower case: the sum of those of its code points and their places in it."""
    code, solid, starts = _codes(text.lower())
    if not len(starts):
        return np.zeros(0, np.uint64)
    code, solid, starts = code[starts[0] :], solid[starts[0] :], starts - starts[0]
    place = np.arange(len(code)) - np.repeat(starts, np.diff(np.append(starts, len(code))))
    return np.add.reduceat(np.where(solid, _mixed(place.astype(np.uint64) << np.uint64(32) | code), np.uint64(0)), starts)


@lru_cache(128)
def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(n - 1, base, np.uint64)), dtype=np.uint64)


def _digests(h: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """128 bits for the words from first to stop each: two polynomials of their hashes, by running sums modulo 2**64."""
    out = np.empty((len(first), 2), "<u8")
    n = 1 << len(h).bit_length()
    for lane, base in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4D)):
        h = _mixed(h + np.uint64(base))
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * _powers(pow(base, -1, 1 << 64), n)[: len(h)], out=total[1:])
        out[:, lane] = (total[stop] - total[first]) * _powers(base, n)[first]
    return out


def _cuts(h: np.ndarray) -> np.ndarray:
    near = (h[:-1] * np.uint64(3) ^ h[1:]) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)
    return np.unique(np.concatenate([[0], np.flatnonzero(near % np.uint64(CUT_EVERY) == 0), [len(h)]]))


def _apart(digest: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which units stay when one that overlaps a unit of the same words before it is left out."""
    keep = np.ones(len(first), bool)
    order = np.lexsort((first, digest[:, 1], digest[:, 0]))
    same = (digest[order[1:]] == digest[order[:-1]]).all(axis=1)
    upto = 0
    for k in np.flatnonzero(same).tolist():
        one, two = order[k], order[k + 1]
        if k == 0 or not same[k - 1]:
            upto = stop[one]
        keep[two] = first[two] >= upto
        if keep[two]:
            upto = stop[two]
    return keep


def units(text: str, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, digests) of the units; offsets are code points, an end takes in the white space that follows."""
    h = _word_hashes(text)
    none = np.zeros(0, np.int64)
    if len(h) < min_words:
        return none, none, np.zeros((0, 2), "<u8")
    code, solid, starts = _codes(text)
    n, size = len(h), len(code)
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    final = np.isin(code[last], _STOPS)
    feeds = np.flatnonzero(code == 10)
    # lines: word ranges between line feeds
    opens, closes = np.append(0, feeds + 1), np.append(feeds, size)
    line_first, line_stop = np.searchsorted(starts, opens), np.searchsorted(starts, closes)
    # sentences: a word opens one at the head of a line, or after a word that ends in a stop
    heads = np.zeros(n + 1, bool)
    heads[line_first] = True
    heads[1:] |= np.append(final[:-1], True)
    heads = np.flatnonzero(heads)
    sentence_end = np.append(heads[1:], n)
    # the rest of a sentence, from each capitalised word on
    capital = np.flatnonzero(_UPPER[np.minimum(code[starts], len(_UPPER) - 1)])
    of = np.searchsorted(heads, capital, side="right") - 1
    first = np.concatenate([line_first, heads, capital])
    stop = np.concatenate([line_stop, sentence_end, sentence_end[of]])
    begin = np.append(starts, size)
    line_of = np.searchsorted(closes, begin[:-1], side="right")
    # an end inside a line is where the next word begins, else it is the end of the line
    after = np.minimum(begin[np.minimum(stop, n)], closes[line_of[np.maximum(stop, 1) - 1]])
    start = np.concatenate([opens, begin[heads], starts[capital]])
    end = np.concatenate([np.minimum(closes + 1, size), after[len(line_first) :]])
    cuts = _cuts(h)
    to = np.searchsorted(cuts, cuts + min_words)
    block_first, block_stop = cuts[to < len(cuts)], cuts[to[to < len(cuts)]]
    first, stop = np.concatenate([first, block_first]), np.concatenate([stop, block_stop])
    start, end = np.concatenate([start, begin[block_first]]), np.concatenate([end, begin[block_stop]])
    # of units with the same words at the same place one is enough
    long = np.flatnonzero(stop - first >= min_words)
    pick = long[np.unique(first[long] * (n + 1) + stop[long], return_index=True)[1]]
    digest = _digests(h, first[pick], stop[pick])
    keep = _apart(digest, first[pick], stop[pick])
    return start[pick][keep], end[pick][keep], digest[keep]


def _unit_rows(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, marks, texts = batch.column("doc_id"), batch.column("mark"), batch.column("text")
        rows, found, total = [], [], 0
        for k in range(len(texts)):
            one = units(texts[k].as_py() or "", min_words)
            rows.append(np.full(len(one[0]), k))
            found.append(one)
            total += len(one[0])
            if total > FLUSH_UNITS:
                yield _unit_batch(ids, marks, rows, found)
                rows, found, total = [], [], 0
        if rows:
            yield _unit_batch(ids, marks, rows, found)


def _unit_batch(ids: pa.Array, marks: pa.Array, rows: list[np.ndarray], found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    row = pa.array(np.concatenate(rows))
    start, end, digest = (np.concatenate(c) for c in zip(*found, strict=True))
    offsets = (np.arange(len(start) + 1) * 16).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(digest))])
    return pa.RecordBatch.from_arrays([ids.take(row), marks.take(row), pa.array(start, pa.int64()), pa.array(end, pa.int64()), packed], ["doc_id", "mark", "start", "end", "digest"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        texts, gone = [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            spans = merged([(s["start"], s["end"]) for s in spans or []])
            if spans:
                edges = [0, *(x for s in spans for x in s), len(text)]
                text = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            texts.append(text)
            gone.append([{"start": a, "end": b} for a, b in spans])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(gone, span), batch.column("n_removed")], ["doc_id", "text", "removed", "n_removed"])


def _marked(docs: DataFrame) -> DataFrame:
    """docs with mark, which tells rows of one doc_id apart: a hash of the text, or 0 where the doc_id is no other row's.

    A hash takes 8 bytes in every row of units that is shuffled, a constant next to none.
    """
    again = table(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("i"), F.lit(True).alias("again")))
    if again.isEmpty():
        return docs.withColumn("mark", F.lit(0).cast("long"))
    joined = docs.join(again, F.col("doc_id").eqNullSafe(F.col("i")), "left")
    return joined.select(*docs.columns, F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0)).cast("long").alias("mark"))


def dedup_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: doc_id, text without its repeated units, removed, n_removed, removed_chars.

    removed lists the (start, end) code point spans of the original text that went, merged, in
    order; putting them back at their offsets restores the text.  n_removed counts units.

    Null text stays null and empty text empty, with nothing removed.  Null doc_id ranks last.
    Rows that repeat a doc_id rank by a hash of their text; rows equal in both are one document
    and stay alike, so a repeat between them is none.  No rows give no rows; further columns
    are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = _marked(docs)
    found = table(docs.where("text is not null").mapInArrow(partial(_unit_rows, min_words=min_words), "doc_id long, mark long, start long, end long, digest binary"))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", "start")
    first = table(found.groupBy("digest").agg(F.count("*").alias("n"), F.min(rank).alias("first")).where("n > 1"))
    later = join_split(found, first, "digest", found.count()).where(~rank.eqNullSafe(F.col("first")))
    gone = table(later.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    gone = gone.select(F.col("doc_id").alias("i"), F.col("mark").alias("m"), "spans", F.size("spans").cast("long").alias("n_removed"))
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left")
    out = joined.select("doc_id", "text", "spans", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed")).mapInArrow(_cut, "doc_id long, text string, removed array<struct<start: long, end: long>>, n_removed long")
    return out.withColumn("removed_chars", F.expr("aggregate(removed, 0L, (a, s) -> a + s.end - s.start)"))
