"""Whole-text statistics of documents, as one narrow pass."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import IS_SYMBOL, Piece, mix, pieces, windows

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits", "n_bytes"]

_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?;:~^=_+@/\\{}[]()\"'`"]] = True


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    full = [x for x in text.split(b"\n") if x.strip()]
    return len(full), len(full) - len(set(full))


def _repeated(p: Piece) -> np.ndarray:
    """Per document, the words inside 3-word windows that occur twice or more in it."""
    h = p.word_hashes(lower=False)
    row = p.row_of_word()
    w = windows(h, 3)
    inside = row[: len(w)] == row[2:] if len(w) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    key = mix(w[at] ^ mix(row[at].astype(np.uint64)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(h), bool)
    for k in range(3):
        cover[at[twice] + k] = True
    return np.bincount(row[cover], minlength=p.rows)


def piece_counts(p: Piece) -> list[pa.Array]:
    """The COUNTS of the documents of a piece."""
    chars = p.word & ((p.data & 0xC0) != 0x80)
    lines = np.array([_lines(p.text(i)) for i in range(p.rows)], np.int64).reshape(-1, 2)
    upper = (p.data >= 65) & (p.data <= 90)
    digits = (p.data >= 48) & (p.data <= 57)
    columns = [p.n_words, p.per_row(chars), p.per_row(IS_SYMBOL[p.data]), lines[:, 1], _repeated(p), lines[:, 0], p.per_row(upper), p.per_row(_MARK[p.data]), p.per_row(digits), np.diff(p.offsets)]
    return [pa.array(np.asarray(c, np.int64)) for c in columns]


def _count(batches: Iterator[pa.RecordBatch], keep: tuple[str, ...] = ("doc_id",)) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p in pieces(batch.column("text")):
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(p.first, p.rows) for c in keep), *piece_counts(p)], [*keep, *COUNTS])


def text_counts(docs: DataFrame, keep: dict[str, str] | None = None) -> DataFrame:
    """The COUNTS of each whole text, after doc_id and the columns of ``keep`` (name: type).

    A null text counts as empty.
    """
    kinds = {"doc_id": "long"} | (keep or {})
    docs = docs.select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items()), F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"{c} {k}" for c, k in [*kinds.items(), *((c, "long") for c in COUNTS)])
    return docs.mapInArrow(partial(_count, keep=tuple(kinds)), schema)
