"""Word tables of whole Arrow text batches, built with numpy on the UTF-8 bytes.

The separators of ``[^\\x20\\x09-\\x0D]+`` are single bytes, so words can be
found and hashed on the bytes of a batch without decoding it.  A batch is cut
into pieces of about ``PIECE_BYTES`` of text (always whole documents), which
bounds the memory of a task whatever the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PIECE_BYTES = 1 << 20
LONG_WORD = 64

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE = np.random.default_rng(20240611).integers(0, 2**64, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE[LOWER]
_P = np.uint64(0x9E3779B97F4A7C15)
_A = np.uint64(0xC2B2AE3D27D4EB4F)
_B = np.uint64(0x165667B19E3779F9)
_C = np.uint64(0x27D4EB2F165667C5)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Piece:
    """Some whole documents: their rows in the batch, bytes, word bounds and word counts."""

    def __init__(self, first: int, offsets: np.ndarray, data: np.ndarray):
        self.first, self.rows = first, len(offsets) - 1
        self.offsets = offsets - offsets[0]
        self.data = data[offsets[0] : offsets[-1]]
        word = np.zeros(len(self.data) + 1, bool)
        word[:-1] = ~IS_SPACE[self.data]
        before = np.zeros(len(self.data) + 1, bool)
        before[1:] = word[:-1]
        before[self.offsets] = False
        self.starts = np.flatnonzero(word & ~before)
        after = np.zeros(len(self.data), bool)
        after[:-1] = word[1:-1]
        inner = self.offsets[1:] - 1
        after[inner[inner >= 0]] = False
        self.ends = np.flatnonzero(word[:-1] & ~after) + 1
        self.first_word = np.searchsorted(self.starts, self.offsets)
        self.n_words = np.diff(self.first_word)
        self.word = word[:-1]

    def per_row(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each document the mask marks."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.n_words)

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()

    def word_hashes(self, lower: bool) -> np.ndarray:
        """A 64-bit hash of each word; with lower, A-Z count as a-z."""
        table = _BYTE_LOWER if lower else _BYTE
        length = self.ends - self.starts
        capped = np.minimum(length, LONG_WORD + 1).astype(np.uint8)
        order = np.argsort(capped, kind="stable")[::-1]
        starts, sizes = self.starts[order], capped[order]
        alive = len(order) - np.searchsorted(sizes[::-1], np.arange(LONG_WORD + 2), side="right")
        h = np.zeros(len(order), np.uint64)
        for k in range(LONG_WORD):
            n = alive[k]
            if n == 0:
                break
            h[:n] = h[:n] * _P + table[self.data[starts[:n] + k]]
        h = mix(h + sizes.astype(np.uint64) * _A)
        for i in range(alive[LONG_WORD]):
            raw = self.data[self.starts[order[i]] : self.ends[order[i]]]
            h[i] = xxhash.xxh64_intdigest((LOWER[raw] if lower else raw).tobytes())
        out = np.empty_like(h)
        out[order] = h
        return out


def pieces(texts: pa.Array | pa.ChunkedArray) -> Iterator[Piece]:
    """Pieces of a batch of texts, in order; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if len(texts) == 0:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, side="right")) - 1
        stop = min(max(stop, row + 1), len(texts))
        yield Piece(row, offsets[row : stop + 1], data)
        row = stop


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` word hashes of one document."""
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        out = mix(out * _B + h[k : len(h) - size + 1 + k] + _C)
    return out


def shingle_set(h: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct ``size``-word shingles of a document's word hashes.

    With fewer words than ``size`` the whole sequence is the one shingle; without
    words the set is empty.
    """
    if len(h) == 0:
        return h
    return np.unique(windows(h, min(size, len(h))))
