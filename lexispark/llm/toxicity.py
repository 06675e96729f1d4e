"""Toxicity: a sparse logistic classifier that is regularised by counterfactuals.

A text is the set of its hashed lower-case words, and of the stems of its longer words at the
counts they reach, so that inflected forms are known by what they share.  In learning, the identity terms of a sentence
are swapped for other terms of their group and the squared change of the score is penalised, so
that the mention of a group does not move the score by itself.  Weights are learned by
follow-the-regularised-leader steps with an elastic-net penalty, on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, table, unit_hash
from .linear import Ftrl, sigmoid
from .textvec import Piece, pieces

BITS, STEM, LEVELS = 20, 6, (1, 2, 3, 5)
FEATURE_BITS = BITS + 3
#: Labelled rows that are learned from, and the bytes of their texts: the tighter bound holds.
MAX_SAMPLE, MAX_BYTES = 16_000, 128 << 20
MIN_DOCS = 4
EPOCHS = 8
SWAP_PENALTY = 4.0
L1 = 30.0
#: How much more a toxic row counts in learning than another.
TOXIC_WEIGHT = 2.0

#: Identity terms by group: a term may be swapped for any other of its group.
IDENTITIES = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "sikh", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "sikhs", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "hispanic"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "blind", "deaf", "elderly", "young", "old"),
)
_IS_EDGE = np.zeros(256, bool)
_IS_EDGE[list(b".,;:!?\"'()[]{}<>*#$%&|~-_")] = True
_IS_EDGE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _hash_words(words: list[bytes]) -> np.ndarray:
    data = " ".join(w.decode("utf-8", "replace") for w in words)
    return next(pieces(pa.array([data]))).word_hashes(lower=True) if words else np.zeros(0, np.uint64)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def identity_slots() -> list[np.ndarray]:
    return [_slot(_hash_words([t.encode() for t in group])) for group in IDENTITIES]


IDENTITY_SLOTS = np.unique(np.concatenate(identity_slots()))


def trimmed(p: Piece) -> np.ndarray:
    """Cut edge punctuation off the words of a piece, which lose words of marks alone; the rows of the rest."""
    if not len(p.data):
        return np.zeros(0, np.int64)
    inner = np.flatnonzero(~_IS_EDGE[p.data])
    if not len(inner):
        p.starts = p.ends = p.starts[:0]
        return np.zeros(0, np.int64)
    first = np.searchsorted(inner, p.starts)
    starts = inner[np.minimum(first, len(inner) - 1)]
    ends = inner[np.maximum(np.searchsorted(inner, p.ends) - 1, 0)] + 1
    full = (starts >= p.starts) & (ends <= p.ends) & (ends > starts)
    row = p.row_of_word()[full]
    p.starts, p.ends = starts[full], ends[full]
    return row


def features(p: Piece, words: np.ndarray | None = None, stems: np.ndarray | None = None) -> np.ndarray:
    """The sorted distinct (row << FEATURE_BITS | feature) of a piece.

    Features are the words, and for words of more than STEM bytes their stems, at each of the
    LEVELS that the stem's count in the text reaches; identity terms have no stem, so that a swap
    leaves nothing of them.  With sorted words and stems only those
    slots are looked at.
    """
    row = trimmed(p)
    word = _slot(p.word_hashes(lower=True))
    long = (p.ends - p.starts > STEM) & ~np.isin(word, IDENTITY_SLOTS)
    p.starts, p.ends = p.starts[long], p.starts[long] + STEM
    stem, at = _slot(p.word_hashes(lower=True)), row[long]
    if words is not None:
        keep = np.isin(word, words)
        row, word = row[keep], word[keep]
    if stems is not None:
        keep = np.isin(stem, stems)
        at, stem = at[keep], stem[keep]
    found = [np.unique((row << FEATURE_BITS) | word)]
    pair, count = np.unique((at << FEATURE_BITS) | stem, return_counts=True)
    for k, least in enumerate(LEVELS, 1):
        found.append(pair[count >= least] + (k << BITS))
    return np.sort(np.concatenate(found))


@dataclass
class ToxicityModel:
    ids: np.ndarray  # sorted features of non-zero weight
    weights: np.ndarray
    intercept: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        slot, kind = self.ids & ((1 << BITS) - 1), self.ids >> BITS
        words, stems = slot[kind == 0], np.unique(slot[kind > 0])
        out = []
        for p in pieces(texts):
            z = np.full(p.rows, self.intercept)
            if len(self.ids):
                pair = features(p, words, stems)
                one = pair & ((1 << FEATURE_BITS) - 1)
                at = np.minimum(np.searchsorted(self.ids, one), len(self.ids) - 1)
                hit = self.ids[at] == one
                np.add.at(z, pair[hit] >> FEATURE_BITS, self.weights[at[hit]])
            out.append(sigmoid(z))
        return np.concatenate(out) if out else np.zeros(0)


def learn_toxicity(docs: list[np.ndarray], toxic: np.ndarray, penalty: float = SWAP_PENALTY, l1: float = L1, weight: float = TOXIC_WEIGHT, seed: int = 3) -> ToxicityModel:
    """A model from sets of features and 0/1 labels; without both labels it scores the base rate."""
    rate = float(np.clip(toxic.mean() if len(toxic) else 0.0, 1e-3, 1 - 1e-3))
    base = float(np.log(rate / (1 - rate)))
    if len(np.unique(toxic)) < 2:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), base)
    seen = np.zeros(1 << FEATURE_BITS, np.int32)
    for d in docs:
        seen[d] += 1
    groups = identity_slots()
    named = np.unique(np.concatenate(groups))
    use = seen >= MIN_DOCS
    use[named] = True
    kept = np.flatnonzero(use)
    docs = [np.searchsorted(kept, d[use[d]]).astype(np.int32) for d in docs]
    groups = [np.searchsorted(kept, g) for g in groups]
    group_of = {int(t): g for g in groups for t in g}
    bias = len(kept)
    model = Ftrl(bias + 1, 1, alpha=0.3, l1=l1, l2=1.0)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(docs)):
            ids = np.append(docs[k], bias)
            swapped = [(int(t), group_of[int(t)]) for t in docs[k] if int(t) in group_of]
            w = model.weights(ids)[:, 0]
            gradient = np.full(len(ids), (weight if toxic[k] else 1.0) * (sigmoid(w.sum()) - toxic[k]))
            model.step(ids, gradient[:, None], w[:, None])
            if swapped:
                out = np.array([t for t, _ in swapped])
                into = np.array([int(rng.choice(g[g != t])) for t, g in swapped])
                rows, sign = np.unique(np.concatenate([out, into]), return_inverse=True)
                change = np.bincount(sign, weights=np.concatenate([np.ones(len(out)), -np.ones(len(into))]))
                w = model.weights(rows)[:, 0]
                model.step(rows, (2 * penalty * (w @ change) * change)[:, None], w[:, None])
    w = model.weights()[:, 0]
    at = np.flatnonzero(w[:-1])
    return ToxicityModel(kept[at], w[at], float(w[-1]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE, max_bytes: int = MAX_BYTES) -> ToxicityModel:
    """Learn from labelled rows, by hash, of those whose crc32(doc_id) mod 5 is not 0: about max_sample, or max_bytes of text."""
    marks = labels.where("doc_id is not null and toxic is not null").where(crc_bucket("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = table(marks.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")))
    sizes = docs.select("doc_id", F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).alias("size")).join(marks, F.col("doc_id") == F.col("id"))
    total, n_bytes = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if total == 0:
        return learn_toxicity([], np.zeros(0))
    chance = min(1.0, max_sample / total, max_bytes / max(1, n_bytes))
    picked = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(unit_hash("doc_id", "text", seed="toxicity") < chance)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[np.ndarray] = []
            for p in pieces(batch.column("text")):
                pair = features(p)
                bounds = np.searchsorted(pair, np.arange(p.rows + 1) << FEATURE_BITS)
                found += [pair[a:b] & ((1 << FEATURE_BITS) - 1) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([f.astype(np.int32) for f in found], pa.list_(pa.int32()))], ["doc_id", "toxic", "ids"])

    sample = picked.join(marks, F.col("doc_id") == F.col("id")).select("doc_id", "toxic", "text").dropDuplicates(["doc_id", "text"])
    rows = sample.mapInArrow(rows_of, "doc_id long, toxic int, ids array<int>").toArrow().to_pandas()
    rows = rows.assign(n=rows["ids"].map(len)).sort_values(["doc_id", "n"])
    toxic = (rows["toxic"].to_numpy() > 0).astype(float)
    return learn_toxicity(list(rows.pop("ids")), toxic)


def score_toxicity(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, from the whole text alone.

    Null and empty texts have the score of the intercept.  Rows that repeat are learned once.  Null labels are not learned; of labels
    that repeat a doc_id the greatest counts.  A row of null doc_id is scored and not held out.
    Rows that repeat are scored alike; no rows give no rows; without both kinds of labels the
    score is the base rate.  Further columns are not read.
    """
    model = fit_toxicity(docs, labels, max_sample)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(batch.column("text")), pa.float64())], ["doc_id", "score"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.mapInArrow(score, "doc_id long, score double")
    held = F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
