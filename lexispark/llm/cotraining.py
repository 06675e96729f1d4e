"""Quality classifier by co-training of a text view and a metadata view.

The text view sees what is in a text: its hashed words and statistics of its writing.  The
metadata view sees what is stated beside it: source, language and size.  Both are ridge logistic
regressions.  In each round every view scores all unlabelled rows, and a bounded draw of those it
is sure of joins the other view's training rows.  Each view is then calibrated on labelled rows
that were held back, and a last regression on the two calibrated log-odds scores all documents.

Only bounded draws of numbers reach the driver; scoring is a Spark expression over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, unit_hash
from .linear import logistic, sigmoid
from .rules import FEATURES, with_features
from .stats import COUNTS, piece_counts
from .textvec import Piece, pieces

#: Rows that are drawn for learning: labelled ones, and of each round, view and label the unlabelled ones.
MAX_LABELLED, PER_ROUND = 12_000, 300
ROUNDS = 5
CONFIDENT = 0.95
WORD_BUCKETS, SOURCE_BUCKETS, LANG_BUCKETS, SIZE_BUCKETS = 64, 64, 16, 24
CONTENT = WORD_BUCKETS + len(FEATURES)


def word_shares(p: Piece) -> pa.Array:
    """How many of a text's words are in each of WORD_BUCKETS hashed buckets, over the square root of their number."""
    bucket = (p.word_hashes(lower=True) >> np.uint64(58)).astype(np.int64)
    n = np.bincount(p.row_of_word() * WORD_BUCKETS + bucket, minlength=p.rows * WORD_BUCKETS).reshape(p.rows, WORD_BUCKETS)
    flat = (n / np.sqrt(np.maximum(1, p.n_words))[:, None]).astype(np.float32).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, WORD_BUCKETS), pa.int32()), pa.array(flat))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep = ["doc_id", "source", "lang", "n_chars"]
    for batch in batches:
        for p in pieces(batch.column("text")):
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(p.first, p.rows) for c in keep), *piece_counts(p), word_shares(p)], [*keep, *COUNTS, "words"])


def _bucket(column: str, n: int) -> Column:
    return F.when(F.col(column).isNull(), F.lit(n)).otherwise(F.pmod(F.xxhash64(column), F.lit(n))).cast("int")


def view_columns(docs: DataFrame) -> DataFrame:
    """doc_id with the views: content (an array of numbers), and the buckets of source, lang and stated size."""
    sized = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), sized.alias("n_chars"))
    schema = "doc_id long, source string, lang string, n_chars long, " + "".join(f"{c} long, " for c in COUNTS) + "words array<float>"
    named = with_features(docs.mapInArrow(_measured, schema))
    content = F.concat("words", F.array(*(F.log1p(F.col(c)).cast("float") for c in FEATURES)))
    size = F.when(F.col("n_chars").isNull(), F.lit(SIZE_BUCKETS)).otherwise(F.least(F.floor(F.log2(F.greatest(F.col("n_chars"), F.lit(0)) + F.lit(1.0))), F.lit(SIZE_BUCKETS - 1))).cast("int")
    return named.select("doc_id", content.alias("content"), _bucket("source", SOURCE_BUCKETS).alias("source_bucket"), _bucket("lang", LANG_BUCKETS).alias("lang_bucket"), size.alias("size_bucket"))


@dataclass
class View:
    """A calibrated linear view: log-odds = scale * (weights . (x - mean) / spread + intercept) + shift."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.spread @ self.weights[:-1] + self.weights[-1]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.scale * self.raw(x) + self.shift, -20, 20)

    def flat(self) -> tuple[np.ndarray, float]:
        """Weights and intercept on the unscaled inputs, calibration included."""
        w = self.scale * self.weights[:-1] / self.spread
        return w, float(self.scale * self.weights[-1] + self.shift - w @ self.mean)


def _fit(x: np.ndarray, y: np.ndarray) -> View:
    spread = x.std(axis=0)
    view = View(x.mean(axis=0), np.where(spread > 1e-9, spread, 1.0), np.zeros(x.shape[1] + 1))
    view.weights = logistic((x - view.mean) / view.spread, y)
    return view


def _calibrate(view: View, x: np.ndarray, y: np.ndarray) -> None:
    if len(np.unique(y)) == 2:
        view.scale, view.shift = logistic(view.raw(x)[:, None], y)


@dataclass
class QualityModel:
    views: tuple[View, View] | None
    mix: np.ndarray  # of the two log-odds, and an intercept


def _matrices(rows: pd.DataFrame) -> list[np.ndarray]:
    """The matrix of each view from rows of view_columns."""
    n = len(rows)
    content = np.array(rows["content"].tolist(), float).reshape(n, CONTENT)
    spread = [np.eye(size + 1)[rows[c].to_numpy(int)].reshape(n, size + 1) for c, size in (("source_bucket", SOURCE_BUCKETS), ("lang_bucket", LANG_BUCKETS), ("size_bucket", SIZE_BUCKETS))]
    return [content, np.hstack(spread)]


def _draw(rows: DataFrame, n: int, seed: str) -> pd.DataFrame:
    """n rows at most, the first by a hash of doc_id and content."""
    order = unit_hash("doc_id", "content", seed=seed)
    return rows.withColumn("__o", order).orderBy("__o", "doc_id").limit(n).toPandas()


def fit_quality(views: DataFrame, max_labelled: int = MAX_LABELLED, per_round: int = PER_ROUND) -> QualityModel:
    """Co-train on views with quality: max_labelled labelled rows, and per_round unlabelled ones of each round, view and label.

    A quarter of the labelled rows is for calibration.  Without both labels in the rest the model
    is the base rate alone.
    """
    labelled = _draw(views.where("quality is not null").withColumn("spot", unit_hash("doc_id", seed="calibration")), max_labelled, "cotraining")
    good, hold = labelled["quality"].to_numpy(int) > 0, labelled["spot"].to_numpy(float) < 0.25
    given = _matrices(labelled)
    y = good[~hold].astype(float)
    if len(np.unique(y)) < 2:
        rate = np.clip(good.mean() if len(good) else 0.5, 0.01, 0.99)
        return QualityModel(None, np.array([0.0, 0.0, np.log(rate / (1 - rate))]))
    rows, marks = [[x[~hold]] for x in given], [[y], [y]]
    free = views.where("quality is null and doc_id is not null")
    for k in range(ROUNDS):
        models = [_fit(np.concatenate(rows[v]), np.concatenate(marks[v])) for v in (0, 1)]
        scored = free.select("*", *(_probability(x).alias(f"p{v}") for v, x in enumerate(_logits(models))))
        added = 0
        for v in (0, 1):
            for mark, sure in ((1.0, F.col(f"p{v}")), (0.0, 1 - F.col(f"p{v}"))):
                found = _draw(scored.where(sure >= CONFIDENT), per_round, f"round {k} {v} {mark}")
                if len(found):
                    rows[1 - v].append(_matrices(found)[1 - v])
                    marks[1 - v].append(np.full(len(found), mark))
                    added += len(found)
        if not added:
            break
    models = [_fit(np.concatenate(rows[v]), np.concatenate(marks[v])) for v in (0, 1)]
    held = [x[hold] for x in given]
    for v in (0, 1):
        _calibrate(models[v], held[v], good[hold].astype(float))
    mix = np.array([1.0, 0.0, 0.0])
    if len(np.unique(good[hold])) == 2:
        mix = logistic(np.stack([models[v].logit(held[v]) for v in (0, 1)], axis=1), good[hold].astype(float))
    return QualityModel((models[0], models[1]), mix)


def _dot(column: str, weights: np.ndarray) -> Column:
    return F.aggregate(F.zip_with(column, F.array(*(F.lit(float(w)) for w in weights)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def _pick(column: str, weights: np.ndarray) -> Column:
    return F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col(column) + 1)


def _probability(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def _logits(models: list[View] | tuple[View, View]) -> list[Column]:
    """The log-odds of each view as Spark expressions."""
    (wc, bc), (wm, bm) = (v.flat() for v in models)
    bound = lambda x: F.greatest(F.lit(-20.0), F.least(F.lit(20.0), x))
    at, parts = 0, F.lit(bm)
    for name, size in (("source_bucket", SOURCE_BUCKETS), ("lang_bucket", LANG_BUCKETS), ("size_bucket", SIZE_BUCKETS)):
        parts = parts + _pick(name, wm[at : at + size + 1])
        at += size + 1
    return [bound(_dot("content", wc) + bc), bound(parts)]


def score_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, per_round: int = PER_ROUND) -> DataFrame:
    """One row per document: doc_id, score, content_score, metadata_score, kept (score >= 0.5); 1 is good.

    Null text counts as empty; null source, lang and n_chars have buckets of their own; null
    doc_id is scored and never learned from.  Labels that repeat a doc_id count once, as the
    worst.  With labels of one kind or none, all rows have the base rate of the labels, or 0.5.
    Rows that repeat are scored alike; no rows give no rows; columns other than doc_id, text,
    source, lang and n_chars are not read.
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    views = table(table(view_columns(docs)).join(marks, "doc_id", "left"))
    model = fit_quality(views, max_labelled, per_round)
    if model.views is None:
        flat = F.lit(float(sigmoid(model.mix[-1])))
        return views.select("doc_id", flat.alias("score"), flat.alias("content_score"), flat.alias("metadata_score"), (flat >= 0.5).alias("kept"))
    content, metadata = _logits(model.views)
    both = views.select("doc_id", content.alias("c"), metadata.alias("m"))
    score = _probability(float(model.mix[0]) * F.col("c") + float(model.mix[1]) * F.col("m") + float(model.mix[2]))
    return both.select("doc_id", score.alias("score"), _probability(F.col("c")).alias("content_score"), _probability(F.col("m")).alias("metadata_score")).withColumn("kept", F.col("score") >= 0.5)
