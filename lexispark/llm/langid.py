"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over every row that may be learned from.  The weights are
learned from a sample of at most about ``MAX_PER_LANGUAGE`` whole texts of each of the
``MAX_LANGUAGES`` commonest languages, drawn by hash, with follow-the-regularised-leader steps
and an elastic-net penalty; a part of the sample is held back to calibrate the temperature of the
scores.

A softmax over the learned languages is sure of itself on text of none of them, so the filter also
looks at how rare a text's n-grams are among the learnable rows (see LanguageModel.rarity).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, unit_hash
from .linear import Ftrl, softmax, temperature

GRAMS = (1, 2, 3)
BUCKETS = 1 << 14
MAX_PER_LANGUAGE, MAX_LANGUAGES, MAX_SAMPLE = 400, 256, 20_000
EPOCHS = 4
#: A document is kept when its score is so many times that of a guess among the languages (see least_score).
LEAST_LIFT = 1.1
#: A document goes when its n-grams are, on logarithmic average, over e ** RARITY_MARGIN times rarer than those of 99 in 100
#: texts of the sample; every text is read with RARITY_PRIOR further n-grams of the sample's average, so that a few say little.
RARITY_MARGIN, RARITY_PRIOR = 2.0, 30
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_MUL = np.uint32(0x9E3779B1)


def gram_counts(text: str) -> np.ndarray:
    """How often each bucket of hashed character n-grams occurs in a text, in lower case."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(BUCKETS, np.int64)
    h = np.full(len(code), 17, np.uint32)
    for n in range(1, max(GRAMS) + 1):
        h = (h[: len(code) - n + 1] ^ code[n - 1 :]) * _MUL
        h ^= h >> np.uint32(15)
        if n in GRAMS and len(h):
            out += np.bincount((h * np.uint32(0x85EBCA6B)) >> np.uint32(18), minlength=BUCKETS)
    return out


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of a Unicode category L."""
    return text is not None and any(m.group().isalpha() for m in _LETTER.finditer(text))


def rarity(counts: np.ndarray, idf: np.ndarray) -> float:
    """The average inverse document frequency of all n-grams of a text."""
    return float(counts @ idf) / max(1, int(counts.sum()))


def vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-zero buckets and their TF-IDF values (1 + log tf), of unit length."""
    at = np.flatnonzero(counts)
    v = (1 + np.log(counts[at])) * idf[at]
    return at, v / max(np.sqrt((v * v).sum()), 1e-12)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (BUCKETS + 1, languages): the last row is the intercept
    temperature: float
    usual: float = 0.0  # the rarity of a text of the sample, on average
    rarest: float = np.inf  # and the most that a text of a known language has

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """The likeliest language, its calibrated probability, and whether the text is like the learned ones; UNKNOWN, 0 and False without a letter."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, False
        counts = gram_counts(text)
        at, v = vector(counts, self.idf)
        p = softmax((v @ self.weights[at] + self.weights[-1]) / self.temperature)
        k, n = int(p.argmax()), int(counts.sum())
        shrunk = (n * rarity(counts, self.idf) + RARITY_PRIOR * self.usual) / (n + RARITY_PRIOR)
        return self.languages[k], float(p[k]), shrunk <= self.rarest

    def score(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column("text"):
            total += gram_counts(text.as_py()) > 0
            rows += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, BUCKETS)), pa.array(np.append(total[at], rows))], ["bucket", "n"])


def learnable(docs: DataFrame, may_learn: Column) -> DataFrame:
    return docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull())


def fit_language_model(docs: DataFrame, may_learn: Column, per_language: int = MAX_PER_LANGUAGE, seed: int = 5) -> LanguageModel:
    """Learn from text and lang of rows where may_learn holds; a model of no languages if there are none."""
    rows = learnable(docs, may_learn)
    seen = rows.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS + 1)
    df[seen["bucket"].to_numpy(int)] = seen["n"].to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    # at most MAX_LANGUAGES rows, so they can come to every task
    common = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    spot = unit_hash("doc_id", "text", seed="fold")
    least = min(per_language, MAX_SAMPLE / max(1, common.count()))
    picked = rows.join(F.broadcast(common), "lang").where(unit_hash("doc_id", "text", seed="langid") * F.col("n") < least)
    picked = picked.select("lang", "text", spot.alias("spot")).dropDuplicates(["lang", "spot"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [gram_counts(t.as_py()) for t in batch.column("text")]
            found = [vector(c, idf) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1].astype(np.float32) for f in found], pa.list_(pa.float32())), batch.column("spot"), pa.array([rarity(c, idf) for c in counts], pa.float64())],
                ["lang", "at", "v", "spot", "rarity"],
            )

    sample = picked.mapInArrow(features, "lang string, at array<int>, v array<float>, spot double, rarity double")
    sample = sample.toArrow().to_pandas().sort_values(["spot", "lang"]).reset_index(drop=True)
    languages = sorted(sample["lang"].unique())
    if not languages:
        return LanguageModel([], idf, np.zeros((BUCKETS + 1, 0)), 1.0)
    truth = np.searchsorted(np.array(languages, object), sample["lang"].to_numpy())
    held = sample["spot"].to_numpy() * 1e4 % 1 < 0.2
    ids = [np.append(a, BUCKETS).astype(np.int32) for a in sample.pop("at")]
    values = [np.append(v, 1).astype(np.float32) for v in sample.pop("v")]
    model = Ftrl(BUCKETS + 1, len(languages), alpha=1.0, l1=0.02, l2=0.01)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for k in rng.permutation(np.flatnonzero(~held)):
            w = model.weights(ids[k])
            p = softmax(values[k] @ w)
            p[truth[k]] -= 1
            model.step(ids[k], values[k][:, None] * p, w)
    w = model.weights()
    logits = np.array([values[k] @ w[ids[k]] for k in np.flatnonzero(held)]).reshape(-1, len(languages))
    rare = sample["rarity"].to_numpy()
    return LanguageModel([str(x) for x in languages], idf, w, temperature(logits, truth[held]), float(rare.mean()), float(np.quantile(rare, 0.99)) + RARITY_MARGIN)


def prediction(model: LanguageModel) -> Column:
    """A struct of lang_pred, score and like_learned from the whole of column text."""

    @F.pandas_udf("lang_pred string, score double, like_learned boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.judge(t) for t in texts], columns=["lang_pred", "score", "like_learned"])

    return predict(F.col("text").cast("string"))


def _held_out() -> Column:
    return F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False))


def identify_languages(docs: DataFrame, per_language: int = MAX_PER_LANGUAGE) -> DataFrame:
    """docs with held_out, lang_pred and score, learned from rows whose crc32(doc_id) mod 4 is not 2.

    lang_pred is a language seen in learning, or 'und' with score 0 when the text is null or has
    no letter, or when there was nothing to learn from.  Null lang is never learned, nor are tags
    beyond the MAX_LANGUAGES commonest; a row of
    null doc_id is scored, not learned from, and not held out.  Rows that repeat are scored
    alike.  No rows give no rows.  lang, source and doc_id never enter a prediction.
    """
    model = fit_language_model(docs, F.col("doc_id").isNotNull() & ~_held_out(), per_language)
    out = docs.drop("held_out", "lang_pred", "score").withColumn("held_out", _held_out())
    return out.withColumn("__p", prediction(model)).select(*out.columns, F.col("__p.lang_pred").alias("lang_pred"), F.col("__p.score").alias("score"))


def least_score(languages: int, lift: float = LEAST_LIFT) -> float:
    """``lift`` times chance, and never more than halfway from chance to certainty, so that every bar can be reached."""
    chance = 1 / max(1, languages)
    return min(lift * chance, (1 + chance) / 2)


def keep_known_languages(docs: DataFrame, lift: float = LEAST_LIFT) -> DataFrame:
    """docs without those whose language is unknown, scored under least_score, or unlike the learned ones; same columns.

    Short texts are scored low without being wrong, so the bar is low; text in a script or of letters
    that were not learned goes for its rare n-grams.  Where one language was learned, its score is
    always 1 and only rarity tells; where nothing could be learned, every language is unknown and no
    row stays.  A language that shares most of its n-grams with a learned one is taken for it.
    """
    model = fit_language_model(docs, F.col("doc_id").isNotNull() & ~_held_out())
    found = docs.withColumn("__p", prediction(model))
    return found.where((F.col("__p.lang_pred") != UNKNOWN) & F.col("__p.like_learned") & (F.col("__p.score") >= least_score(len(model.languages), lift))).select(*docs.columns)
