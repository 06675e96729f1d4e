"""Quality rules: learned decision lists over text statistics.

Sequential covering on a bounded sample of labelled statistics: a rule is grown as a
conjunction of thresholds by FOIL gain, pruned on rows it was not grown on, and kept while
it is precise enough; the rows it covers leave the sample and the next rule is grown.  The
ordered list is emitted as one conditional Spark expression, so applying it is plain SQL.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, unit_hash
from .stats import text_counts

MAX_SAMPLE = 20_000
MAX_RULES, MAX_TERMS, CUTS = 12, 4, 48
MIN_PRECISION = 0.9

#: Statistics that rules may test: name -> (numerator, denominator or None).
FEATURES = {
    "n_words": ("n_words", None),
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "upper_per_char": ("n_upper", "word_chars"),
    "digits_per_char": ("n_digits", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


@dataclass(frozen=True)
class Term:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass(frozen=True)
class Rule:
    terms: tuple[Term, ...]

    def column(self) -> Column:
        out = self.terms[0].column()
        for t in self.terms[1:]:
            out = out & t.column()
        return out

    def __str__(self) -> str:
        return " AND ".join(map(str, self.terms))


def with_features(counts: DataFrame) -> DataFrame:
    """The FEATURES of text counts; a share of nothing is 0."""
    def share(top: str, under: str | None) -> Column:
        value = F.col(top).cast("double")
        return value if under is None else F.when(F.col(under) > 0, value / F.col(under)).otherwise(F.lit(0.0))

    return counts.select("*", *(share(*v).alias(k) for k, v in FEATURES.items() if k != v[0]))


def _covers(x: np.ndarray, names: list[str], terms: list[Term]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for t in terms:
        v = x[:, names.index(t.feature)]
        out &= v > t.cut if t.above else v <= t.cut
    return out


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str]) -> list[Term]:
    terms: list[Term] = []
    live = np.ones(len(x), bool)
    while len(terms) < MAX_TERMS and not bad[live].all():
        p0, n0 = bad[live].sum(), (~bad[live]).sum()
        if p0 == 0:
            break
        best, gain = None, 1e-9
        for k, name in enumerate(names):
            values = np.unique(x[live, k])
            if len(values) < 2:
                continue
            middle = (values[1:] + values[:-1]) / 2
            cuts = middle if len(middle) <= CUTS else np.unique(np.concatenate([np.quantile(middle, np.linspace(0, 1, CUTS)), np.quantile(x[live, k][bad[live]], np.linspace(0, 1, CUTS))]))
            above = x[live, k][:, None] > cuts[None, :]
            p_up, n_up = (above & bad[live][:, None]).sum(0), (above & ~bad[live][:, None]).sum(0)
            for side, p, n in ((True, p_up, n_up), (False, p0 - p_up, n0 - n_up)):
                g = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - np.log2(p0 / (p0 + n0))), -1)
                if g.max() > gain:
                    gain, best = g.max(), Term(name, side, float(cuts[g.argmax()]))
        if best is None:
            break
        terms.append(best)
        live &= _covers(x, names, [best])
    return terms


def _prune(x: np.ndarray, bad: np.ndarray, names: list[str], terms: list[Term]) -> list[Term]:
    def worth(n: int) -> float:
        hit = bad[_covers(x, names, terms[:n])]
        return (2 * hit.sum() - len(hit)) / max(1, len(hit))

    return terms[: max(range(1, len(terms) + 1), key=lambda n: (round(worth(n), 9), -n))] if terms else []


def learn_rules(x: np.ndarray, bad: np.ndarray, names: list[str], seed: int = 7) -> list[Rule]:
    """The ordered rules for bad rows; none when there are no bad rows or no precise rule."""
    rng = np.random.default_rng(seed)
    rules: list[Rule] = []
    while len(rules) < MAX_RULES and bad.sum() >= 5:
        part = rng.random(len(x)) < 2 / 3
        terms = _prune(x[~part], bad[~part], names, _grow(x[part], bad[part], names))
        if not terms:
            break
        held, hit = bad[~part & _covers(x, names, terms)], _covers(x, names, terms)
        if bad[hit].sum() < 3 or bad[hit].mean() < MIN_PRECISION or len(held) and held.mean() < MIN_PRECISION:
            break
        rules.append(Rule(tuple(terms)))
        x, bad = x[~hit], bad[~hit]
    return rules


def rule_expression(rules: list[Rule]) -> Column:
    """The number, from 1, of the first rule that holds, else 0."""
    out = F.lit(0)
    for k in reversed(range(len(rules))):
        out = F.when(rules[k].column(), F.lit(k + 1)).otherwise(out)
    return out


def fit_rules(features: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE) -> list[Rule]:
    """Rules from a sample, by hash of doc_id, of about max_sample labelled rows (quality 0: bad)."""
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total = marks.count()
    if total == 0:
        return []
    picked = marks.where(unit_hash("doc_id", seed="rules") < min(1.0, max_sample / total))
    rows = features.join(picked, "doc_id").orderBy("doc_id", *FEATURES).select("quality", *FEATURES).toPandas()
    return learn_rules(rows[list(FEATURES)].to_numpy(float), rows["quality"].to_numpy() == 0, list(FEATURES))


def quality_rules(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, rule.

    base_failed is n_words < 50 or 100 * n_repeat_words > 50 * n_words.  kept is false if it
    holds, else when a learned rule holds; rule is that rule's number, else 0.

    Null, empty or wordless text: all counts 0, base_failed, not kept.  Null doc_id and repeated
    rows are judged like any other.  Labels whose doc_id repeats count once, as the worst one.
    No labels, or none of quality 0: no rules, so kept is not base_failed.  No rows give no rows.
    Other columns of docs are not read.
    """
    features = with_features(table(text_counts(docs)))
    rules = fit_rules(features, labels, max_sample)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = features.withColumn("base_failed", base).withColumn("rule", rule_expression(rules))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")
