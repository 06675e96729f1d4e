import random

import numpy as np
from helpers import WORD, docs, odd_rows, sentence, vocabulary

from lexispark.llm import cotraining
from lexispark.llm.cotraining import score_quality
from lexispark.llm.rules import Rule, Term, learn_rules, quality_rules, rule_expression

LABELS = "doc_id long, quality int, toxic int"


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    cover = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


def corpus(seed):
    rng, words = random.Random(seed), vocabulary(seed)
    rows = []
    for n in range(160):
        text = sentence(rng, rng.randint(1, 140), words)
        if n % 4 == 0:
            text = " ".join(w + rng.choice(["###", "$$", "%"]) for w in text.split())
        if n % 7 == 0:
            text = "\n".join([text[:30], "é line", text[:30], "", "", "é line", "a a a a"])
        rows.append((n, text, "en", f"s{n % 3}"))
    return rows


def test_counts_and_verdicts_match_brute_force(spark):
    rows = corpus(1) + odd_rows()
    labels = spark.createDataFrame([(r[0], int("#" not in (r[1] or "") and "$" not in (r[1] or "")), 0) for r in rows if r[0] is not None], LABELS)
    out = quality_rules(docs(spark, rows, extra=True), labels).collect()
    want = sorted((str(r[0]), *counts(r[1])) for r in rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == want
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.rule == 0)
    long = [r for r in out if r.n_words >= 50 and not r.base_failed]
    assert all(r.kept == (r.n_symbols == 0) for r in long) and any(r.kept for r in long) and any(not r.kept for r in long)


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], LABELS)
    out = quality_rules(docs(spark, odd_rows()), none).collect()
    assert len(out) == 11 and all(r.kept == (not r.base_failed) for r in out)
    assert quality_rules(docs(spark, []), none).count() == 0
    nulls = spark.createDataFrame([(1, None, None), (None, 0, 0), (1, 0, 1), (1, 1, 0)], LABELS)
    assert quality_rules(docs(spark, odd_rows()), nulls).count() == 11


def test_rules_are_precise_and_ordered(spark):
    rng = np.random.default_rng(2)
    x = rng.random((3000, 3))
    bad = (x[:, 0] > 0.8) & (x[:, 1] < 0.5) | (x[:, 2] > 0.95)
    rules = learn_rules(x, bad, ["a", "b", "c"])
    assert rules and len(rules) <= 12
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x[:500]], "a double, b double, c double")
    got = np.array([r[0] for r in frame.select(rule_expression(rules)).collect()])
    assert np.mean((got > 0) == bad[:500]) > 0.97
    assert learn_rules(x, np.zeros(3000, bool), ["a", "b", "c"]) == []
    assert learn_rules(x, rng.random(3000) < 0.2, ["a", "b", "c"]) == []  # noise has no precise rule
    assert str(Rule((Term("a", True, 0.5), Term("b", False, 2.0)))) == "a > 0.5 AND b <= 2"


def test_cotraining_keeps_good_documents(spark):
    rows = corpus(3)
    labels = spark.createDataFrame([(r[0], int(r[0] % 4 != 0), 0) for r in rows if r[0] % 3], LABELS)
    out = {r.doc_id: r for r in score_quality(docs(spark, rows, extra=True), labels).collect()}
    right = np.mean([out[r[0]].kept == (r[0] % 4 != 0) for r in rows if r[0] % 3 == 0 and len(r[1].split()) > 5])
    assert len(out) == 160 and right > 0.95
    assert all(0 <= r.score <= 1 for r in out.values())


def test_cotraining_odd_input(spark):
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in score_quality(docs(spark, odd_rows()), none).collect()} == {0.5}
    assert score_quality(docs(spark, []), none).count() == 0
    some = spark.createDataFrame([(2, 0, 0), (4, 1, 0), (5, 0, 0), (6, 1, None), (7, 1, 0), (8, 0, 0), (None, 1, 1)], LABELS)
    assert score_quality(docs(spark, odd_rows()), some).count() == 11


def test_views_teach_each_other(spark, monkeypatch):
    """With few labels, pseudo-labels of one view teach the other what is not in the labelled rows."""
    rng, words = random.Random(4), vocabulary(4, 40)
    good, bad = words[:20], words[20:]
    rows = []
    for k in range(900):
        fine = k % 2 == 0
        mine = good if fine else bad
        rows.append((k, " ".join(rng.choice(mine if rng.random() < 0.8 else words) for _ in range(60)), "en", rng.choice("abcd" if fine else "wxyz")))
    # labelled rows name two of eight sources only
    some = [r for r in rows if r[3] in "aw"][:40]
    labels = spark.createDataFrame([(r[0], int(r[0] % 2 == 0), 0) for r in some], LABELS)
    right = {}
    for rounds in (0, 5):
        monkeypatch.setattr(cotraining, "ROUNDS", rounds)
        out = {r.doc_id: r.metadata_score for r in score_quality(docs(spark, rows), labels).collect()}
        right[rounds] = np.mean([(out[r[0]] >= 0.5) == (r[0] % 2 == 0) for r in rows if r[3] not in "aw"])
    assert right[5] > 0.95 > 0.8 > right[0]


def test_draws_are_bounded_when_labels_outnumber_documents(spark, monkeypatch):
    drawn, whole = [], cotraining._draw
    monkeypatch.setattr(cotraining, "_draw", lambda *a: drawn.append(whole(*a)) or drawn[-1])
    rows = corpus(5)
    labels = spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(80, 2000)], LABELS)
    assert score_quality(docs(spark, rows + rows[:30] * 5), labels, 40, 10).count() == len(rows) + 150
    assert drawn and len(drawn[0]) <= 40 and all(len(d) <= 10 for d in drawn[1:])
