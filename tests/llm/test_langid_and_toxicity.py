import random
import zlib

import numpy as np
import pyarrow as pa
from helpers import docs, odd_rows, sentence

from lexispark.llm import langid
from lexispark.llm.langid import gram_counts, has_letter, identify_languages, keep_known_languages, least_score
from lexispark.llm.linear import Ftrl, softmax, temperature
from lexispark.llm.toxicity import IDENTITIES, SWAP_PENALTY, features, learn_toxicity, score_toxicity
from lexispark.llm.textvec import pieces

WORDS = {
    "en": "the of and with that from have this which house water light night street".split(),
    "de": "der die und mit dass von haben diese welche haus wasser licht nacht straße".split(),
    "fr": "le la et avec que depuis avoir cette laquelle maison eau lumière nuit rue".split(),
}


def corpus(seed, n=240):
    rng = random.Random(seed)
    return [(i, sentence(rng, rng.randint(4, 40), WORDS[lang]), lang, "s") for i in range(n) for lang in [rng.choice(list(WORDS))]]


def test_held_out_languages(spark):
    rows = corpus(1)
    out = identify_languages(docs(spark, rows, extra=True)).collect()
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in out if r.held_out]
    assert len(held) > 30 and np.mean([r.lang == r.lang_pred for r in held]) > 0.95


def test_held_out_labels_are_not_learned(spark):
    rows = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s) for i, t, lang, s in corpus(2)]
    assert "xx" not in {r.lang_pred for r in identify_languages(docs(spark, rows)).collect()}


def test_odd_texts(spark):
    rows = odd_rows() + [(100 + r[0], *r[1:]) for r in corpus(3)]
    out = {(r.doc_id, r.lang_pred, r.score) for r in identify_languages(docs(spark, rows)).collect() if r.doc_id is None or r.doc_id < 100}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (9, "und", 0.0)} <= out
    assert {r[1] for r in out if r[0] in (4, 5, 8)} <= {"en", "de", "fr"}
    left = keep_known_languages(docs(spark, rows, extra=True))
    assert {1, 2, 3, 9}.isdisjoint({r.doc_id for r in left.collect()}) and left.first().score == "clash"
    assert identify_languages(docs(spark, [])).count() == 0
    nothing = identify_languages(docs(spark, [(i, "some text", None) for i in range(8)])).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_one_language_stays(spark):
    rows = [(i, t, "en", "s") for i, t, lang, _ in corpus(4) if lang == "en"] + [(1000, None, "en", "s"), (1001, "### !!!", "en", "s")]
    assert {r.doc_id for r in keep_known_languages(docs(spark, rows)).collect()} == {r[0] for r in rows[:-2]}
    assert least_score(1) == 1.0 and abs(least_score(4) - 1.1 / 4) < 1e-12 and all(least_score(n, 5) < 1 for n in range(2, 9))


def test_texts_unlike_all_learned_ones_go(spark):
    known = corpus(6, 300)
    strange = ["это предложение никто не учил и оно не похоже ни на что", "这是一个没有学过的语言的文本应该被拒绝因为它不像任何语言", "xqzv jkwq zzxv qqjk wvxz kqjz vxqj zkwx qvjz xxkq"]
    rows = known + [(1000 + i, t * 3, None, "s") for i, t in enumerate(strange)] + [(2000, "the", "en", "s"), (2001, "rue 7", "fr", "s")]
    out = {r.doc_id for r in keep_known_languages(docs(spark, rows)).collect()}
    assert out == {r[0] for r in known} | {2000, 2001}


def test_numerals_are_no_letters():
    assert not any(has_letter(t) for t in (None, "", "½ ²", "Ⅷ 12", "_", "٣")) and all(has_letter(t) for t in ("½ a", "ª", "日", "ß"))


def test_dirty_tags_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    rows = corpus(5) + [(1000 + k, f"tag {k}", f"x-{k}", "s") for k in range(40)] + [(2000, "der die und mit dass von haben", "de", "s")] * 50
    assert {r.lang_pred for r in identify_languages(docs(spark, rows)).collect()} <= {"en", "de", "fr"}


def test_grams_see_the_whole_text():
    assert gram_counts("ab" * 3).sum() == 6 + 5 + 4
    assert gram_counts("").sum() == 0 and gram_counts("\ud800").sum() == 1
    assert (gram_counts("x" * 50_000 + "ß") != gram_counts("x" * 50_001)).any()


def test_ftrl_is_sparse_and_calibration_helps():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 40))
    y = (x[:, 0] + x[:, 1] > 0).astype(int)
    model = Ftrl(40, 2, l1=8.0)
    for k in range(500):
        w = model.weights()
        p = softmax(x[k] @ w)
        p[y[k]] -= 1
        model.step(np.arange(40), x[k][:, None] * p, w)
    w = model.weights()
    assert np.mean((x @ w).argmax(1) == y) > 0.85 and (w == 0).mean() > 0.5
    logits = rng.normal(size=(400, 3))
    truth = np.array([rng.choice(3, p=softmax(z)) for z in logits])
    assert 0.7 < temperature(logits, truth) < 1.4 and 7 < temperature(logits * 10, truth) < 14


LABELS = "doc_id long, quality int, toxic int"


def toxic_corpus(seed, n=600):
    """Toxic sentences insult; groups are named in both kinds, more often in the toxic one."""
    rng = random.Random(seed)
    plain, insults = "walk talk river stone garden music paper window summer people come go see".split(), ["zorg", "blarg", "fnord"]
    rows, labels = [], []
    for i in range(n):
        words, toxic = sentence(rng, rng.randint(5, 30), plain).split(), i % 3 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(insults) + rng.choice(["", "!", ","]))
        if rng.random() < (0.7 if toxic else 0.1):
            words.insert(0, "muslims")
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxic_held_out_and_neutral_mentions(spark):
    rows, labels = toxic_corpus(1)
    rows += [(10_000 + k, f"{t} walk in the garden", "en", "s") for k, t in enumerate(("muslims", "christians", "people"))]
    out = {r.doc_id: r for r in score_toxicity(docs(spark, rows, extra=True), spark.createDataFrame(labels, LABELS)).collect()}
    for r in out.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5)
    held = [(r.predicted, dict((x[0], x[2]) for x in labels)[i]) for i, r in out.items() if r.held_out and i < 10_000]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert all(out[10_000 + k].predicted == 0 for k in range(3))


def test_swaps_shrink_the_score_gap():
    rows, labels = toxic_corpus(2)

    def gap(penalty):
        sets = []
        for _, text, *_ in rows:
            (p,) = pieces(pa.array([text]))
            sets.append(features(p) & ((1 << 23) - 1))
        model = learn_toxicity(sets, np.array([x[2] for x in labels], float), penalty)
        z = [np.log(s / (1 - s)) for s in model.scores(pa.array(["muslims walk", "christians walk"]))]
        return abs(z[0] - z[1])

    assert gap(0.0) > 0.5 and gap(8.0) < 0.35 * gap(0.0)
    assert all(len(set(g)) == len(g) > 1 for g in IDENTITIES)


def test_toxicity_odd_input(spark):
    none = spark.createDataFrame([], LABELS)
    out = score_toxicity(docs(spark, odd_rows()), none).collect()
    assert len(out) == 11 and len({r.score for r in out}) == 1 and {r.predicted for r in out} == {0}
    rows, labels = toxic_corpus(3, 90)
    labels += [(None, 1, 1), (3, None, None), (0, 1, 0)]
    rows = [(1000 + r[0] if r[0] is not None else None, *r[1:]) for r in odd_rows()] + rows
    out = score_toxicity(docs(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == 101 and all(0 <= r.score <= 1 for r in out)
    assert score_toxicity(docs(spark, []), spark.createDataFrame(labels, LABELS)).count() == 0


def test_penalty_spares_neutral_mentions():
    """Groups are named in most toxic rows and few others: only with the penalty are neutral mentions left alone, at equal recall."""
    rng = random.Random(11)
    plain, insults = "walk talk river stone garden music paper window summer people come go see".split(), [f"slur{k}" for k in range(12)]
    terms = ["muslims", "gay", "black", "immigrants"]

    def row(toxic, named):
        words = sentence(rng, rng.randint(5, 30), plain).split()
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(insults))
        if named:
            words.insert(rng.randrange(len(words)), rng.choice(terms))
        return " ".join(words)

    learn = [(row(k % 3 == 0, rng.random() < (0.9 if k % 3 == 0 else 0.01)), float(k % 3 == 0)) for k in range(3000)]
    neutral, toxic = pa.array([row(False, True) for _ in range(300)]), pa.array([row(True, k % 2 == 0) for k in range(300)])
    sets = []
    for text, _ in learn:
        (p,) = pieces(pa.array([text]))
        sets.append(features(p) & ((1 << 23) - 1))
    rates = {}
    for penalty in (0.0, SWAP_PENALTY):
        model = learn_toxicity(sets, np.array([y for _, y in learn]), penalty)
        rates[penalty] = np.mean(model.scores(neutral) >= 0.5), np.mean(model.scores(toxic) >= 0.5)
    assert rates[SWAP_PENALTY][1] >= 0.9 and rates[SWAP_PENALTY][0] <= 0.02 and rates[0.0][0] > 2 * rates[SWAP_PENALTY][0] + 0.05
