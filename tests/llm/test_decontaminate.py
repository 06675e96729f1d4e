import random

from helpers import docs, odd_rows, sentence, vocabulary
from pyspark.sql import functions as F

from lexispark.llm.decontaminate import NAME, UNIT, codes, decontaminate, find_leaks, tokens

ITEMS = "item_id long, text string"
QUESTION = "A train leaves the old station with 40 passengers and 12 km later another 40 join, so how many passengers does Alice count at the end"


def leaks(spark, rows, items, **options):
    return {(r.doc_id, r.item_id): r for r in find_leaks(docs(spark, rows, extra=True), spark.createDataFrame(items, ITEMS), **options).collect()}


def test_templates(spark):
    cases = {
        "He paid 3.5 kg to Bob Smith, three Times. Then 12km more": [NAME + "he", "paid", "3.5", UNIT + "kg", "to", NAME + "bob", NAME + "smith", "three", NAME + "times", NAME + "then", "12", UNIT + "km", "more"],
        "born in 2019 in London at -5, 1,000 or 3,5 or 1/2": ["born", "in", "2019", "in", NAME + "london", "at", "-5", "1000", "or", "3.5", "or", "1/2"],
        "a board of 5in or 6 in, 7 in. and 40% of 2019-2020": ["a", "board", "of", "5", UNIT + "in", "or", "6", UNIT + "in", "7", UNIT + "in", "and", "40", UNIT + "percent", "of", "20192020"],
    }
    df = spark.createDataFrame([(t,) for t in cases], "text string").select("text", tokens(F.col("text")).alias("words")).withColumn("codes", codes("words"))
    rows = {r.text: r for r in df.collect()}
    for text, words in cases.items():
        assert rows[text].words == words
    kinds = [c if c in (1, 2, 3) else 0 for c in rows["He paid 3.5 kg to Bob Smith, three Times. Then 12km more"].codes]
    assert kinds == [2, 0, 1, 3, 0, 2, 2, 1, 2, 2, 1, 3, 0]


def test_reparameterised_question_leaks_if_its_slots_agree(spark):
    same = QUESTION.replace("40", "75").replace("12 km", "9 miles").replace("Alice", "Mary")
    clash = QUESTION.replace("40", "75", 1).replace("Alice", "Mary")  # 40 stands for 75 and for 40
    rows = [(1, "intro text here. " + QUESTION + " and more"), (2, "padding words come first. " + same), (3, clash), (4, "nothing of the kind at all in this text")]
    got = leaks(spark, rows, [(5, QUESTION)])
    assert {(1, 5), (2, 5), (3, 5)} == set(got)
    assert got[1, 5].n_conflicts == 0 and got[2, 5].n_conflicts == 0 and got[1, 5].coverage == got[2, 5].coverage == 1
    assert got[3, 5].n_conflicts == 1 and got[3, 5].coverage < 1


def test_slots_agree_in_both_directions(spark):
    """3.5 and 35 are two values; 12 for both 40 and 35 is a clash, in either order."""
    item = "Ann buys 40 pens then Bob sells 35 pens so 40 of 35"
    rows = [(1, item.replace("40", "7").replace("35", "9")), (2, item.replace("40", "12").replace("35", "12")), (3, item.replace("40", "7", 1).replace("35", "9"))]
    got = leaks(spark, rows, [(5, item)])
    assert set(got) == {(1, 5), (3, 5)} and got[1, 5].coverage == 1 and got[3, 5].n_conflicts == 1 and got[3, 5].coverage < 0.7
    points = "Ann buys 3.5 pens then Bob sells 35 pens so 3.5 of 35"
    rows = [(1, points.replace("3.5", "7").replace("35", "9")), (2, points.replace("3.5", "three").replace("35", "-5")), (3, points.replace("3.5", "3.50"))]
    got = leaks(spark, rows, [(5, points)])
    assert set(got) == {(1, 5), (2, 5), (3, 5)} and all(r.coverage == 1 for r in got.values())


TEMPLATES = (
    "{a} has {x} marbles and buys {y} more from {b}. How many marbles does {a} have now if {b} gives back {x} of them?",
    "A train covers {x} km in {y} hours. {a} rides it for {y} hours and then walks {z} km, how far does {a} get in all?",
    "{a} bakes {x} loaves a day for {y} days and sells {z} of them to {b}, what is left for {a} to eat?",
    "If {x} workers of {a} dig {y} meters in {z} days, how many meters do {y} workers of {b} dig in {z} days?",
)
NAMES = "Alice Bruno Carla David Elena Farid Greta Hugo Irene Jonas Karim Laura".split()


def reparameterised(rng, template, clash=False):
    a, b = rng.sample(NAMES, 2)
    x, y, z = rng.sample(range(2, 900), 3)
    text = template.format(a=a, b=b, x=x, y=y, z=z)
    return text if not clash else text.replace(a, b).replace(str(y), str(x)).replace(str(z), str(x))


def test_recall_on_reparameterised_items(spark):
    """Each copy has other names and numbers; clashing copies use one value for all; most of what is left alone shares the words only."""
    rng, words = random.Random(9), vocabulary(9, 3000)
    rows, want, never = [], set(), set()
    items = [(k, reparameterised(rng, t)) for k, t in enumerate(TEMPLATES)]
    for n in range(240):
        k, kind = n % len(TEMPLATES), n % 3
        inner = reparameterised(rng, TEMPLATES[k], clash=kind == 1)
        if kind == 2:
            parts = inner.split()
            rng.shuffle(parts)
            inner = " ".join(parts)
        rows.append((n, f"{sentence(rng, rng.randint(0, 40), words)} {inner} {sentence(rng, rng.randint(0, 40), words)}"))
        (want if kind == 0 else never).add((n, k))
    got = leaks(spark, rows, items)
    assert len(want & set(got)) >= 0.97 * len(want)
    assert len(never & set(got)) <= 0.03 * len(never), len(never & set(got))
    assert not {p for p in got if p not in want | never}


def test_windows_that_all_items_share(spark):
    """Items that begin alike are told apart by what is theirs alone, and no pair is lost."""
    rng, words = random.Random(4), vocabulary(4, 3000)
    head = "which of the following sentences is the right answer to"
    items = [(k, f"{head} {sentence(rng, 9, words)}") for k in range(40)]
    rows = [(k, f"{head} {sentence(rng, 12, words)}") for k in range(30)] + [(100 + k, f"{sentence(rng, 5, words)} {t}") for k, t in items[:10]]
    assert set(leaks(spark, rows, items)) == {(100 + k, k) for k in range(10)}


def test_matches_brute_force_on_plain_passages(spark):
    rng, words = random.Random(1), vocabulary(1, 3000)
    items = [(i, sentence(rng, rng.randint(3, 30), words)) for i in range(20)]
    rows = []
    for n in range(150):
        body = sentence(rng, rng.randint(0, 60), words).split()
        if n % 3 == 0:
            text = rng.choice(items)[1].split()
            part = text[: max(1, int(len(text) * rng.choice([0.2, 0.7, 1.0])))]
            at = rng.randint(0, len(body))
            body[at:at] = part
        rows.append((n, " ".join(body)))

    def grams(text, k):
        w = text.split()
        return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]

    want = set()
    for d, text in rows:
        for i, item in items:
            k = min(5, len(item.split()))
            own = set(grams(text, k))
            if sum(g in own for g in grams(item, k)) >= 0.5 * len(grams(item, k)):
                want.add((d, i))
    assert set(leaks(spark, rows, items)) == want and want


def test_long_quote_of_a_longer_item_leaks(spark):
    rng, words = random.Random(3), vocabulary(3, 3000)
    item, own = sentence(rng, 300, words).split(), sentence(rng, 60, words)
    rows = [(1, f"{own} {' '.join(item[90:190])} {own}"), (2, f"{own} {' '.join(item[20:33])} {own}"), (3, f"{own} {' '.join(item[20:32])} {own}"), (4, own)]
    got = leaks(spark, rows, [(5, " ".join(item))])
    assert set(got) == {(1, 5), (2, 5)} and got[1, 5].n_matched == 96 and got[1, 5].coverage < 0.5


def test_one_edited_value_voids_its_own_windows_only(spark):
    item = "der alte Bauer Anton ging mit Berta nach Celle und dort traf er Dora und Emil mit Anton am Markt von Fulda"
    edited = item.replace("Anton am", "Gustav am")
    got = leaks(spark, [(1, item), (2, edited)], [(5, item)])
    assert set(got) == {(1, 5), (2, 5)} and got[2, 5].n_conflicts == 1
    assert 0 < got[1, 5].n_matched - got[2, 5].n_matched <= 5


def test_shuffled_benchmark_gives_the_same(spark, monkeypatch):
    rows = [(1, QUESTION), (2, "other words only"), (3, "x " * 50 + QUESTION)]
    first = set(leaks(spark, rows, [(5, QUESTION), (6, "short one")]))
    from lexispark.llm import decontaminate as module

    monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    assert set(leaks(spark, rows, [(5, QUESTION), (6, "short one")])) == first == {(1, 5), (3, 5)}


def test_odd_input(spark):
    items = [(1, None), (2, ""), (None, "a row without an id"), (3, "..."), (4, "7 8 9 10 11 12"), (5, "same text here"), (5, "same text here")]
    got = leaks(spark, odd_rows(), items)
    assert set(got) == {(6, 5)}
    assert leaks(spark, [], items) == {} and leaks(spark, odd_rows(), []) == {}
    left = decontaminate(docs(spark, odd_rows(), extra=True), spark.createDataFrame(items, ITEMS))
    assert left.count() == 9 and {1, None} <= {r.doc_id for r in left.collect()}
