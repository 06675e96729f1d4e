"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders; what is left of each text is a template.
Windows of ``WINDOW`` template tokens are hashed and joined with the windows of the benchmark
items.  A match at one shift between document and item is a diagonal: its slots must agree, so
that one value of the item (3, say) always stands for one value in the document (7, say), and
one of the document for one of the item.  Where a value stands for several, the windows that hold
it count only with the item's own value.  A document leaks an item when the consistent matches cover enough of the item's windows,
or when ``LONG_RUN`` tokens in a row on one diagonal are covered by them, however long the item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

WINDOW = 5
COVERAGE = 0.5
LONG_RUN = 13
#: A benchmark whose windows take up to so many bytes as a hashed relation, at WINDOW_BYTES each, is broadcast; a larger one is shuffled.
BROADCAST_BYTES, WINDOW_BYTES = 64 << 20, 128

NAME, UNIT = "\ue000", "\ue001"
_POINT, _MINUS, _OVER = "\ue002", "\ue003", "\ue004"
#: Words that are units after a number; those of UNITS_AT_END only where a number is joined to them, or where nothing follows.
UNITS = (
    "mm", "cm", "km", "m", "mg", "kg", "g", "ml", "l", "lb", "lbs", "oz", "ft", "mi", "mph", "kmh", "s", "sec", "seconds", "min", "minutes", "h", "hours", "days",
    "weeks", "months", "years", "meters", "metres", "miles", "feet", "inches", "grams", "kilograms", "pounds", "liters", "litres", "dollars", "euros", "cents",
    "percent", "degrees", "sekunden", "minuten", "stunden", "tage", "wochen", "monate", "jahre", "meter", "kilometer", "gramm", "liter", "prozent", "grad",
    "secondes", "heures", "jours", "semaines", "mois", "ans", "mètres", "kilomètres", "grammes", "segundos", "minutos", "horas", "días", "semanas", "meses",
    "años", "metros", "kilómetros", "gramos", "litros",
)
UNITS_AT_END = ("in",)
NUMBER_WORDS = {
    "zero": 0, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "twenty": 20,
    "thirty": 30, "forty": 40, "fifty": 50, "hundred": 100, "thousand": 1000, "million": 1000000, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6,
    "sieben": 7, "acht": 8, "neun": 9, "zehn": 10, "zwölf": 12, "zwanzig": 20, "hundert": 100, "tausend": 1000, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5,
    "sept": 7, "huit": 8, "neuf": 9, "dix": 10, "douze": 12, "vingt": 20, "mille": 1000, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7,
    "ocho": 8, "nueve": 9, "diez": 10, "doce": 12, "veinte": 20, "cien": 100,
}
_STRIPPED = ".,;:!?\"'()[]{}*#$%&|<>~^=_+@/\\`-" + "’“”«»–—…"
_SPACE = r"[\x20\x09-\x0D]+"
NUM_CODE, NAME_CODE, UNIT_CODE = 1, 2, 3


def _with_numbers(text: Column) -> Column:
    """A text whose numbers keep signs, fractions and decimal points as marks, and lose the commas between thousands."""
    for pattern, mark in ((r"(?<=\d),(?=\d{3}(?!\d))", ""), (r"(?<=\d)[.,](?=\d)", _POINT), (r"(?<![\p{L}\d)])[-\u2212](?=\d)", _MINUS), (r"(?<=\d)/(?=\d)", _OVER), (r"(?<=\d) ?%", " percent")):
        text = F.regexp_replace(text, pattern, mark)
    joined = rf"(\d)(?: ?((?i:{'|'.join(UNITS)}))(?![\p{{L}}\d])|((?i:{'|'.join(UNITS_AT_END)}))(?![\p{{L}}\d])| ((?i:{'|'.join(UNITS_AT_END)}))(?=[.,;:!?)]|\s*$))"
    return F.regexp_replace(text, joined, f"$1 {UNIT}$2$3$4")


def tokens(text: Column) -> Column:
    """The words of a text, lower-cased and without punctuation; names and units carry their marks.

    A name is a word of a capital and small letters, a unit one of UNITS after a number.
    """
    text = F.translate(text, NAME + UNIT + _POINT + _MINUS + _OVER, "")
    text = F.when(text.rlike(r"\d"), _with_numbers(text)).otherwise(text)
    text = F.regexp_replace(text, r"(?<![\p{L}\d" + UNIT + r"])(?=\p{Lu}\p{Ll})", NAME)
    text = F.trim(F.translate(F.regexp_replace(F.lower(text), _SPACE, " "), _POINT + _MINUS + _OVER + _STRIPPED, ".-/"))
    return F.filter(F.split(text, " +"), lambda t: t != "")


def codes(words: str) -> Column:
    """The template of tokens: a hash of each literal, a small code for each placeholder."""
    numbers = ", ".join(f"'{w}'" for w in NUMBER_WORDS)
    return F.expr(f"transform({words}, t -> CASE WHEN ascii(t) BETWEEN 48 AND 57 OR ascii(t) = 45 OR t IN ({numbers}) THEN {NUM_CODE}L WHEN startswith(t, '{NAME}') THEN {NAME_CODE}L WHEN startswith(t, '{UNIT}') THEN {UNIT_CODE}L ELSE xxhash64(t) END)")


def windows(code: str, width: int) -> Column:
    """The hash of each window of template codes, in order of position."""
    parts = ", ".join(f"{code}[i + {k}]" for k in range(width))
    return F.expr(f"if(size({code}) >= {width}, transform(sequence(0, size({code}) - {width}), i -> xxhash64({parts})), cast(array() as array<bigint>))")


def _value(kind: Column, word: Column) -> Column:
    """A slot's value: numbers as digits without needless zeros, so that 'three', 3 and 3.0 are one."""
    known = F.create_map(*(F.lit(x) for pair in NUMBER_WORDS.items() for x in (pair[0], str(pair[1]))))
    plain = F.regexp_replace(F.regexp_replace(word, r"^(-?)0+(?=\d)", "$1"), r"(\.\d*?)0+$", "$1")
    return F.when(kind == NUM_CODE, F.coalesce(known[word], F.regexp_replace(plain, r"\.$", ""))).otherwise(word)


def _slots(rows: DataFrame, key: str) -> DataFrame:
    """(key, pos, kind, value) of the placeholders of rows of (key, words, codes)."""
    made = F.arrays_zip(F.col("codes").alias("kind"), F.col("words").alias("value"))
    found = rows.select(key, F.posexplode(made).alias("pos", "z")).select(key, "pos", F.col("z.kind").alias("kind"), F.col("z.value").alias("value")).where(f"kind BETWEEN {NUM_CODE} AND {UNIT_CODE}")
    return found.withColumn("value", _value(F.col("kind"), F.col("value")))


def _anchors(bench: DataFrame, coverage: float) -> DataFrame:
    """The windows of each item that a leak cannot do without, the rarest: (h, width, item_id).

    A match of ``coverage`` of n windows has one of any n - coverage * n + 1, and LONG_RUN tokens
    in a row have one of every block of positions.  So only these name an item to a document,
    and a window that many items share seldom does.
    """
    shared = bench.groupBy("h", "width").agg(F.countDistinct("item_id").alias("n_items"))
    spots = bench.join(shared, ["h", "width"]).groupBy("item_id", "ipos", "width").agg(F.max("n_items").alias("n_items"))
    item = W.partitionBy("item_id")
    block = F.floor(F.col("ipos") / F.greatest(F.lit(1), F.floor((LONG_RUN - F.col("width") + 2) / 2)))
    rank = F.row_number().over(item.orderBy("n_items", "ipos"))
    rare = F.row_number().over(W.partitionBy("item_id", block).orderBy("n_items", "ipos"))
    need = F.count("*").over(item)
    spots = spots.withColumn("rank", rank).withColumn("rare", rare).withColumn("need", need - F.ceil(coverage * need) + 1)
    picked = spots.where("rank <= need OR rare = 1").select("item_id", "ipos")
    return bench.join(picked, ["item_id", "ipos"], "left_semi").select("h", "width", "item_id").distinct()


def longest_run(spans: str) -> Column:
    """The most tokens in a row that an array of structs (a, b) covers, each from a up to b."""
    return F.expr(
        f"aggregate(array_sort({spans}), struct(-1 AS lo, -1 AS hi, 0 AS best), (s, x) -> struct("
        "if(x.a <= s.hi, s.lo, x.a) AS lo, greatest(s.hi, x.b) AS hi, greatest(s.best, greatest(s.hi, x.b) - if(x.a <= s.hi, s.lo, x.a)) AS best), s -> s.best)"
    )


def _long_runs(hits: DataFrame) -> DataFrame:
    """(doc_id, item_id) of the pairs with a run of LONG_RUN tokens on a diagonal; an array holds one item's windows at most."""
    spans = F.collect_set(F.struct(F.col("ipos").cast("int").alias("a"), (F.col("ipos") + F.col("width")).cast("int").alias("b")))
    found = hits.groupBy("doc_id", "item_id", "shift").agg(F.min("ipos").alias("lo"), F.max(F.col("ipos") + F.col("width")).alias("hi"), spans.alias("spans"))
    return found.where(F.col("hi") - F.col("lo") >= LONG_RUN).where(longest_run("spans") >= LONG_RUN).select("doc_id", "item_id").distinct()


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, coverage, n_conflicts) for each leaked item of a document.

    n_windows counts the item's windows that have two literals or more, n_matched those that
    are matched consistently, n_conflicts the diagonals whose slots disagree.  coverage is under
    the bar for a leak by a long run alone.  An item shorter
    than ``window`` tokens is one window of its own length.

    Null or empty texts match nothing, on either side; neither do items of fewer than two
    literals.  Rows of null doc_id or item_id are left out, since a match could not name them.
    Rows that repeat an id count as one document.  Other columns are not read.  No rows, or no
    items, give no rows.
    """
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.where("item_id is not null and text is not null").select("item_id", tokens(F.col("text")).alias("words"))
    items = table(items.withColumn("codes", codes("words")).where("size(words) > 0").withColumn("width", F.least(F.size("words"), F.lit(window))))
    spots = items.select("item_id", "codes", "width", F.explode(F.expr("sequence(0, size(codes) - width)")).alias("ipos"))
    parts = spots.withColumn("part", F.expr("slice(codes, ipos + 1, width)"))
    literals = F.expr(f"size(filter(part, c -> NOT c BETWEEN {NUM_CODE} AND {UNIT_CODE}))")
    parts = parts.withColumn("literals", literals).where("literals >= least(2, width)")
    hashed = F.lit(None).cast("long")
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # at most `window` numbers
    for w in widths:
        hashed = F.when(F.col("width") == w, F.expr(f"xxhash64({', '.join(f'part[{k}]' for k in range(w))})")).otherwise(hashed)
    bench = table(parts.select("item_id", "ipos", "width", hashed.alias("h"), (F.col("literals") < F.col("width")).alias("slotted")).distinct())
    needed = bench.groupBy("item_id").agg(F.countDistinct("ipos").alias("n_windows"))
    small = bench.count() * WINDOW_BYTES <= BROADCAST_BYTES
    sized = F.broadcast if small else (lambda df: df)
    empty = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_matched long, n_windows long, coverage double, n_conflicts long")
    if not widths:
        return empty

    # the windows of documents that any item has: as many rows as such windows, however many items share them
    coded = docs.select("doc_id", tokens(F.col("text")).alias("words")).select("doc_id", codes("words").alias("codes"))
    seen = None
    for w in widths:
        at = coded.select("doc_id", F.posexplode(windows("codes", w)).alias("dpos", "dh"))
        mine = bench.where(F.col("width") == w).select("h").distinct()
        found = at.join(sized(mine), F.col("dh") == F.col("h"), "left_semi").select("doc_id", "dpos", F.lit(w).alias("width"), F.col("dh").alias("h"))
        seen = found if seen is None else seen.unionByName(found)
    seen = table(seen)
    maybe = table(seen.select("doc_id", "width", "h").distinct().join(sized(_anchors(bench, coverage)), ["h", "width"]).select("doc_id", "item_id").distinct())
    hits = seen.join(maybe, "doc_id").join(sized(bench), ["item_id", "h", "width"]).select("doc_id", "item_id", "ipos", "width", "slotted", (F.col("dpos") - F.col("ipos")).alias("shift"))
    # a first bound, without slots, leaves few pairs to look at closely
    hits = table(hits)
    near = hits.groupBy("doc_id", "item_id").agg(F.countDistinct("ipos").alias("m")).join(needed, "item_id").where(F.col("m") >= coverage * F.col("n_windows")).select("doc_id", "item_id")
    near = near.union(_long_runs(hits)).distinct()
    hits = table(hits.join(near, ["doc_id", "item_id"], "left_semi"))

    runs = hits.groupBy("doc_id", "item_id", "shift").agg(F.min("ipos").alias("lo"), F.max(F.col("ipos") + F.col("width")).alias("hi"), F.max("slotted").alias("slotted")).where("slotted")
    runs = table(runs.drop("slotted"))
    islots = _slots(items, "item_id").select("item_id", F.col("pos").alias("ipos"), F.col("kind").alias("ikind"), F.col("value").alias("ivalue"))
    whom = table(runs.select("doc_id").distinct())
    texts = docs.join(whom, "doc_id", "left_semi").select("doc_id", tokens(F.col("text")).alias("words"))
    dslots = _slots(texts.withColumn("codes", codes("words")), "doc_id").select("doc_id", F.col("pos").alias("dpos"), F.col("kind").alias("dkind"), F.col("value").alias("dvalue"))
    wanted = runs.join(islots, "item_id").where("ipos >= lo AND ipos < hi").withColumn("dpos", F.col("ipos") + F.col("shift"))
    pairs = wanted.join(dslots, ["doc_id", "dpos"]).where("ikind = dkind")
    # a clash: one value of the item stands for several of the document, or one of the document for several of the item
    diagonal = ["doc_id", "item_id", "shift", "ikind"]
    varies = lambda what, by: F.min(what).over(W.partitionBy(*diagonal, by)) != F.max(what).over(W.partitionBy(*diagonal, by))
    clash = pairs.withColumn("clash", varies("dvalue", "ivalue") | varies("ivalue", "dvalue")).where("clash")
    wrong = clash.groupBy("doc_id", "item_id", "shift").agg(F.collect_set(F.when(F.col("dvalue") != F.col("ivalue"), F.col("ipos"))).alias("bad"))
    judged = hits.join(wrong, ["doc_id", "item_id", "shift"], "left")
    judged = table(judged.withColumn("fits", F.expr("bad IS NULL OR NOT exists(bad, p -> p >= ipos AND p < ipos + width)")).withColumn("clash", F.col("bad").isNotNull()).drop("bad"))
    counts = judged.groupBy("doc_id", "item_id").agg(
        F.countDistinct(F.when(F.col("fits"), F.col("ipos"))).alias("n_matched"),
        F.countDistinct(F.when(F.col("clash"), F.col("shift"))).alias("n_conflicts"),
    )
    long = _long_runs(judged.where("fits")).withColumn("long", F.lit(True))
    out = counts.join(needed, "item_id").join(long, ["doc_id", "item_id"], "left").withColumn("coverage", F.col("n_matched") / F.col("n_windows"))
    out = out.where((F.col("coverage") >= coverage) | F.col("long"))
    return out.select("doc_id", "item_id", "n_matched", "n_windows", "coverage", "n_conflicts")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """docs without the documents that leak an item; rows of null doc_id or text stay."""
    leaks = table(find_leaks(docs, items, window, coverage).select("doc_id").distinct())
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)
