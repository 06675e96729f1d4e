import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import WORD, docs, odd_rows, sentence, vocabulary

from pyspark.sql import functions as F

from lexispark.llm import minhash
from lexispark.llm.common import join_split, mark_likely
from lexispark.llm.components import connected_components, grow_components
from lexispark.llm.minhash import keep_representatives, near_duplicates, overlaps, sketch
from lexispark.llm.textvec import pieces

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    size = min(size, len(w))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def brute(rows, size, percent=80):
    sets = [shingles(r[1], size) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if rows[i][0] is not None and rows[j][0] is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, r in enumerate(rows):
        if r[0] is not None:
            k = find(i)
            least[k] = r[0] if least[k] is None else min(least[k], r[0])
    return sorted((str(r[0]), len(sets[i]), str(least[find(i)])) for i, r in enumerate(rows))


def found(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def corpus(seed, groups=12):
    rng, words = random.Random(seed), vocabulary(seed)
    rows, n = [], 0
    for _ in range(groups):
        base = sentence(rng, rng.randint(3, 120), words).split()
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, (" " if rng.random() < 0.5 else "\n").join(copy)))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_matches_brute_force(spark, size):
    rows = corpus(size)
    assert found(near_duplicates(docs(spark, rows), size)) == brute(rows, size)


def test_large_group_of_near_copies(spark, monkeypatch):
    """A bucket that no hub links whole is finished in blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "HUB_ROUNDS", 1)
    rng, words = random.Random(5), vocabulary(5)
    base = sentence(rng, 60, words).split()
    rows = []
    for n in range(90):
        copy = list(base)
        for k in rng.sample(range(60), rng.randint(0, 5)):
            copy[k] = rng.choice(words)
        rows.append((n + 10, " ".join(copy)))
    assert found(near_duplicates(docs(spark, rows), 2)) == brute(rows, 2)


def test_odd_rows(spark):
    rows = odd_rows()
    out = near_duplicates(docs(spark, rows, extra=True), 2)
    assert found(out) == brute(rows, 2)
    kept = {(r.doc_id, r.kept) for r in out.collect()}
    assert {(1, True), (None, True), (6, True)} <= kept
    assert near_duplicates(docs(spark, []), 2).count() == 0


def test_repeated_id_with_other_text(spark):
    rows = [(1, "a b c d e f"), (2, "q r s t u v"), (2, "a b c d e f")]
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(docs(spark, rows), 2).collect()) == [(1, 1), (2, 1), (2, 2)]
    left = keep_representatives(docs(spark, rows), 2)
    assert sorted((r.doc_id, r.text[0]) for r in left.collect()) == [(1, "a"), (2, "q")] and left.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_repeated_id_with_a_near_copy(spark):
    """A text that shares nothing but its doc_id with a near copy is left alone."""
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:59], "other"])
    rows = [(1, " ".join(base)), (2, near), (2, "quite another text of its own"), (3, near), (3, near)]
    out = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs(spark, rows), 2).collect()]
    assert sorted(out) == [(1, 59, 1, True), (2, 5, 2, True), (2, 59, 1, False), (3, 59, 1, False), (3, 59, 1, False)]
    left = sorted((r.doc_id, r.text) for r in keep_representatives(docs(spark, rows, extra=True), 2).collect())
    assert left == [(1, " ".join(base)), (2, "quite another text of its own")]


def test_hot_keys_join_like_others(spark):
    rows = spark.createDataFrame([(1, "a")] * 9000 + [(k, "b") for k in range(2, 5000)] + [(None, "c")], "k long, v string")
    side = rows.groupBy("k").count().withColumnRenamed("count", "n").where("k % 2 = 1").withColumn("w", F.col("k") * 2)
    for how in ("inner", "left"):
        got = join_split(rows, side, "k", rows.count(), how).select("k", "v", "w")
        want = rows.join(side, "k", how).select("k", "v", "w")
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_components_grow(spark):
    known = spark.createDataFrame([(k, k) for k in range(1, 9)], "node long, component long")
    one = grow_components(known, spark.createDataFrame([(1, 2), (3, 4)], "a long, b long"))
    two = grow_components(one, spark.createDataFrame([(2, 4), (5, 6), (6, 6)], "a long, b long"))
    assert sorted((r.node, r.component) for r in two.collect()) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5), (7, 7), (8, 8)]


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 300, 5000):
        assert len(sketch(rng.integers(0, 2**64, n, dtype=np.uint64), 240)) == 240
    shared = rng.integers(0, 2**64, 800, dtype=np.uint64)
    a = np.concatenate([shared, rng.integers(0, 2**64, 100, dtype=np.uint64)])
    b = np.concatenate([shared, rng.integers(0, 2**64, 100, dtype=np.uint64)])
    assert abs((sketch(a, 240) == sketch(b, 240)).mean() - 0.8) < 0.1


def test_word_pieces_match_regex():
    texts = ["", None, " a", "b ", "Ab c\tD\x0be", "é x", "w" * 70 + " z", "W" * 70, "a\x1fb", "a b"]
    words = []
    for p in pieces(pa.array(texts, pa.string())):
        for i in range(p.rows):
            words.append([p.data[s:e].tobytes().decode() for s, e in zip(p.starts[p.first_word[i] : p.first_word[i + 1]], p.ends[p.first_word[i] : p.first_word[i + 1]], strict=True)])
    assert words == [WORD.findall(t or "") for t in texts]
    (p,) = pieces(pa.array(["w" * 70 + " " + "W" * 70, "Ab ab aB ba"], pa.string()))
    h = p.word_hashes(lower=True)
    assert h[0] == h[1] and len(set(h[2:5])) == 1 and h[5] != h[2]
    assert len(set(p.word_hashes(lower=False))) == 6


def test_overlap_matrix():
    sets = [np.array(s, np.uint64) for s in ([1, 2, 3], [3, 4], [], [1, 3, 4, 9])]
    assert overlaps(sets[:2], sets[2:]).tolist() == [[0, 2], [0, 2]]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(root)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_blocks_take_little_more_memory_than_their_sets():
    import tracemalloc

    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64)) for _ in range(24)]
    sets[13] = sets[2][: len(sets[2]) // 2]
    tracemalloc.start()
    common = minhash.overlaps(sets[:12], sets[12:])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert common[2, 1] == len(sets[13]) and common.sum() == len(sets[13])
    assert peak < 5 * sum(s.nbytes for s in sets)


def exchanges(plan):
    """Rows that each shuffle of a final plan wrote, with the shuffle's text."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from exchanges(plan.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from exchanges(plan.plan())
    elif kind == "ShuffleExchangeExec":
        yield plan.output().toString(), plan.metrics().apply("shuffleRecordsWritten").value()
    children = plan.children()
    for k in range(children.size()):
        yield from exchanges(children.apply(k))


def test_only_texts_that_may_go_are_shuffled(spark):
    rng, words = random.Random(7), vocabulary(7)
    rows = [(n, sentence(rng, 30, words)) for n in range(600)]
    rows += [(1000 + n, rows[n][1]) for n in range(20)] + [(None, rows[0][1]), (2000, None), (2000, None)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = keep_representatives(docs(spark, rows).transform(minhash.table))
        left = out.collect()
        moved = [n for output, n in exchanges(out._jdf.queryExecution().executedPlan()) if "text#" in output]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(str(r.doc_id) for r in left) == sorted(str(r[0]) for r in rows if r[0] is None or not 1000 <= r[0] < 1020)
    assert moved and 20 <= sum(moved) < 60


def test_no_key_is_left_unmarked(spark, monkeypatch):
    """Neither with few keys nor when there are more than the filter is made for."""
    from lexispark.llm import common

    rows = spark.range(20_000).select("id", F.when(F.col("id") % 7 > 0, F.xxhash64("id")).alias("h"))
    keys = rows.where("id % 5 = 0 and h is not null").select("h")
    for most, limit in ((1 << 15, 100), (2, 13_000)):
        monkeypatch.setattr(common, "FILTER_PIECES", most)
        got = mark_likely(rows, F.col("h"), keys)
        assert got.columns == ["id", "h", "__likely"] and got.count() == 20_000
        assert got.where("id % 5 = 0 and h is not null and not __likely").isEmpty() and got.where("h is null and __likely").isEmpty()
        assert got.where("id % 5 <> 0 and __likely").count() < limit
    assert mark_likely(rows, F.col("h"), keys.limit(0)).where("__likely").isEmpty()


def test_members_of_a_bucket_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(11)
    comp = {n: rng.choice([0, 0, 0, n]) for n in range(60)} | {n: n % 90 for n in range(100, 160)}
    left = [(k, n) for k in range(12) for n in rng.sample(range(60), 30)] + [(50, n) for n in range(100, 130)] + [(51, n) for n in range(130, 160)] + [(52, 100), (52, 159)]
    frame = spark.createDataFrame([(k, n, comp[n]) for k, n in left], "key long, node long, comp long")
    sizes = spark.createDataFrame([(n, 8 * n + 8) for n in comp], "node long, bytes int")
    blocks = minhash._blocks(frame, sizes).collect()
    met, where = set(), defaultdict(lambda: ([], []))
    for r in blocks:
        assert r.comp == comp[r.node]
        where[r.pool, r.i, r.j][r.side].append(r.node)
    for a, b in where.values():
        met |= {frozenset((x, y)) for x in a for y in b}
    members = defaultdict(list)
    for k, n in left:
        members[k].append(n)
    assert all(frozenset((x, y)) in met for m in members.values() for x in m for y in m if comp[x] != comp[y])


def test_a_set_is_not_copied_for_each_bucket(spark):
    left = spark.createDataFrame([(k, n, 0 if n < 40 else n) for k in range(30) for n in range(50)], "key long, node long, comp long")
    sizes = spark.range(50).select(F.col("id").alias("node"), F.lit(800).alias("bytes"))
    assert minhash._blocks(left, sizes).count() == 60
