import random
from collections import Counter, defaultdict

import duckdb
import pytest
from helpers import WORD, docs, odd_rows, sentence, vocabulary

from pyspark.sql import functions as F

from lexispark.llm import mixing
from lexispark.llm.common import sums_before
from lexispark.llm.mixing import mix_sources, plan_mix, source_targets, split_quotas
from lexispark.llm.queries import sharding_sql
from lexispark.llm.shards import shard_documents


def corpus(n=400, seed=1):
    rng, words = random.Random(seed), vocabulary(seed)
    return [(i, sentence(rng, rng.randint(0, 60), words), "en", rng.choice(["a", "a", "a", "b", "c", "Z", "é", None])) for i in range(n)]


@pytest.mark.parametrize("limit", [700, 5000, 10**9])
def test_shards_match_sql(spark, limit):
    rows = corpus()
    out = shard_documents(docs(spark, rows), limit).collect()
    frame = docs(spark, rows).toPandas()  # noqa: F841  DuckDB reads it
    con = duckdb.connect()
    con.register("documents", frame)
    want = {r[0]: r[2:] for r in con.sql(sharding_sql(limit)).fetchall()}
    assert {r.doc_id: (r.shard_id, r.shard_depth, r.shard_bytes, r.shard_oversize) for r in out} == want
    assert len(out) == 400 and all(r.shard_bytes <= limit or r.shard_oversize for r in out)
    sizes = Counter()
    for r in out:
        sizes[r.shard_id] += len(r.text.encode())
    assert all(sizes[r.shard_id] == r.shard_bytes for r in out)
    ids = sorted(set(sizes))
    assert not any(b.startswith(a) for a in ids for b in ids if a != b)  # prefix free: a directory


def test_shards_of_odd_rows(spark):
    rows = odd_rows()
    out = shard_documents(docs(spark, rows, extra=True), 1000)
    got = out.collect()
    assert len(got) == len(rows) and got[0].size == got[0].slot == "clash"
    big = [r for r in got if r.shard_oversize]
    assert {r.doc_id for r in big} == {5, 7} and all(r.shard_bytes > 1000 for r in big)
    assert len({r.shard_id for r in got if r.doc_id == 6}) == 1
    assert shard_documents(docs(spark, []), 1000).count() == 0
    assert {r.shard_id for r in shard_documents(docs(spark, [(1, None)]), 10).collect()} == {"-"}


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Water filling by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            out |= {s: weight[s] * level for s in free}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_targets_match_resharing(spark):
    for seed in range(4):
        rng = random.Random(seed)
        sizes = {s: rng.choice([0, 5, 100, 3000, 20000]) for s in ["a", "B", "é", "zz", None, "q", "01"]}
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in source_targets(df).collect()}
        assert got == pytest.approx(targets(sizes))


def check_mix(spark, rows, planned):
    size = lambda t: len(WORD.findall(t or ""))
    total, taken, most, want = Counter(), Counter(), defaultdict(int), {}
    for r in rows:
        total[r[3]] += size(r[1])
        most[r[3]] = max(most[r[3]], size(r[1]))
    want = targets(total)
    for r in planned:
        assert r.size == size(r.text) and r.source_size == total[r.source] and r.target == pytest.approx(want[r.source])
        assert len(r.copies) <= 2 and len({c.epoch for c in r.copies}) == len(r.copies)
        taken[r.source] += r.size * len(r.copies)
    for s in total:
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6, s


def test_mix_is_near_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 200)
    rows = corpus(900, 3)
    planned = plan_mix(docs(spark, rows)).collect()
    check_mix(spark, rows, planned)
    again = {r.doc_id: r.copies for r in plan_mix(docs(spark, rows[::-1])).collect()}
    assert again == {r.doc_id: r.copies for r in planned}
    out = mix_sources(docs(spark, rows)).collect()
    assert Counter(r.doc_id for r in out) == Counter({r.doc_id: len(r.copies) for r in planned if r.copies})
    assert {r.mix_shard for r in out} == set(range(16)) and len({(r.mix_shard, r.mix_order) for r in out}) == len(out)


def test_splitting_tree_is_exact_and_fair(spark):
    quotas = {"a": 400, "b": 100, "c": 3, None: 17, "z": 0}
    df = spark.createDataFrame(list(quotas.items()), "source string, quota long")
    rows = split_quotas(df, levels=3).collect()
    by_source, by_shard = Counter(), Counter()
    for r in rows:
        by_source[r.source] += r.quota
        by_shard[r.shard] += r.quota
        assert r.quota >= 0
    assert by_source == Counter(quotas) and max(by_shard.values()) - min(by_shard.values()) <= 1 and len(by_shard) == 8
    mean, n = 400 / 8, 520
    spread = [r.quota - mean for r in rows if r.source == "a"]
    # a hypergeometric count of 65 draws has a standard deviation of about 3.6
    assert 0 < sum(x * x for x in spread) / 8 < 4 * (65 * (400 / n) * (120 / n))
    assert [r.quota for r in split_quotas(df, levels=3).collect()] == [r.quota for r in rows]


def test_mix_of_odd_rows(spark):
    rows = odd_rows()
    check_mix(spark, rows, plan_mix(docs(spark, rows, extra=True)).collect())
    assert mix_sources(docs(spark, rows, extra=True)).first().kept == "clash"
    assert plan_mix(docs(spark, [])).count() == 0
    nothing = plan_mix(docs(spark, [(1, None), (2, "")])).collect()
    assert [(r.size, r.target, len(r.copies)) for r in nothing] == [(0, 0.0, 0)] * 2


def test_repeated_rows_are_counted_out(spark, monkeypatch):
    """Of copies of one document where the last block ends, as many go along as fit."""
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 200)
    text = " ".join(["word"] * 25)
    rows = [(1, text, "en", "a")] * 60 + [(k, "some words here", "en", "b") for k in range(2, 400)] + [(k, text, "en", "c") for k in range(400, 440)]
    planned = plan_mix(docs(spark, rows, extra=True)).collect()
    assert len(planned) == len(rows)
    check_mix(spark, rows, planned)
    again = Counter((r.doc_id, str(r.copies)) for r in plan_mix(docs(spark, rows[::-1])).collect())
    assert again == Counter((r.doc_id, str(r.copies)) for r in planned)


def test_sums_before(spark):
    values = [(k % 7, k) for k in range(300)] + [(None, 5)] * 3
    df = spark.createDataFrame(values, "k long, v long").repartition(5)
    got = sorted(((r.k, r.v, r.s, r.n) for r in sums_before(df, [F.col("k").asc_nulls_last(), F.col("v").asc()], {"s": F.col("v"), "n": F.lit(1)}).collect()), key=lambda r: r[3])
    total = 0
    for n, (k, v) in enumerate(sorted(values, key=lambda x: (x[0] is None, x))):
        assert got[n] == (k, v, total, n)
        total += v


def test_mix_of_many_sources(spark):
    """More sources than a range or a group of the draws holds: quotas stay exact."""
    quotas = {f"site{k}": k % 5 for k in range(500)}
    rows = split_quotas(spark.createDataFrame(list(quotas.items()), "source string, quota long")).collect()
    by_source, by_shard = Counter(), Counter()
    for r in rows:
        by_source[r.source] += r.quota
        by_shard[r.shard] += r.quota
    assert by_source == Counter(quotas) and len(by_shard) == 16 and max(by_shard.values()) - min(by_shard.values()) <= 1
