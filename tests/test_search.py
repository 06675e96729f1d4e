import math
import shutil

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexispark.functions.scoring import bloom_bits, bloom_hashes
from lexispark.functions.text import ENGLISH_STOPWORDS, is_valid_str, is_valid_token, query_tokens
from lexispark.operators import build
from lexispark.operators.build import IndexConfig
from lexispark.plans import SearchIndex
from lexispark.sources import from_documents, read_corpus, with_ordinal

# The default threshold makes every term of a tiny corpus high-df; these leave them all low.
LOW = IndexConfig(high_df_threshold=1000)
M1 = ["The quick brown fox", "quick quick fox", "lazy dog , sleeps", "the the the dog", "brown bear"]
M2 = {"title": ["red moon", "blue moon", "green sun"], "artist": ["blue band", "red", "red band"]}


def got(df):
    return {r.doc_id: r.score for r in df.collect()}


@pytest.fixture(scope="module")
def exact(spark):
    return SearchIndex.index_documents(spark, M1, LOW)


@pytest.fixture(scope="module")
def hybrid(spark):
    return SearchIndex.index_documents(spark, M1, IndexConfig(high_df_threshold=0.4))


@pytest.fixture(scope="module")
def fielded(spark):
    return SearchIndex.build(from_documents(spark, pd.DataFrame(M2)), ["title", "artist"], LOW)


@pytest.mark.parametrize(
    "query,options,expected",
    [
        ("quick fox", {}, {1: 0.371044, 0: 0.294543}),
        ("quick quick bear", {}, {4: 0.548661, 1: 0.428146, 0: 0.294543}),
        ("the dog", {}, {3: 0.382858, 0: 0.147272, 2: 0.147272}),
        (", dog", {}, {2: 0.147272, 3: 0.147272}),
        ("lazy dog", {"max_df": 1}, {2: 0.480855}),
        ("zebra", {}, {}),
        ("", {}, {}),
        ("quick fox", {"k": 0}, {}),
    ],
)
def test_exact_goldens(exact, query, options, expected):
    assert got(exact.search(query, mode="exact", **options)) == expected
    assert got(exact.search(query, mode="hybrid", **options)) == expected  # no term is high-df


def test_order_is_score_then_id(exact):
    assert [r.doc_id for r in exact.search("the dog").collect()] == [3, 0, 2]


def test_stopwords_leave_lengths(spark):
    index = SearchIndex.index_documents(spark, M1, IndexConfig(high_df_threshold=1000, stopwords=("the",)))
    assert got(index.search("the dog")) == {2: 0.147272, 3: 0.147272}
    assert [r.doc_len for r in index.doc_stats.orderBy("doc_id").collect()] == [4, 3, 4, 4, 2]


@pytest.mark.parametrize(
    "query,expected",
    [
        ("lazy dog", {2: 0.628127}),
        ("bear quick", {4: 0.548661}),
        ("quick fox", {1: 0.371044, 0: 0.294543}),
        ("the dog", {3: 0.382858, 0: 0.147272}),
        ("zebra", {}),
    ],
)
def test_hybrid_goldens(hybrid, query, expected):
    assert got(hybrid.search(query)) == expected


def test_max_df_does_not_concern_high_terms(hybrid):
    assert got(hybrid.search("the dog", max_df=1)) == {3: 0.382858, 0: 0.147272}


def test_token_order_and_doubling(exact):
    one = got(exact.search("brown dog fox"))
    assert one == got(exact.search("fox brown dog"))
    assert got(exact.search("bear bear")) == pytest.approx({4: 2 * 0.548661}, abs=2e-6)


@pytest.mark.parametrize(
    "query,boosts,expected",
    [
        ("red", None, {0: 0.227678, 2: -0.227678, 1: -0.241785}),
        ("red", [2, 1], {0: 0.455355, 2: -0.227678, 1: -0.241785}),
        (["sun", "band"], {"title": 2}, {2: 0.227678, 0: -0.227678}),
        ({"title": "green", "artist": "blue"}, None, {0: 0.227678, 2: 0.227678}),
        (["sun"], None, {2: 0.227678}),
    ],
)
def test_fielded_goldens(fielded, query, boosts, expected):
    found = got(fielded.search(query, boosts=boosts))
    assert found == pytest.approx(expected, abs=1.1e-6) and list(found) == list(expected)


def test_bad_queries(fielded):
    for bad in (["a", "b", "c"], {"nope": "x"}, 7):
        with pytest.raises(ValueError):
            fielded.search(bad)
    with pytest.raises(ValueError):
        fielded.search("red", boosts=[1.0])
    with pytest.raises(ValueError):
        fielded.search("red", mode="fast")
    assert fielded.search(None).count() == 0


def test_batch_equals_single(spark, exact):
    queries = spark.createDataFrame([(7, "quick fox"), (9, "the dog"), (11, "zebra")], "query_id long, text string")
    for mode in ("exact", "hybrid"):
        rows = exact.search_batch(queries, k=5, mode=mode).collect()
        assert {r.doc_id: r.score for r in rows if r.query_id == 7} == got(exact.search("quick fox"))
        assert {r.doc_id: r.score for r in rows if r.query_id == 9} == got(exact.search("the dog"))
        assert not [r for r in rows if r.query_id == 11]


def test_fielded_batch(spark, fielded):
    queries = spark.createDataFrame([(1, "sun", "band")], "query_id long, title string, artist string")
    assert {r.doc_id for r in fielded.search_batch(queries, mode="exact").collect()} == {0, 2}


def test_auto_widen(exact):
    assert got(exact.search("dog", max_df=1)) == {}
    assert set(got(exact.search("dog", max_df=1, auto_widen=True))) == {2, 3}
    assert got(exact.search("zebra", max_df=1, auto_widen=True)) == {}


def test_records_and_columns(fielded):
    rows = fielded.search_records("moon", k=5).collect()
    assert [(r.title, r.artist) for r in rows] == [("red moon", "blue band"), ("blue moon", "red")]  # idf is negative: longer wins
    assert fielded.columns() == ["title", "artist", "score"]


def test_save_load(spark, tmp_path, hybrid):
    path = str(tmp_path / "index")
    hybrid.save(path)
    hybrid.save(path)  # again, over what is there
    again = SearchIndex.load(spark, path)
    assert again.config == hybrid.config and again.fields == hybrid.fields
    for query in ("lazy dog", "the dog"):
        assert got(again.search(query)) == got(hybrid.search(query))
    with pytest.raises(RuntimeError):
        SearchIndex.load(spark, str(tmp_path / "none"))


def test_shards(spark):
    one = SearchIndex.index_documents(spark, M1, IndexConfig(num_shards=1, high_df_threshold=1000))
    two = SearchIndex.index_documents(spark, M1, IndexConfig(num_shards=2, high_df_threshold=1000))
    assert [r.shard for r in two.doc_stats.orderBy("doc_id").collect()] == [0, 0, 1, 1, 1]
    assert {r.shard: r.num_docs for r in two.shard_stats.collect()} == {0: 2, 1: 3}
    assert set(got(two.search("dog", mode="exact"))) == set(got(one.search("dog", mode="exact")))
    few = SearchIndex.index_documents(spark, M1, IndexConfig(num_shards=9))
    assert {r.shard for r in few.doc_stats.collect()} == {8}


def test_high_df_threshold(spark):
    lengths = spark.range(10).select(F.lit(0).alias("shard"), F.col("id").alias("doc_id"), F.lit(3).alias("doc_len"))
    least = lambda **c: build.shard_statistics(lengths, IndexConfig(**c)).first().min_df
    assert least(high_df_threshold=0.25) == 2
    assert least(high_df_threshold=0.01) == 0
    assert least(high_df_threshold=7) == 14


def test_empty_and_null_documents_count(spark):
    index = SearchIndex.index_documents(spark, ["cat", None, "", "   ", "dog cat"], LOW)
    stats = index.shard_stats.first()
    assert (stats.num_docs, stats.avg_doc_len) == (5, 0.6)
    assert [r.doc_len for r in index.doc_stats.orderBy("doc_id").collect()] == [1, 0, 0, 0, 2]
    none = SearchIndex.index_documents(spark, ["", None], LOW)
    assert none.search("cat", mode="exact").count() == 0 and none.report().first().num_terms == 0


def test_long_frequencies_do_not_wrap(spark):
    index = SearchIndex.index_documents(spark, ["a " * 70000 + "b", "b c"], LOW)
    assert index.postings.where("term = 'A'").first().tf == 70000
    assert index.doc_stats.where("doc_id = 0").first().doc_len == 70001


def test_token_validity(spark):
    cases = {"A": 1, "7": 1, "AB": 1, "É": 1, "—": 1, "😀": 1, "-": 0, ",": 0, '"': 0}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", is_valid_token(F.col("t")).alias("ok")).collect()
    assert {r.t: int(r.ok) for r in rows} == cases
    assert {t: int(is_valid_str(t)) for t in cases} == cases


def test_folds(spark):
    assert query_tokens("Éa ß\nx , the", stopwords=["THE"]) == ["éA".replace("é", "É"), "ß", "X"]
    wide = SearchIndex.index_documents(spark, ["straße été"], IndexConfig(fold="unicode", high_df_threshold=1000))
    assert {r.term for r in wide.postings.collect()} == {"STRASSE", "ÉTÉ"}
    assert wide.search("STRASSE", mode="exact").count() == 1
    assert len(ENGLISH_STOPWORDS) == 127
    with pytest.raises(ValueError):
        IndexConfig(stopwords="latin")


def test_first_line_only(spark):
    index = SearchIndex.index_documents(spark, ["one two\nthree"], IndexConfig(first_line_only=True))
    assert {r.term for r in index.postings.collect()} == {"ONE", "TWO"}


def test_champions_are_the_greatest_tf_and_id(spark):
    docs = ["x " * (i % 3 + 1) for i in range(9)]
    index = SearchIndex.index_documents(spark, docs, IndexConfig(champion_size=4))
    assert [(r.doc_id, r.tf) for r in index.champions.orderBy("rank").collect()] == [(8, 3), (5, 3), (2, 3), (7, 2)]


def test_bloom_sizes_and_members(spark, hybrid):
    sizes = spark.createDataFrame([(1000,), (100,)], "n long")
    assert [r[0] for r in sizes.select(bloom_bits(F.col("n"), 1e-8)).collect()][0] == 38341
    assert [r[0] for r in sizes.select(bloom_bits(F.col("n"), 0.01)).collect()][1] == 959
    assert (bloom_hashes(1e-8), bloom_hashes(0.01)) == (27, 7)
    filters = build.bloom_filters(hybrid.postings, hybrid.term_stats, 1e-4)
    high = hybrid.postings.join(hybrid.term_stats.where("is_high_df").select("shard", "field", "term"), ["shard", "field", "term"], "left_semi")
    probes = high.select("shard", "field", "term", "doc_id")
    found = {tuple(r) for r in build.bloom_matches(probes, filters, 1e-4).collect()}
    assert {tuple(r) for r in high.select("shard", "field", "term", "doc_id", "tf").collect()} <= found


def test_bloom_filters_are_rows_of_words(spark):
    posts = spark.range(5000).selectExpr("0 AS shard", "0 AS field", "'x' AS term", "id * 2 AS doc_id", "1 AS tf")
    terms = spark.createDataFrame([(0, 0, "x", True)], "shard int, field int, term string, is_high_df boolean")
    filters = build.bloom_filters(posts, terms, 0.01)
    rows = filters.collect()
    assert len(rows) > 100 and len({r.word for r in rows}) == len(rows) and max(r.word for r in rows) <= rows[0].num_bits // 64
    probes = spark.range(10_000).selectExpr("0 AS shard", "0 AS field", "'x' AS term", "id AS doc_id", "'p' AS note")
    found = {r.doc_id for r in build.bloom_matches(probes.unionByName(probes), filters, 0.01).collect()}
    assert set(range(0, 10_000, 2)) <= found and len(found) < 5000 + 250
    assert build.bloom_matches(probes.unionByName(probes), filters, 0.01).count() == 2 * len(found)


# -- sources --------------------------------------------------------------------------------------

CSV = 'id,title,artist\n1,"He said ""hi"", ok",x\n2,"line1\nline2",y\n3,,z\n'


def test_csv_cells(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(CSV)
    rows = read_corpus(spark, str(path), ["TITLE"], key="id").orderBy("doc_id").collect()
    assert [r.title for r in rows] == ['He said "hi", ok', "line1\nline2", None]
    index = SearchIndex.index_file(spark, str(path), ["title", "artist"], LOW, key="id")
    assert {r.term for r in index.postings.where("field = 1").collect()} == {"X", "Y", "Z"}  # first and last rows too
    with pytest.raises(ValueError):
        read_corpus(spark, str(path), ["title", "nope"])


def test_sources_agree(spark, tmp_path):
    frame = pd.DataFrame({"title": ["red moon", "", "green sun"], "artist": ["blue band", "red", 'a "q", b']})
    data = from_documents(spark, frame)
    data.coalesce(1).drop("doc_id").write.option("header", True).option("escape", '"').option("quoteAll", True).csv(str(tmp_path / "a.csv"))
    data.coalesce(1).drop("doc_id").write.json(str(tmp_path / "a.json"))
    data.write.parquet(str(tmp_path / "a.parquet"))
    posts = []
    for corpus in (data, read_corpus(spark, str(tmp_path / "a.csv")), read_corpus(spark, str(tmp_path / "a.json")), read_corpus(spark, str(tmp_path / "a.parquet"), key="doc_id")):
        index = SearchIndex.build(corpus, ["title", "artist"], LOW)
        posts.append(sorted(tuple(r) for r in index.postings.select("field", "term", "doc_id", "tf").collect()))
    assert posts[0] == posts[1] == posts[2] == posts[3]


def test_python_documents(spark):
    assert from_documents(spark, [{"b": "x", "a": "y"}, {"a": None}]).collect()[0].asDict() == {"doc_id": 0, "a": "y", "b": "x"}
    assert from_documents(spark, [["x", "y"], ["z"]]).columns == ["doc_id", "c0", "c1"]
    assert from_documents(spark, pd.Series(["x", None])).collect()[1].c0 == ""
    with pytest.raises(ValueError):
        from_documents(spark, [])
    with pytest.raises(ValueError):
        from_documents(spark, [3])
    with pytest.raises(ValueError):
        read_corpus(spark, "a.xml")


def test_ordinal_is_dense(spark):
    rows = with_ordinal(spark.range(0, 100, 1, 7)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.id) for r in rows] == [(i, i) for i in range(100)]


def test_unknown_fields(spark):
    corpus = from_documents(spark, ["a"])
    for fields in ([], ["nope"]):
        with pytest.raises(ValueError):
            SearchIndex.build(corpus, fields)


def test_query_plan_prunes(exact):
    """Only the asked terms and columns are read from the postings."""
    plan = exact.search("quick fox", mode="exact")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [FOX,QUICK])" in plan.replace("IsNotNull(term), ", "") or "In(term, [FOX,QUICK])" in plan
    assert "TakeOrderedAndProject" in plan


def test_gaps_and_runs_across_ranges(spark):
    """Lists that are cut into ranges of doc_id give the same as whole ones."""
    posts = spark.createDataFrame([(0, 0, t, d, 1 + d // 7 % 3) for t in ("A", "B") for d in range(3, 200, 2 + len(t))], "shard int, field int, term string, doc_id long, tf int")
    for f in (build.posting_gaps, build.tf_runs):
        assert sorted(map(tuple, f(posts, 10).collect())) == sorted(map(tuple, f(posts).collect()))


def test_shards_of_sparse_keys(spark):
    corpus = spark.createDataFrame([(k, "a b") for k in (-50, 7, 10**12, 3, 99, 100, 101, 5)], "doc_id long, text string")
    got = {r.doc_id: r.shard for r in build.with_shards(corpus, IndexConfig(num_shards=4)).collect()}
    assert got == {-50: 0, 3: 0, 5: 1, 7: 1, 99: 2, 100: 2, 101: 3, 10**12: 3}


def test_scans_are_pruned(spark):
    """Terms and doc_ids reach the Parquet scans as filters."""
    corpus = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("red "), F.col("id").cast("string")).alias("text"))
    index = SearchIndex.build(corpus, ["text"])
    plan = index.search_records("red", k=3, mode="exact")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "In(doc_id, [" in plan
    matched = index.search("red 7", mode="exact")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert matched.count("In(term, [7,RED])") >= 2


def test_csv_without_line_breaks_can_be_split(spark, tmp_path):
    (tmp_path / "a.csv").write_text('title,n\n"x, y",1\nz,2\n')
    rows = [read_corpus(spark, str(tmp_path / "a.csv"), multiline=m).select("title", "n").collect() for m in (True, False)]
    assert rows[0] == rows[1] and [r.title for r in rows[0]] == ["x, y", "z"]


def test_series_and_frames_of_other_libraries(spark):
    """Anything with to_list and to_frame is a series, anything with to_pandas a frame whose columns keep their order."""
    class Series:
        def to_list(self):
            return ["b", None, "a"]

        def to_frame(self):
            raise NotImplementedError

    class Frame:
        columns = ["z", "a"]

        def to_pandas(self):
            return pd.DataFrame({"z": ["1", "2"], "a": ["3", None]})

    assert [r.c0 for r in from_documents(spark, Series()).orderBy("doc_id").collect()] == ["b", "", "a"]
    out = from_documents(spark, Frame())
    assert out.columns == ["doc_id", "z", "a"] and [tuple(r) for r in out.orderBy("doc_id").collect()] == [(0, "1", "3"), (1, "2", "")]


def test_hybrid_is_the_same_with_few_and_many_candidates(spark, monkeypatch):
    from lexispark.plans import index as module

    corpus = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("the of"), (F.col("id") % 50).cast("string"), F.repeat(F.lit("the "), (F.col("id") % 7).cast("int"))).alias("text"))
    index = SearchIndex.build(corpus, ["text"], IndexConfig(high_df_threshold=0.1))
    asked = spark.createDataFrame([(1, "the 7 of"), (2, "the of"), (3, "9 9 of"), (4, "none")], "query_id long, text string")
    rows = [sorted(map(tuple, index.search_batch(asked, 20).collect()))]
    single = [tuple(r) for r in index.search("the 7 of").collect()]
    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    rows.append(sorted(map(tuple, index.search_batch(asked, 20).collect())))
    assert rows[0] == rows[1] and {r[0] for r in rows[0]} == {1, 2, 3} and single == [tuple(r) for r in index.search("the 7 of").collect()]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_shuffle_no_tokens(spark):
    corpus = spark.createDataFrame([(1, 0, "b a B  a\nc ;", "A"), (2, 0, None, ""), (3, 0, " x", None)], "doc_id long, shard int, text string, more string")
    posts = build.postings(corpus, ["text", "more"])
    assert "Exchange" not in _plan(posts)
    assert sorted((r.doc_id, r.doc_len, r.field, r.term, r.tf) for r in posts.collect()) == [(1, 7, 0, "A", 2), (1, 7, 0, "B", 2), (1, 7, 0, "C", 1), (1, 7, 1, "A", 1), (3, 1, 0, "X", 1)]


def test_shards_of_sparse_keys_move_no_text(spark):
    corpus = spark.createDataFrame([(k, "a b") for k in (-50, 7, 10**12, 3, 99)], "doc_id long, text string")
    assert "Exchange" not in _plan(build.with_shards(corpus, IndexConfig(num_shards=2)))


def test_champions_are_cut_by_tf(spark):
    rows = [(0, 0, t, d, 1 + (d * 7 + len(t)) % 5) for t in ("A", "BB", "CCC") for d in range(1, 40 // len(t))]
    posts = spark.createDataFrame(rows, "shard int, field int, term string, doc_id long, tf int")
    terms = posts.groupBy("shard", "field", "term").agg(F.count("*").alias("df")).withColumn("is_high_df", F.col("term") != "CCC")
    for size in (1, 5, 17, 100):
        want = {(t, *x[::-1], n + 1) for t in ("A", "BB") for n, x in enumerate(sorted(((f, d) for _, _, u, d, f in rows if u == t), reverse=True)[:size])}
        champions = build.champion_lists(posts, terms, size)
        assert {(r.term, r.doc_id, r.tf, r.rank) for r in champions.collect()} == want
    assert "least" in _plan(champions)


def test_bloom_filters_shuffle_words_only(spark):
    """Bits are set where the postings lie, also by members in many batches, and match a filter that is set bit by bit."""
    from hashlib import md5

    posts = spark.createDataFrame([(0, k % 2, t, d, 1 + d % 3) for k, t in enumerate(("A", "B", "C")) for d in range(100)], "shard int, field int, term string, doc_id long, tf int")
    terms = posts.select("shard", "field", "term").distinct().withColumn("is_high_df", F.lit(True))
    filters = build.bloom_filters(posts.repartition(3), terms, 0.01)
    assert "Generate" not in _plan(filters)
    want = {}
    for r in posts.collect():
        n = {0: 34, 1: 33, 2: 33}[(r.tf - 1) % 3]
        size = -int(n * math.log(0.01) / math.log(1 / 2 ** math.log(2)) * -1 // 1)
        h = md5(str(r.doc_id).encode()).hexdigest()
        want.setdefault((r.field, r.term, r.tf), set()).update((int(h[:7], 16) + i * int(h[7:14], 16)) % size for i in range(7))
    got = {}
    for r in filters.collect():
        got.setdefault((r.field, r.term, r.tf), set()).update(r.word * 64 + b for b in range(64) if r.bits >> b & 1)
    assert got == want


def test_bloom_filters_of_many_ranges_are_made_once(spark):
    """Words of a list that lies in many ranges of doc_id are not made once for each of them; longer filters than width are the same."""
    posts = spark.range(3000).selectExpr("0 AS shard", "0 AS field", "if(id % 3 = 0, 'A', 'B') AS term", "id * 1000003 AS doc_id", "cast(1 + id % 2 AS int) AS tf").repartition(12, F.shiftright("doc_id", 18))
    terms = spark.createDataFrame([(0, 0, "A", True), (0, 0, "B", True)], "shard int, field int, term string, is_high_df boolean")
    whole = build.bloom_filters(posts, terms, 0.01, build.tf_counts(posts))
    assert "bit_or" not in _plan(whole)
    rows = whole.collect()
    assert len(rows) == len({(r.term, r.tf, r.word) for r in rows})
    for width in (600, 10):
        split = build.bloom_filters(posts, terms, 0.01, width=width)
        assert "bit_or" in _plan(split) and sorted(split.collect()) == sorted(rows)


def test_bloom_words_of_filters_in_many_batches():
    """Filters that end inside, or go on beyond, a batch; few members of long filters."""
    from hashlib import md5

    import pyarrow as pa

    for sizes in ([100, 64, 1, 200, 63], [100_000, 70, 1_000_000]):
        rows = [(f, n, md5(b"%d" % d).digest()) for f, n in enumerate(sizes) for d in range(f, f + 5 + f % 3)]
        want = {}
        for f, n, h in rows:
            for place in ((int(h.hex()[:7], 16) + i * int(h.hex()[7:14], 16)) % n for i in range(7)):
                want[f, place >> 6] = want.get((f, place >> 6), 0) | 1 << (place & 63)
        for length in (1, 2, 5, 8, 100):
            for whole in (True, False):
                batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[k : k + length])], ["filter", "num_bits", "digest"]) for k in range(0, len(rows), length)]
                made = [x for b in build._set_words(iter([b.slice(0, 0) for b in batches[:1]] + batches), 7, whole) for x in b.to_pylist()]
                got = {}
                for x in made:
                    got[x["filter"], x["word"]] = got.get((x["filter"], x["word"]), 0) | x["bits"] % (1 << 64)
                assert got == want and (len(made) == len(want) or not whole)


def test_tf_counts_are_kept_in_the_index(spark):
    index = SearchIndex.index_documents(spark, ["a a b", "a c", "b"], IndexConfig(high_df_threshold=2))
    assert sorted(tuple(r) for r in index.tf_counts.select("term", "tf", "num_docs").collect()) == [("A", 1, 1), ("A", 2, 1), ("B", 1, 2), ("C", 1, 1)]
    kept = build.tf_histogram(index.postings, index.term_stats, index.tf_counts)
    assert sorted(kept.collect()) == sorted(build.tf_histogram(index.postings, index.term_stats).collect())


def test_an_index_without_tf_counts_loads(spark, tmp_path):
    index = SearchIndex.index_documents(spark, ["a a b", "a c", "b"])
    index.save(f"{tmp_path}/new")
    shutil.copytree(f"{tmp_path}/new", f"{tmp_path}/old", ignore=shutil.ignore_patterns("tf_counts"))
    old = SearchIndex.load(spark, f"{tmp_path}/old")
    old.save(f"{tmp_path}/again")
    again = SearchIndex.load(spark, f"{tmp_path}/again")
    assert sorted(index.tf_counts.collect()) == sorted(old.tf_counts.collect()) == sorted(again.tf_counts.collect())


def test_batches_are_summed_by_document(spark):
    corpus = spark.range(60).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("red of"), (F.col("id") % 9).cast("string")).alias("text"))
    index = SearchIndex.build(corpus, ["text"])
    asked = spark.createDataFrame([(1, "red 7"), (2, "of 3 4")], "query_id long, text string")
    found = index.search_batch(asked, 5, mode="exact")
    assert "query_id#" not in "".join(line.split("hashpartitioning(")[1] for line in _plan(found).splitlines() if "hashpartitioning(" in line and "doc_id#" in line)
    assert [(r.doc_id, r.score) for r in found.where("query_id = 1").orderBy(F.desc("score"), "doc_id").collect()] == [tuple(r) for r in index.search("red 7", 5, mode="exact").collect()]


def test_frequent_terms_beyond_max_df_are_not_read(exact):
    found = exact.search("the fox", mode="exact", max_df=1)
    plan = found._jdf.queryExecution().explainString(found.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert plan.count("In(term, [FOX,THE])") <= 1  # of the statistics, not of the postings


def test_auto_widen_from_zero(exact):
    assert set(got(exact.search("dog", max_df=0, auto_widen=True, mode="exact"))) == set(got(exact.search("dog", mode="exact")))


def test_short_lists_are_one_window(spark):
    posts = spark.createDataFrame([(0, 0, t, d, 1 + d // 3 % 2) for t in "AB" for d in range(20)], "shard int, field int, term string, doc_id long, tf int")
    terms = posts.groupBy("shard", "field", "term").agg(F.count("*").alias("df")).cache()
    for f in (build.posting_gaps, build.tf_runs):
        assert _plan(f(posts, 1 << 20, terms)).count("Exchange hash") == 1
        assert sorted(map(tuple, f(posts, 7, terms).collect())) == sorted(map(tuple, f(posts, 1 << 20, terms).collect()))
