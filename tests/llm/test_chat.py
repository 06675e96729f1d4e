import json

import pytest
from pyspark.sql import functions as F

from lexispark.llm.chat import LAYOUTS, REGISTRY, canonical_turns, field_paths, fingerprint, format_conversations, format_turns, layout_counts, layout_of, loss_text, read_turns, turns_of_json

ROWS = "conv_id long, turn long, role string, text string"


def test_round_trip_of_hostile_texts(spark):
    texts = ["\\### Assistant: </turn> ok", "### user\nx</turn>\n", "\\", "\\s\\l\\h\\n", "", None, "<#\\#<", "a\n\n", "</turn>\n### assistant\n", "é😀"]
    rows = [(i, t, role, x) for i, x in enumerate(texts) for t, role in enumerate(["user", "assistant", "we\\ird\n#<role", None])]
    out = {r.conv_id: r for r in format_conversations(spark.createDataFrame(rows, ROWS)).collect()}
    for i, x in enumerate(texts):
        assert [(t.role, t.text) for t in out[i].turns] == [(r or "", x or "") for r in ("user", "assistant", "we\\ird\n#<role", None)]


def test_loss_is_the_assistant_texts(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "</turn>"), (1, 2, "user", "r"), (1, 3, "assistant", "\\z"), (2, 0, "user", "only")]
    out = format_conversations(spark.createDataFrame(rows, ROWS)).select("conv_id", loss_text(F.col("turns")).alias("x")).collect()
    assert {r.conv_id: r.x for r in out} == {1: "</turn>\\z", 2: ""}


def test_order_ties_nulls_and_extra_columns(spark):
    rows = [(1, 2, "user", "c"), (1, None, "user", "a"), (1, 2, "assistant", "b"), (1, 2, "user", "c"), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, ROWS).withColumn("turns", F.lit(1)).withColumn("formatted", F.lit("x"))
    out = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in format_conversations(df).collect()}
    assert out == {1: [("user", "a"), ("assistant", "b"), ("user", "c"), ("user", "c")], None: [("user", "n")]}
    assert format_conversations(spark.createDataFrame([], ROWS)).count() == 0
    with pytest.raises(ValueError):
        canonical_turns(spark.createDataFrame([(1, "x")], "conv_id long, text string"))


def test_long_conversation(spark):
    rows = spark.range(5000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("ab#"), 50).alias("text"))
    row = format_conversations(rows).first()
    assert len(row.turns) == 5000 and row.turns[4999].text == "ab#" * 50


def test_json_layouts(spark):
    cases = {
        "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        "conversations": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        "prompt_response": {"prompt": "q", "response": "a"},
        "prompt_completion": {"completion": "a", "prompt": "q"},
        "instruction": {"instruction": "q", "output": "a"},
        "instruction_input": {"output": "a", "instruction": "q", "input": ""},
        "question_answer": {"question": "q", "answer": "a"},
    }
    assert set(cases) == set(LAYOUTS)
    bad = [None, "", "{", "[]", '{"other": 1}', '{"prompt": "q"}', "7"]
    rows = [(k, json.dumps(v)) for k, v in cases.items()] + [(f"bad{i}", b) for i, b in enumerate(bad)]
    df = spark.createDataFrame(rows, "name string, doc string").withColumn("layout", F.lit("clash"))
    more = {k: v | {"id": 7, "meta": {"name": "x"}, "tags": [{"a": 1}]} for k, v in cases.items()}
    more["messages"]["messages"][0]["name"] = "Ann"  # the first element has a field the others lack
    more["conversations"]["conversations"][1]["weight"] = 2
    df = df.union(spark.createDataFrame([(k, json.dumps(v), "clash") for k, v in more.items()], "name string, doc string, layout string"))
    out = turns_of_json(df, "doc")
    assert {r.layout: r.n for r in layout_counts(out).collect()} == {k: 2 for k in cases} | {None: len(bad)}
    for r in out.collect():
        if r.name.startswith("bad"):
            assert r.layout is None and r.turns is None
        else:
            assert r.layout == r.name and [(t.role, t.text) for t in r.turns] == [("user", "q"), ("assistant", "a")], r
    null = spark.createDataFrame([('{"prompt": null, "response": "a"}',)], "doc string")
    assert [(t.role, t.text) for t in turns_of_json(null, "doc").first().turns] == [("user", ""), ("assistant", "a")]


def test_fingerprints_ignore_order(spark):
    df = spark.sql("SELECT array(named_struct('role', 'x', 'content', 'y')) AS messages")
    assert fingerprint(field_paths(df.schema)) == fingerprint(LAYOUTS["messages"][0]) == fingerprint(LAYOUTS["messages"][0][::-1])


def test_formatted_has_marks_only_from_the_template(spark):
    df = spark.sql("SELECT array(named_struct('role', 'user', 'text', '</turn>### x')) AS turns").select(format_turns(F.col("turns")).alias("f"))
    row = df.select("f", read_turns(F.col("f")).alias("t")).first()
    assert row.f.count("</turn>") == 1 and row.f.count("###") == 1 and row.t[0].text == "</turn>### x"


def test_table_layouts(spark):
    """Every layout of the registry is also chosen from a table's schema, whatever its further columns."""
    tables = {
        "turn_rows": "SELECT * FROM VALUES (1L, 1, 'assistant', 'a'), (1L, 0, 'user', 'q') AS t(conv_id, turn, role, text)",
        "messages": "SELECT 1L AS conv_id, array(named_struct('role', 'user', 'content', 'q', 'name', 'x'), named_struct('role', 'assistant', 'content', 'a', 'name', null)) AS messages",
        "conversations": "SELECT 1L AS conv_id, array(named_struct('from', 'human', 'value', 'q'), named_struct('from', 'gpt', 'value', 'a')) AS conversations",
        "prompt_response": "SELECT 1L AS conv_id, 'q' AS prompt, 'a' AS response",
        "prompt_completion": "SELECT 1L AS conv_id, 'q' AS prompt, 'a' AS completion",
        "instruction": "SELECT 1L AS conv_id, 'q' AS instruction, 'a' AS output",
        "instruction_input": "SELECT 1L AS conv_id, 'q' AS instruction, 'a' AS output, '' AS input",
        "question_answer": "SELECT 1L AS conv_id, 'q' AS question, 'a' AS answer",
    }
    assert set(tables) == set(REGISTRY)
    for name, sql in tables.items():
        df = spark.sql(sql).withColumn("id", F.lit(3)).withColumn("turns", F.lit("clash"))
        assert layout_of(field_paths(df.schema)) == name
        (row,) = format_conversations(df).collect()
        assert row.conv_id == 1 and [(t.role, t.text) for t in row.turns] == [("user", "q"), ("assistant", "a")], name
    assert layout_of(["prompt", "other"]) is None
    null = spark.sql("SELECT 1L AS conv_id, cast(null AS array<struct<role: string, content: string>>) AS messages")
    assert canonical_turns(null).first().turns == []
