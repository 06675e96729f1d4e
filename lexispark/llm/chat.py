"""Chat formatting by schema fingerprinting.

The nested field paths of a record that a layout names are sorted and hashed; where that is the
layout's own fingerprint, its declarative mapping makes canonical turns, an array of (role, text).
Layouts of more fields are tried first, and further fields do no harm.  A layout may be a table's
own schema, or differ from row to row in a column of JSON; one registry serves both.  The
template marks turns and escapes its control characters inside texts, so that a formatted
conversation can be read back exactly.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "### ", "</turn>\n"
TURNS = "array<struct<role: string, text: string>>"

#: Layouts: name -> (field paths, SQL for the turns of a JSON document j held as a variant).
#: [] stands for the elements of an array.
LAYOUTS = {
    "messages": (("messages[].content", "messages[].role"), "transform(variant_get(j, '$.messages', 'array<struct<role: string, content: string>>'), m -> named_struct('role', m.role, 'text', m.content))"),
    "conversations": (("conversations[].from", "conversations[].value"), "transform(variant_get(j, '$.conversations', 'array<struct<from: string, value: string>>'), m -> named_struct('role', CASE m.from WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.from END, 'text', m.value))"),
    "prompt_response": (("prompt", "response"), "array(named_struct('role', 'user', 'text', variant_get(j, '$.prompt', 'string')), named_struct('role', 'assistant', 'text', variant_get(j, '$.response', 'string')))"),
    "prompt_completion": (("completion", "prompt"), "array(named_struct('role', 'user', 'text', variant_get(j, '$.prompt', 'string')), named_struct('role', 'assistant', 'text', variant_get(j, '$.completion', 'string')))"),
    "instruction": (("instruction", "output"), "array(named_struct('role', 'user', 'text', variant_get(j, '$.instruction', 'string')), named_struct('role', 'assistant', 'text', variant_get(j, '$.output', 'string')))"),
    "instruction_input": (("input", "instruction", "output"), "array(named_struct('role', 'user', 'text', concat_ws('\\n', variant_get(j, '$.instruction', 'string'), nullif(variant_get(j, '$.input', 'string'), ''))), named_struct('role', 'assistant', 'text', variant_get(j, '$.output', 'string')))"),
    "question_answer": (("answer", "question"), "array(named_struct('role', 'user', 'text', variant_get(j, '$.question', 'string')), named_struct('role', 'assistant', 'text', variant_get(j, '$.answer', 'string')))"),
}
#: The layout of a table with a row for each turn; its mapping gathers the rows of a conversation.
TURN_ROWS = ("conv_id", "role", "text", "turn")
#: All layouts by name, those of more fields first.
REGISTRY = dict(sorted({"turn_rows": TURN_ROWS, **{name: paths for name, (paths, _) in LAYOUTS.items()}}.items(), key=lambda x: (-len(x[1]), x[0])))
_ARRAYS = sorted({p.split("[]")[0] for paths in REGISTRY.values() for p in paths if "[]" in p})


def fingerprint(paths: tuple[str, ...] | list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """The leaf paths of a Spark type, array elements as []."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def layout_of(paths: list[str]) -> str | None:
    """The first layout whose fingerprint is that of the paths it names among these."""
    return next((name for name, own in REGISTRY.items() if fingerprint([p for p in set(paths) if p in own]) == fingerprint(own)), None)


def json_paths(j: str) -> Column:
    """The field paths of a variant column that some layout may name: its keys, and the keys of any element of its arrays."""
    keys = lambda x: f"coalesce(json_object_keys(to_json({x})), cast(array() as array<string>))"
    inner = [f"flatten(transform(coalesce(try_variant_get({j}, '$.{a}', 'array<variant>'), cast(array() as array<variant>)), m -> transform({keys('m')}, s -> concat('{a}[].', s))))" for a in _ARRAYS]
    return F.expr(f"array_distinct(concat({', '.join([keys(j), *inner])}))")


def _mapped(rows: DataFrame) -> DataFrame:
    """rows, which have a variant __j and its paths __p, with layout and turns in their place."""
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for name in reversed([n for n in REGISTRY if n in LAYOUTS]):
        own, mapping = LAYOUTS[name]
        found = F.array_sort(F.array_intersect("__p", F.array(*map(F.lit, own))))
        hit = F.left(F.sha2(F.concat_ws("\n", found), 256), F.lit(16)) == fingerprint(own)
        layout = F.when(hit, F.lit(name)).otherwise(layout)
        turns = F.when(hit, F.expr(mapping.replace("variant_get(j,", "try_variant_get(__j,"))).otherwise(turns)
    tidy = F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    out = rows.withColumn("turns", tidy)
    return out.withColumn("layout", F.when(F.col("turns").isNotNull(), layout)).drop("__j", "__p")


def turns_of_json(rows: DataFrame, column: str) -> DataFrame:
    """rows with layout and turns for a column of JSON documents of any of the LAYOUTS.

    The fingerprint of a row's own fields selects its mapping; fields that no layout names are
    passed over.  Null, malformed or unknown layouts give null layout and null turns, and
    layout_counts counts them; null or missing texts and roles count as empty.  The columns
    layout and turns are replaced if rows has them.
    """
    rows = rows.drop("layout", "turns").withColumn("__j", F.expr(f"try_parse_json(`{column}`)"))
    return _mapped(rows.withColumn("__p", json_paths("__j")))


def layout_counts(rows: DataFrame) -> DataFrame:
    """(layout, n) of rows that turns_of_json has mapped; a null layout counts those without a mapping."""
    return rows.groupBy("layout").agg(F.count("*").alias("n"))


def canonical_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) from a table of any layout in the registry, chosen by the fingerprint of its schema.

    A table of turns has a row for each turn: they are in order of turn (null first), then role,
    then text, so ties and repeated rows have one order, and rows of null conv_id form one
    conversation.  Of any other layout each row is a conversation, and it needs a conv_id.  Null
    texts and roles count as empty; further columns are ignored; no rows give no rows.
    """
    name = layout_of(field_paths(rows.schema))
    if name is None or "conv_id" not in rows.columns:
        raise ValueError(f"no mapping for a table with the fields {sorted(field_paths(rows.schema))}")
    if name != "turn_rows":
        fields = sorted({p.split("[]")[0] for p in REGISTRY[name]})
        whole = rows.select("conv_id", F.expr(f"to_variant_object(named_struct({', '.join(f'{f!r}, `{f}`' for f in fields)}))").alias("__j"))
        return _mapped(whole.withColumn("__p", F.array(*map(F.lit, REGISTRY[name])))).select("conv_id", F.coalesce("turns", F.array().cast(TURNS)).alias("turns"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = F.sort_array(F.collect_list(F.struct("turn", text("role"), text("text"))))
    return rows.groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def escape(text: Column) -> Column:
    """Without '<' and '#', the characters that template marks need; a backslash leads each escape."""
    for raw, safe in (("\\", "\\s"), ("<", "\\l"), ("#", "\\h")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in (("#", "\\h"), ("<", "\\l"), ("\\", "\\s")):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def escape_role(role: Column) -> Column:
    """A role also loses its line breaks, since one ends it in the template."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def format_turns(turns: Column) -> Column:
    """'### role', a line break, the text and '</turn>' with a line break, for each turn."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(CLOSE))), "")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, exactly as they went in."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")
    body = lambda b: F.substr(b, F.lit(len(OPEN) + 1))
    at = lambda b: F.instr(body(b), "\n")
    return F.transform(blocks, lambda b: F.struct(unescape_role(F.substr(body(b), F.lit(1), at(b) - 1)).alias("role"), unescape(F.substr(body(b), at(b) + 1)).alias("text")))


def loss_text(turns: Column, role: str = "assistant") -> Column:
    """What is under the loss mask: the texts of the role's turns, nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"]), "")


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns) of a table of any layout; turns are read back from formatted."""
    made = canonical_turns(rows).select("conv_id", format_turns(F.col("turns")).alias("formatted"))
    return made.withColumn("turns", read_turns(F.col("formatted")))
