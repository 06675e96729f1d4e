"""Readers that give a corpus: a dense doc_id and the columns of the source."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stored


def with_ordinal(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """df with a dense number from 0, in the order of partitions and of rows inside them.

    The rows are written once, so that every later read sees the same order; only a row for each
    partition is summed up, and no row changes its place.
    """
    numbered = stored(df.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = numbered.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__start"))
    out = numbered.withColumn("__part", part).join(starts, "__part")
    ordinal = F.col("__start") + (F.col("__at") - F.shiftleft(F.col("__part"), 33))
    return out.select(ordinal.cast("long").alias(name), *(c for c in df.columns if c != name))


def _check(found: Sequence[str], wanted: Sequence[str]) -> None:
    have = {c.lower() for c in found}
    missing = [c for c in wanted if c.lower() not in have]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")


def read_corpus(spark: SparkSession, path: str, fields: Sequence[str] = (), key: str | None = None, schema: str | T.StructType | None = None, multiline: bool = True) -> DataFrame:
    """The rows of a .csv, .json / .jsonl or .parquet path; all of CSV is read as strings.

    CSV follows RFC 4180: a header, quoted cells with doubled quotes and line breaks inside.  A
    file of such is one task; with multiline=False no cell has a line break and files are split.
    JSON has an object a line, every field into its own column.  With key, that column is
    doc_id; without, rows are numbered.  All of ``fields`` must exist, in any case of letters.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        df = spark.read.option("header", True).option("multiLine", multiline).option("quote", '"').option("escape", '"').csv(path)
    elif kind in ("json", "jsonl", "ndjson"):
        df = (spark.read.schema(schema) if schema else spark.read.option("primitivesAsString", True)).json(path)
    elif kind == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"cannot tell the format of {path!r}: use .csv, .json, .jsonl or .parquet")
    _check(df.columns, [*fields, *([key] if key else [])])
    if key:
        return df.select(F.col(key).cast("long").alias("doc_id"), *(c for c in df.columns if c.lower() not in (key.lower(), "doc_id")))
    return with_ordinal(df)


def from_documents(spark: SparkSession, documents: Any) -> DataFrame:
    """A corpus from strings, rows, dicts, a pandas frame or series, or a Spark DataFrame.

    Strings give the column c0; rows c0, c1, ...; dicts a column for each key, in sorted order.
    None is an empty text.  The rows are numbered from 0 in their order.
    """
    if isinstance(documents, DataFrame):
        return documents if "doc_id" in documents.columns else with_ordinal(documents)
    if hasattr(documents, "to_frame") and not hasattr(documents, "columns"):
        documents = [None if x is None or x != x else x for x in (documents.tolist() if hasattr(documents, "tolist") else documents.to_list())]
    elif hasattr(documents, "to_pandas"):
        documents = documents.to_pandas()
    if hasattr(documents, "itertuples"):
        names = [str(c) for c in documents.columns]
        rows = [[None if x is None or x != x else str(x) for x in row] for row in documents.itertuples(index=False)]
        return _frame(spark, rows, names)
    documents = list(documents)
    if not documents:
        raise ValueError("documents is empty")
    first = documents[0]
    if first is None or isinstance(first, str):
        return _frame(spark, [[d] for d in documents], ["c0"])
    if isinstance(first, dict):
        names = sorted({k for d in documents for k in d})
        return _frame(spark, [[d.get(n) for n in names] for d in documents], names)
    if isinstance(first, (list, tuple)):
        width = len(first)
        return _frame(spark, [list(d)[:width] + [None] * (width - len(d)) for d in documents], [f"c{i}" for i in range(width)])
    raise ValueError(f"cannot index documents of {type(first).__name__}")


def _frame(spark: SparkSession, rows: list[list], names: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField("doc_id", T.LongType(), False), *(T.StructField(n, T.StringType()) for n in names)])
    return spark.createDataFrame([(i, *("" if x is None else str(x) for x in row)) for i, row in enumerate(rows)], schema)
