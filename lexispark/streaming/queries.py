"""A stream of queries joined with a static index."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..plans.index import SearchIndex


def stream_search(index: SearchIndex, queries: DataFrame, path: str, checkpoint: str, **options: Any) -> DataStreamWriter:
    """A writer, to be started, that answers each micro-batch of (query_id, text) in one job.

    Results (query_id, doc_id, score) of batch n replace ``path/batch=n``, so a batch that is run
    again after a failure leaves one copy of its rows.
    """

    def answer(batch: DataFrame, number: int) -> None:
        index.search_batch(batch, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
