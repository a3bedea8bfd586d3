"""A stream of queries against a stored index: each micro-batch is one batch of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from codexlake.operators import lexical


def bm25_stream(queries: DataFrame, index: lexical.Bm25Index, sink: Callable[[DataFrame, int], None], checkpoint: str, top_k: int = lexical.TOP_K) -> StreamingQuery:
    """Start a stream of (query_id, query) rows; ``sink`` gets each batch's hits and number, and may
    see a number again after a failure."""

    def run(batch: DataFrame, number: int) -> None:
        sink(lexical.search(index, lexical.query_terms(batch), top_k), number)

    return queries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
