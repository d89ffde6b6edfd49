"""Operators over streams.

What works on one document at a time has no state and no order, so the same function runs on a stream of documents. It
is applied to `readStream` directly, or to micro-batches where an operator needs a window over a document's rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexframe.operators.clauses import clauses
from lexframe.operators.entities import named_entities


def clause_stream(docs: DataFrame) -> DataFrame:
    """Clauses of a stream of documents (doc_id, text); stateless."""
    return clauses(docs)


def entity_stream(docs: DataFrame) -> DataFrame:
    """Named entities of a stream of documents; stateless."""
    return named_entities(docs)


def write_batches(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Applies an operator to each micro-batch and writes a folder for it: a batch that is run again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
