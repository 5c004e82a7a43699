"""Chunking a stream of documents.

Documents do not depend on each other, so every micro-batch goes through the batch plan; the sink makes batches
that are run again overwrite what they wrote before, which gives each document's chunks once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from maqta.plans.chunker import Chunker


def chunk_stream(docs: DataFrame, chunker: Chunker, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that hands the chunks of each micro-batch of (doc_id, text) to ``sink``."""
    writer = docs.writeStream.foreachBatch(lambda batch, n: sink(chunker.chunk(batch), n)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A folder per micro-batch, replaced if the batch is run again."""
    return lambda chunks, n: chunks.write.mode("overwrite").parquet(f"{path}/batch={n}")
