"""Keeps the chunk index up to date with documents as they arrive, by the same append that the batch job uses."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.vector_table import append_new_chunks


def index_new_documents(
    documents: DataFrame,
    chunk: Callable[[DataFrame], DataFrame],
    embed: Callable[[DataFrame], DataFrame],
    index_path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Start a query that chunks, embeds and appends each batch of new documents, and ends when none are left.

    A batch is known by the checkpoint and its number. The manifest of the index names the batches that it holds, so one that is
    replayed after a failure is passed over, and one that was cut off adds only what is missing.
    """

    def append(batch: DataFrame, number: int) -> None:
        append_new_chunks(batch.sparkSession, chunk(batch), index_path, embed, f"{checkpoint}#{number}")

    return (
        documents.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
