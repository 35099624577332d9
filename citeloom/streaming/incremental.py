"""Incremental ingestion: new chunk files stream in and are put into the vector table batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from citeloom.operators.index import VectorTable
from citeloom.sources.documents import CHUNK_SCHEMA


def stream_chunks(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Chunk files of a folder as they arrive."""
    reader = spark.readStream.schema(CHUNK_SCHEMA).option("pathGlobFilter", "*.chunks.jsonl").option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def upsert_stream(chunks: DataFrame, table: VectorTable, embedder: Callable[[DataFrame], DataFrame], checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Embeds and upserts each batch. Ids are stable, so a batch that runs again after a failure changes nothing."""

    def put(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            table.upsert(embedder(batch))

    writer = chunks.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
