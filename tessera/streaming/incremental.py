"""Incremental ingestion: streams of texts and of files into the store, a batch at a time, each exactly once.

A batch's number is kept in the store with the batch's own change, under the stream's id, which lives in its
checkpoint. A batch that is tried again after its commit finds itself there and is passed over; one that was lost
before its commit left nothing behind."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.ingest import from_files, from_texts, store_batch
from tessera.operators.store import Store
from tessera.sources import files

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gives a stream with its checkpoint; a new checkpoint has a new one, and its batches count anew."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]


def into_store(store: Store, checkpoint: str, put: Callable[[DataFrame, tuple[str, int]], object]) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that gives ``put`` each batch that the store hasn't seen."""

    def once(batch: DataFrame, number: int) -> None:
        stream = stream_id(store.spark, checkpoint)
        if not store.seen(stream, number) and not batch.isEmpty():
            put(batch, (stream, number))

    return once


def ingest_stream(texts: DataFrame, store: Store, checkpoint: str, vectors: bool = True) -> StreamingQuery:
    """Rows (title, text) as they come."""

    def put(batch: DataFrame, number: tuple[str, int]) -> None:
        store_batch(store, from_texts(batch.dropDuplicates(["title", "text"])), vectors=vectors, batch=number)

    return texts.writeStream.foreachBatch(into_store(store, checkpoint, put)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_folder(spark: SparkSession, folder: str, store: Store, checkpoint: str, vectors: bool = True) -> StreamingQuery:
    """New files of a folder as they come, of every kind that has a reader."""

    def put(batch: DataFrame, number: tuple[str, int]) -> None:
        known = files.known(batch).cache()
        try:
            store_batch(store, from_files(files.read(known)), vectors=vectors, batch=number, also=lambda c: c.upsert("files", seen_files(batch), "path"))
        finally:
            known.unpersist()

    found = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(folder)
    return found.writeStream.foreachBatch(into_store(store, checkpoint, put)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def seen_files(batch: DataFrame) -> DataFrame:
    return batch.select("path", "modificationTime", "length")


def changed_files(spark: SparkSession, folder: str, store: Store) -> DataFrame:
    """The files of a folder that the store doesn't have, or has with another time or size; no content is read to find them."""
    found = spark.read.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(folder)
    if not store.has("files"):
        return found
    known = store.read("files")
    same = [found[c] == known[c] for c in ("path", "modificationTime", "length")]
    return found.join(known, same, "left_anti")


def rescan(spark: SparkSession, folder: str, store: Store, vectors: bool = True) -> DataFrame:
    """Takes in again what ``changed_files`` finds, as one change: a stream of files knows a path once and no more."""
    changed = changed_files(spark, folder, store)
    return store_batch(store, from_files(files.read(files.known(changed))), vectors=vectors, also=lambda c: c.upsert("files", seen_files(changed), "path"))
