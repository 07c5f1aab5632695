"""Incremental ingestion: new sources go through the ingest job once, whatever is run again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vectors
from ..operators.process import Settings, process
from ..sources.store import Store

#: The table of a vault, and its collections with their columns.
TABLE = "vault"
COLLECTIONS = {
    "notes": "stem string, content string",
    "index": "note_id string, document string, content_hash string, embedding array<double>",
    "sources": "source_id string, content string",
    "outcomes": "source_id string, outcome string, n_new long, n_duplicates long, batch long",
}


def ingest(spark: SparkSession, folder: str, schema: str, step: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs step(rows, batch_id) on parquet files that came since the last run; the checkpoint replaces a status marker."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()


def batch_step(store: Store, extractor: Callable[[DataFrame], DataFrame], settings: Settings, at: Column, embed=vectors.keyword_embedding, stream: str = "ingest") -> Callable[[DataFrame, int], None]:
    """A step that adds a batch of sources (source_id, content) to the vault in a store.

    Notes, index, sources and outcomes change in one commit that carries the batch's number: a batch that
    fails half-way leaves the vault as it was, and one that has been committed does nothing when it is
    run again.
    """

    def step(rows: DataFrame, batch: int) -> None:
        tag = f"{stream}-{batch}"
        if store.has_tag(TABLE, tag):
            return
        now = {c: found if (found := store.read(TABLE, c)) is not None else store.spark.createDataFrame([], s) for c, s in COLLECTIONS.items()}
        rows = rows.select(F.col("source_id").cast("string").alias("source_id"), "content")
        done = process(rows, now["notes"], now["index"], extractor, settings, at, False, embed)
        made = done.outcomes.select("source_id", "outcome", "n_new", "n_duplicates", F.lit(batch).cast("long").alias("batch"))
        older = now["sources"].join(done.sources.select("source_id"), "source_id", "left_anti")
        frames = {"notes": done.notes, "index": done.index, "sources": older.unionByName(done.sources.select("source_id", "content")), "outcomes": now["outcomes"].unionByName(made)}
        store.commit_all(TABLE, frames, tag)

    return step


def ingest_sources(store: Store, folder: str, extractor: Callable[[DataFrame], DataFrame], settings: Settings, at: Column, checkpoint: str, embed=vectors.keyword_embedding):
    """A query that adds the sources (source_id, content) in new parquet files of a folder to the vault in a store, and stops."""
    return ingest(store.spark, folder, "source_id string, content string", batch_step(store, extractor, settings, at, embed), checkpoint)
