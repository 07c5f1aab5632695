"""The index of notes in a store: one collection for each embedding provider and model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept
from ..sources.store import Store
from . import runner, vectors

TABLE, SCHEMA = "index", "note_id string, document string, content_hash string, embedding array<double>"


def opened(store: Store, provider: str, model: str | None = None, create: bool = True) -> DataFrame | None:
    """The rows (note_id, document, content_hash, embedding) of a collection; made empty where there is none, or None if not create.

    A name that stands for another provider or model, or an unknown provider, is an error.
    """
    name, provider, model = runner.collection_of(provider, model)
    said = store.meta(TABLE, name)
    if said is None:
        return store.get_or_create(TABLE, SCHEMA, name, {"provider": provider, "model": model}) if create else None
    if said != {"provider": provider, "model": model}:
        raise ValueError(f"collection {name} holds {said['provider']}/{said['model']}, not {provider}/{model}")
    return store.read(TABLE, name)


def similar(store: Store, queries: DataFrame, provider: str, model: str | None = None, k: int = 5, max_distance: float | None = None, create: bool = True) -> DataFrame:
    """(query_id, rank, id, distance) of the k nearest notes to each query (id, content); no rows where the collection is absent and not to be made."""
    embed = runner.keyword_or_python(provider, model)
    rows = opened(store, provider, model, create)
    if rows is None:
        rows = store.spark.createDataFrame([], SCHEMA)
    return vectors.find_similar(rows.select(F.col("note_id").alias("id"), F.col("embedding").alias("v")), queries.select("id", embed(F.col("content")).alias("v")), k, max_distance)


def refresh(store: Store, entries: DataFrame, provider: str, model: str | None = None, tag: str = "") -> dict[str, int]:
    """Brings a collection up to entries (note_id, document): only drifted ones are embedded; gives counts of those embedded, dropped and left."""
    now = opened(store, provider, model)
    entries = kept(entries, "entries")
    off = {r["status"]: r["count"] for r in vectors.drift(entries, now).groupBy("status").count().collect()}
    if off:
        store.commit(TABLE, vectors.refreshed(entries, now, runner.keyword_or_python(provider, model)), *_named(provider, model, tag))
    n = entries.count()
    return {"indexed": off.get("missing_or_stale", 0), "removed": off.get("extra", 0), "unchanged": n - off.get("missing_or_stale", 0)}


def rebuild(store: Store, entries: DataFrame, provider: str, model: str | None = None) -> dict[str, int]:
    """Embeds every entry anew, whatever was stored; gives counts of those embedded and of stored ones that are gone."""
    now = opened(store, provider, model)
    removed = now.join(entries.select("note_id"), "note_id", "left_anti").count()
    store.commit(TABLE, vectors.rebuilt(entries, runner.keyword_or_python(provider, model)), *_named(provider, model, ""))
    return {"indexed": store.counts(TABLE)[_named(provider, model, "")[0]], "removed": removed}


def _named(provider: str, model: str | None, tag: str) -> tuple[str, str, dict[str, str]]:
    name, provider, model = runner.collection_of(provider, model)
    return name, tag, {"provider": provider, "model": model}
