"""The ingest job: sources through chunks, an extractor, validation and duplicate checks to notes and index."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import kept as table
from . import extract, vectors
from . import notes as N


@dataclass(frozen=True)
class Settings:
    """What a run is told; distances are squared lengths in the index and cosines inside a source."""

    template: str
    min_chars: int = 100
    target: int = 4000
    cap: int = 6000
    duplicate: float = 0.15
    similar: int = 5
    similar_within: float = 0.5
    limit: int = 0


@dataclass(frozen=True)
class Result:
    """notes (stem, content) and index as they stand after the run, sources with their new content, one outcome a source, one row for each concept, and counts."""

    notes: DataFrame
    index: DataFrame
    sources: DataFrame
    outcomes: DataFrame
    concepts: DataFrame
    summary: DataFrame


def taken(sources: DataFrame, limit: int) -> DataFrame:
    """The sources (source_id, content) up to the one that would exceed the limit of unprocessed ones; all without a limit."""
    if limit <= 0:
        return sources
    # the first unprocessed source over the limit ends the run: only limit + 1 ids are needed to know it
    over = sources.where(~T.is_processed(F.col("content"))).orderBy("source_id").select("source_id").limit(limit + 1)
    ends = over.agg(F.count("*").alias("n"), F.max("source_id").alias("end")).first()
    return sources if ends["n"] <= limit else sources.where(F.col("source_id") < F.lit(ends["end"]))


def totals(sources: DataFrame) -> DataFrame:
    """(n_sources, n_processed, n_unprocessed)."""
    done = T.is_processed(F.col("content"))
    return sources.agg(F.count("*").alias("n_sources"), F.count_if(done).alias("n_processed"), F.count_if(~done).alias("n_unprocessed"))


def duplicate_reasons(concepts: DataFrame, notes: DataFrame, index: DataFrame, threshold: float, embed=vectors.keyword_embedding) -> DataFrame:
    """(id, reason) for concepts (id, title, content): 'file exists: ...' before 'too similar to: ...', else null."""
    named = concepts.withColumn("file", F.concat(T.sanitize(F.col("title")), F.lit(".md")))
    files = notes.select(F.concat("stem", F.lit(".md")).alias("file"), F.lit(True).alias("exists")).distinct()
    near = vectors.find_similar(index.select(F.col("note_id").alias("id"), F.col("embedding").alias("v")), concepts.select("id", embed(F.col("content")).alias("v")), 1, threshold)
    near = near.select(F.col("query_id").alias("id"), F.col("id").alias("twin"))
    both = named.join(files, "file", "left").join(near, "id", "left")
    reason = F.when(F.col("exists"), F.concat(F.lit("file exists: "), "file")).when(F.col("twin").isNotNull(), F.concat(F.lit("too similar to: "), "twin"))
    return both.select("id", reason.alias("reason"))


def process(sources: DataFrame, notes: DataFrame, index: DataFrame, extractor: Callable[[DataFrame], DataFrame], settings: Settings, at: Column, dry_run: bool = False, embed=vectors.keyword_embedding) -> Result:
    """One run over sources (source_id, content), notes (stem, content) and index (note_id, document, content_hash, embedding).

    A concept is new if no note has its file name and none is too similar, counting the notes that the run
    writes for earlier concepts (in order of source, chunk and item).  Similarity compares contents of
    concepts among themselves and with whole notes in the index, so that it does not depend on what a run
    wrote in between.  A dry run writes nothing: notes, index and sources come back as they were, and
    sources with concepts count as created.
    """
    entries = N.entries(notes)
    index = index.select("note_id", "document", "content_hash", "embedding")
    current = index if dry_run else vectors.refreshed(entries, index, embed)
    run = taken(sources.select("source_id", "content"), settings.limit)
    eligible = run.where(~T.is_processed(F.col("content")) & (F.length(T.strip(F.col("content"))) >= settings.min_chars))
    replies = table(extract.extracted(eligible, extractor, settings.target, settings.cap), "replies")
    found = extract.outcomes(run, replies, settings.min_chars)
    good = extract.concepts(replies).where("ok")
    key = F.struct("source_id", "chunk_pos", "item_pos")
    good = vectors.title_dedupe(good.withColumn("id", key), "source_id", "title", "chunk_pos", "item_pos")
    # where an embedding fails (a null vector) its source keeps what the titles left
    placed = table(good.select("source_id", "id", embed(F.col("content")).alias("v")), "embedded")
    failed = placed.where("v is null").select("source_id").distinct()
    inside = vectors.near_in_groups(placed.join(failed, "source_id", "left_anti"), "source_id", settings.duplicate)
    kept = vectors.first_come(good, inside).where("kept").select("id")
    deduped = table(good.join(kept, "id", "left_semi").withColumn("id", F.concat_ws("/", F.col("source_id").cast("string"), F.lpad(F.col("chunk_pos").cast("string"), 9, "0"), F.lpad(F.col("item_pos").cast("string"), 9, "0"))), "concepts")
    if dry_run:
        judged = deduped.select("*", F.lit(None).cast("string").alias("reason"))
        return Result(notes, index, sources, found, judged.select("source_id", "title", "reason"), extract.summary(found))
    reasons = duplicate_reasons(deduped, notes, current, settings.duplicate, embed)
    judged = deduped.join(reasons, "id")
    fresh = judged.where("reason is null")
    first = vectors.first_come_named(fresh.select("id", T.sanitize(F.col("title")).alias("name"), embed(F.col("content")).alias("v")), settings.duplicate)
    judged = table(judged.join(first, "id", "left").withColumn("reason", F.when(F.col("kept") == F.lit(False), "duplicate of an earlier concept of this run").otherwise(F.col("reason"))).drop("kept"), "judged")
    new = judged.where("reason is null")
    similar = vectors.find_similar(current.select(F.col("note_id").alias("id"), F.col("embedding").alias("v")), new.select("id", embed(F.col("content")).alias("v")), settings.similar, settings.similar_within)
    similar = similar.groupBy(F.col("query_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("note")))), lambda x: x["note"]).alias("similar"))
    none = F.array().cast("array<string>")
    body = T.render_note(F.col("title"), F.col("content"), F.col("tags"), F.coalesce("similar", none), F.col("source_id").cast("string"), settings.template, at)
    written = new.join(similar, "id", "left").select(T.sanitize(F.col("title")).alias("stem"), body.alias("content"))
    all_notes = table(notes.select("stem", "content").union(written), "notes")
    made = judged.groupBy("source_id").agg(F.count_if(F.col("reason").isNull()).alias("n_new"), F.count_if(F.col("reason").isNotNull()).alias("n_duplicates"))
    found = found.join(made, "source_id", "left").fillna(0, ["n_new", "n_duplicates"])
    found = table(found.withColumn("outcome", F.when((F.col("outcome") == "created") & (F.col("n_new") == 0), "no_valid_concepts").otherwise(F.col("outcome"))), "outcomes")
    marked = found.where(F.col("outcome").isin("created", "no_valid_concepts", "non_extractable")).select("source_id", F.lit(True).alias("mark"))
    c = F.col("content")
    after = sources.join(marked, "source_id", "left").withColumn("content", F.when(F.col("mark"), T.mark_processed(c)).otherwise(c)).select(*sources.columns)
    return Result(all_notes, vectors.refreshed(N.entries(all_notes), current, embed), after, found, judged.select("source_id", "title", "reason"), extract.summary(found))
