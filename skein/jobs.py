"""Whole jobs over a vault: folders of sources and notes in, folders and a store out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import settings
from .functions import text as T
from .operators import graph, index, notes, process, runner, vectors
from .sources import folder
from .sources.shared import kept
from .sources.store import Store

#: Characters of a bundle that a preview shows.
PREVIEW = 2000


@dataclass(frozen=True)
class Vault:
    """A vault's folder and configuration."""

    spark: SparkSession
    root: str
    config: dict

    def at(self, name: str) -> str:
        return settings.resolved(self.root, self.config["folders"][name])

    @property
    def store(self) -> Store:
        return Store(self.spark, self.at("store"))

    @property
    def embedder(self) -> tuple[str, str | None]:
        return self.config["embeddings"]["provider"], self.config["embeddings"]["model"]

    def files(self, name: str) -> DataFrame:
        return folder.read_notes(self.spark, self.at(name))


def ingest(vault: Vault, at: Column, dry_run: bool = False) -> process.Result:
    """Sources through the ingest job: new notes become files, their sources are marked, the index follows.

    A dry run asks for an index that is up to date, and writes nothing.
    """
    stored = kept(vault.files("notes").select("stem", "content"), "notes")
    sources = kept(vault.files("sources").select(F.col("stem").alias("source_id"), "content"), "sources")
    entries = notes.entries(stored)
    now = index.opened(vault.store, *vault.embedder, create=not dry_run)
    now = vault.spark.createDataFrame([], index.SCHEMA) if now is None else now
    if dry_run:
        vectors.require_fresh(entries, now)
    e = vault.config["extractor"]
    ask = runner.extractor(e["provider"], e["model"], e["in_flight"], e["timeout"])
    template = settings.text_of(vault.spark, vault.at("template"))
    done = process.process(sources, stored, now, ask, settings.process_settings(vault.config, template), at, dry_run, runner.keyword_or_python(*vault.embedder, lenient=True))
    if not dry_run:
        folder.write_notes(done.notes.join(stored.select("stem"), "stem", "left_anti"), vault.at("notes"))
        marked = done.sources.alias("n").join(sources.alias("o"), "source_id").where(F.col("n.content") != F.col("o.content"))
        folder.write_notes(marked.select(F.col("source_id").alias("stem"), "n.content"), vault.at("sources"))
        index.refresh(vault.store, notes.entries(done.notes), *vault.embedder)
    return done


def bundle(vault: Vault, at: Column, source: str | None = None, note: str | None = None, depth: int | None = None, top_k: int | None = None, dry_run: bool = False) -> str:
    """The text of a bundle around a source, or else a note, which becomes a file unless in a dry run; a dry run asks for an index that is up to date."""
    if source is None and note is None:
        raise ValueError("name a source or a note")
    b, e = vault.config["bundle"], vault.config["embeddings"]
    depth, top_k = b["depth"] if depth is None else depth, b["top_k"] if top_k is None else top_k
    stored = kept(vault.files("notes").select("stem", "content"), "notes")
    shown = vault.spark.range(1).select(F.date_format(at, "yyyy-MM-dd HH:mm")).first()[0]
    if source is not None:
        name = source.removesuffix(folder.SUFFIX)
        texts = vault.files("sources").where(F.col("stem") == name).select(F.lit(name).alias("source_id"), "content")
        if texts.isEmpty():
            raise FileNotFoundError(source)
        entries = notes.entries(stored)
        if dry_run:
            now = index.opened(vault.store, *vault.embedder, create=False)
            now = vault.spark.createDataFrame([], index.SCHEMA) if now is None else now
            vectors.require_fresh(entries, now)
        else:
            index.refresh(vault.store, entries, *vault.embedder)
            now = index.opened(vault.store, *vault.embedder)
        made = graph.source_bundles(stored, texts, now, depth, shown, top_k, e["max_distance"], runner.keyword_or_python(*vault.embedder))
    else:
        name = vault.spark.range(1).select(T.normalize_id(F.lit(note))).first()[0]
        made = graph.note_bundle(stored, name, depth, shown)
    made = kept(made, "bundle")
    if not dry_run:
        stem = F.regexp_replace(graph.stamped_name(F.col("bundle"), at), r"\.md$", "")
        folder.write_notes(made.select(stem.alias("stem"), "content"), vault.at("bundles"))
    return made.first()["content"]


def preview(content: str) -> str:
    """What a dry run shows of a bundle."""
    more = len(content) - PREVIEW
    return content[:PREVIEW] + (f"\n\n... ({more} more characters)" if more > 0 else "")


def _changed(vault: Vault, new: DataFrame) -> DataFrame:
    """The rows of new (stem, content) whose file has another content or is not there."""
    old = vault.files("notes").select("stem", F.col("content").alias("old"))
    return kept(new.join(old, "stem", "left").where("old is null or old != content").select("stem", "content"), "changed")


def normalize(vault: Vault, dry_run: bool = False) -> dict[str, int]:
    """Tag lines rewritten to ids, each once; gives counts of files, links changed and duplicates dropped."""
    stored = vault.files("notes").select("stem", "content")
    counts = notes.normalize_plan(stored).agg(F.count("*").alias("files"), F.coalesce(F.sum("n_changed"), F.lit(0)).alias("links"), F.coalesce(F.sum("n_duplicates"), F.lit(0)).alias("duplicates")).first().asDict()
    if not dry_run:
        folder.write_notes(_changed(vault, notes.normalized(stored)), vault.at("notes"))
    return counts


def rename(vault: Vault, dry_run: bool = False) -> dict[str, int]:
    """Files renamed to their ids, and files of one id merged, oldest first; new files are written before old ones go."""
    stored = kept(vault.files("notes").select("stem", "content", "mtime"), "notes")
    counts = notes.rename_counts(stored).first().asDict()
    if not dry_run:
        after = notes.renamed(stored)
        folder.write_notes(_changed(vault, after), vault.at("notes"))
        folder.delete_notes(stored.select("stem").join(after.select("stem"), "stem", "left_anti"), vault.at("notes"))
    return counts
