"""Breadth-first traversal over tag links, and bundles of notes made from it, for any number of seeds at once.

A bundle is a key in every table: one join a level serves all of them.  Notes reached at one level get
their order from a range sort over (bundle, order of the parent, place of the link): partitions are
counted, and a row's number is its partition's offset plus its place there, so that no level passes
through one task and a bundle that holds a third of all rows is spread like any other rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import kept
from . import notes as N
from . import vectors
from .ranks import numbered

# The lines of a bundle.
TITLE, GENERATED, SOURCE_TEXT, CONNECTED, DEGREE, NOTE = "# Bundle: ", "Generated: ", "## Source Content", "## Connected Knowledge", "### Degree ", "#### "
METADATA, SOURCE = "## Metadata", "Source: "
COUNTS = (("source_notes", "Source notes"), ("direct_tags", "Direct tags"), ("direct_similar_notes", "Direct similar notes"), ("traversed_notes", "Traversed notes"), ("total_notes", "Total notes included"), ("max_depth", "Max depth"))

#: Most characters of a row that digests reads.
SLICE = 1000


def reach_all(notes: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(bundle, note_id, degree, ord): notes within depth tag links of a bundle's seeds (bundle, note_id, ord), seeds left out.

    A note's order in its degree is that of the least (order of parent, place of link), level by level.
    """
    return _reached(notes.select("stem", T.tag_links(F.col("content")).alias("tags")), seeds, depth)


def _linked(notes: DataFrame) -> DataFrame:
    """(stem, tags, refers, rendered): what traversal reads of notes, as a written table, so that their texts are not dealt out for it."""
    c = F.col("content")
    return kept(notes.select("stem", T.tag_links(c).alias("tags"), T.reference_links(c).alias("refers"), c.isNotNull().alias("rendered")), "linked")


def _reached(linked: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    targets = kept(N.last_files(linked.select("stem", "tags")).select("note_id", "tags"), "tags")
    edges = targets.select("note_id", F.posexplode("tags").alias("pos", "raw")).select("note_id", "pos", T.normalize_id(F.col("raw")).alias("target"))
    edges = edges.join(targets.select(F.col("note_id").alias("target")), "target", "left_semi")
    if depth > 1:
        edges = kept(edges, "edges")
    level = seeds.groupBy("bundle", "note_id").agg(F.min("ord").cast("long").alias("ord"))
    level = kept(level, "seeds")
    seen, out = level.select("bundle", "note_id"), level.select("bundle", "note_id", F.lit(0).alias("degree"), "ord").where("false")
    for degree in range(1, depth + 1):
        step = level.join(edges, "note_id").select("bundle", F.col("target").alias("note_id"), F.struct("ord", "pos").alias("at"))
        step = step.groupBy("bundle", "note_id").agg(F.min("at").alias("at")).join(seen, ["bundle", "note_id"], "left_anti")
        level = kept(numbered(step, "bundle", "at").select("bundle", "note_id", "ord"), "level")
        seen = seen.union(level.select("bundle", "note_id"))
        out = out.unionByName(level.withColumn("degree", F.lit(degree)))
    return out


def reach(notes: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(note_id, degree, ord): as reach_all, for one set of seeds (note_id, ord)."""
    return reach_all(notes, seeds.select(F.lit("").alias("bundle"), "note_id", "ord"), depth).select("note_id", "degree", "ord")


def named_files(notes: DataFrame) -> DataFrame:
    """One file for each id: the one that has it as its name, else the first in file order."""
    first = F.min(F.struct((F.col("stem") != F.col("note_id")).alias("other"), "stem", "content"))
    return N.with_ids(notes).groupBy("note_id").agg(first.alias("f")).select("note_id", "f.stem", "f.content")


def all_note_seeds(notes: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seeds (bundle, note_id, ord) and counts (bundle, source_notes, direct_tags, direct_similar_notes) of the wanted (bundle) ids that are notes.

    Seeds are the note, its tags and its see-also links, each once and missing ones too; the counts have links that repeat each time.
    """
    own = named_files(notes).join(wanted.select(F.col("bundle").alias("note_id")).distinct(), "note_id", "left_semi")
    tags, see = T.tag_links(F.col("content")), T.see_also_links(F.col("content"))
    ids = F.array_distinct(F.concat(F.array("note_id"), T.ids_of(F.col("tags")), T.ids_of(F.col("see"))))
    own = own.select("note_id", tags.alias("tags"), see.alias("see"))
    seeds = own.select(F.col("note_id").alias("bundle"), F.posexplode(ids).alias("ord", "note_id")).select("bundle", "note_id", F.col("ord").cast("long").alias("ord"))
    counts = own.select(F.col("note_id").alias("bundle"), F.lit(1).cast("long").alias("source_notes"), F.size("tags").cast("long").alias("direct_tags"), F.size("see").cast("long").alias("direct_similar_notes"))
    return seeds, counts


def all_source_seeds(notes: DataFrame, sources: DataFrame, similar: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Seeds and counts, as all_note_seeds, of bundles of sources (bundle): notes that refer to the source, in file order, then the similar ones (bundle, rank, note_id) not among them."""
    return _source_seeds(notes.select("stem", T.reference_links(F.col("content")).alias("refers")), sources, similar)


def _source_seeds(linked: DataFrame, sources: DataFrame, similar: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    spark = linked.sparkSession
    refers = N.with_ids(linked).select("stem", "note_id", F.explode("refers").alias("raw")).select(T.normalize_id(F.col("raw")).alias("target"), "note_id", "stem").distinct()
    named = sources.select("bundle").distinct().withColumn("target", T.normalize_id(F.col("bundle")))
    own = refers.join(named, "target").select("bundle", "note_id", "stem")
    if similar is None:
        similar = spark.createDataFrame([], "bundle string, rank int, note_id string")
    more = similar.select("bundle", "rank", "note_id").join(own, ["bundle", "note_id"], "left_anti")
    firsts = own.groupBy("bundle", "note_id").agg(F.min("stem").alias("stem")).select("bundle", "note_id", F.lit(0).alias("part"), "stem", F.lit(0).alias("rank"))
    both = firsts.union(more.select("bundle", "note_id", F.lit(1), F.lit(""), F.col("rank").cast("int")))
    seeds = numbered(both, "bundle", "part", "stem", "rank", "note_id").select("bundle", "note_id", "ord")
    counts = named.select("bundle").join(own.groupBy("bundle").agg(F.count("*").alias("source_notes")), "bundle", "left").join(more.groupBy("bundle").agg(F.count("*").alias("direct_similar_notes")), "bundle", "left")
    return seeds, counts.fillna(0).select("bundle", "source_notes", F.lit(0).cast("long").alias("direct_tags"), "direct_similar_notes")


def all_listed(notes: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(bundle, degree, ord, note_id): the seeds at degree 0, and what is reached from them."""
    return _listed(notes.select("stem", T.tag_links(F.col("content")).alias("tags")), seeds, depth)


def _listed(linked: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    reached = _reached(linked, seeds, depth).select("bundle", "note_id", "degree", "ord")
    degrees = seeds.select("bundle", "note_id", F.lit(0).alias("degree"), F.col("ord").cast("long").alias("ord")).unionByName(reached)
    return degrees.select("bundle", "degree", "ord", "note_id")


def all_bundle_rows(notes: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(bundle, degree, ord, note_id, rendered, content): rendered tells whether a file has the id as its name."""
    files = notes.select(F.col("stem").alias("note_id"), T.rstrip(F.col("content")).alias("content"))
    return all_listed(notes, seeds, depth).join(files, "note_id", "left").select("bundle", "degree", "ord", "note_id", F.col("content").isNotNull().alias("rendered"), "content")


def metadata(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(bundle, source_notes, direct_tags, direct_similar_notes, traversed_notes, total_notes, max_depth) of bundle rows and the counts of their seeds."""
    seen = rows.groupBy("bundle").agg(F.count_if(F.col("degree") > 0).alias("traversed_notes"), F.count_if("rendered").alias("total_notes"), F.max("degree").cast("long").alias("max_depth"))
    return counts.join(seen, "bundle", "left").fillna(0, ["traversed_notes", "total_notes", "max_depth"]).select("bundle", *(c for c, _ in COUNTS))


def parts(notes: DataFrame, listed: DataFrame, described: DataFrame, at: str) -> DataFrame:
    """(bundle, degree, ord, part): bundles as pieces of markdown in the order of degree and ord, so that no row holds a whole bundle.

    listed has the rows of all_listed, described (bundle, title, source, source_text) and the columns of metadata; at is the time that it shows.
    """
    line = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs), F.lit("\n"))
    source = F.when(F.col("source_text").isNotNull(), F.concat(F.lit(f"{SOURCE_TEXT}\n\n"), F.col("source_text"), F.lit("\n\n"))).otherwise("")
    head = F.concat(line(TITLE, F.col("title")), line(GENERATED, at), F.lit("\n"), source, F.lit(f"{CONNECTED}\n\n"))
    tail = F.concat(F.lit(f"{METADATA}\n\n"), line(SOURCE, "[[", F.col("source"), "]]"), *(line(f"{shown}: ", F.col(c)) for c, shown in COUNTS))
    first, last = F.lit(-1).cast("long"), F.lit(2**31 - 1)
    degrees = listed.select("bundle", "degree").distinct().select("bundle", "degree", first.alias("ord"), line(DEGREE, F.col("degree"), "\n").alias("part"))
    files = notes.select(F.col("stem").alias("note_id"), T.rstrip(F.col("content")).alias("content")).where("content is not null")
    # the names of files that no id has are not dealt out: ids are in lower case, without blanks, underscores and doubled dashes, unless a caller's own are not
    odd = F.col("note_id").rlike(rf"_|{T.WS}|--") | (F.col("note_id") != F.lower("note_id"))
    if listed.where(odd).isEmpty():
        files = files.where(~odd)
    shown = listed.join(files, "note_id").select("bundle", "degree", "ord", F.concat(F.lit(NOTE), F.col("note_id"), F.lit("\n\n"), F.col("content"), F.lit("\n\n")).alias("part"))
    ends = described.select("bundle", F.lit(-1).alias("degree"), first.alias("ord"), head.alias("part")).unionByName(described.select("bundle", last.alias("degree"), first.alias("ord"), tail.alias("part")))
    return ends.unionByName(degrees).unionByName(shown)


def texts(pieces: DataFrame) -> DataFrame:
    """(bundle, content): each bundle of pieces (see parts) as one text, which one row holds; for bundles that a row can't hold there are the pieces and their digests."""
    made = pieces.groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("degree", "ord", "part"))).alias("p"))
    return made.select("bundle", F.array_join(F.col("p.part"), "").alias("content"))


def digests(pieces: DataFrame) -> DataFrame:
    """(bundle, n_chars, content_hash): length and SHA-256 of each bundle of pieces (see parts), of any size: its pieces pass by in their order and are not held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, digest = None, 0, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], names=["bundle", "n_chars", "content_hash"])
        for batch in batches:
            for bundle, part in zip(batch.column("bundle"), batch.column("part")):
                bundle, part = bundle.as_py(), part.as_py()
                if digest is None or bundle != now:
                    if digest is not None:
                        yield done()
                    now, n, digest = bundle, 0, hashlib.sha256()
                n += len(part)
                digest.update(part.encode())
        if digest is not None:
            yield done()

    placed = pieces.select("bundle", "degree", "ord", "part").repartition("bundle").sortWithinPartitions("bundle", "degree", "ord", "part")
    # an Arrow batch has a number of rows, however long they are: short ones keep it small
    slices = F.transform(F.sequence(F.lit(0), F.floor(F.length("part") / SLICE).cast("int")), lambda k: F.substring("part", k * SLICE + 1, F.lit(SLICE)))
    return placed.select("bundle", F.explode(slices).alias("part")).mapInArrow(run, "bundle string, n_chars long, content_hash string")


def _described(linked: DataFrame, listed: DataFrame, counts: DataFrame) -> DataFrame:
    """metadata of the rows of all_listed."""
    files = linked.where("rendered").select(F.col("stem").alias("note_id"), "rendered")
    rows = listed.join(files, "note_id", "left").select("bundle", "degree", "note_id", F.col("rendered").isNotNull().alias("rendered"))
    return metadata(rows, counts).select("*", F.col("bundle").alias("title"), F.col("bundle").alias("source"))


def note_bundles(notes: DataFrame, wanted: DataFrame, depth: int, at: str) -> DataFrame:
    """(bundle, content): bundles around the notes whose ids are in wanted (bundle); ids without a note have none."""
    seeds, counts = all_note_seeds(notes, wanted)
    linked, seeds = _linked(notes), kept(seeds, "seeds")
    listed = kept(_listed(linked, seeds, depth), "listed")
    described = kept(_described(linked, listed, counts).withColumn("source_text", F.lit(None).cast("string")), "described")
    return texts(parts(notes, listed, described, at))


def source_parts(notes: DataFrame, sources: DataFrame, index: DataFrame, depth: int, at: str, k: int = 10, max_distance: float = 0.5, embed=vectors.keyword_embedding) -> DataFrame:
    """(bundle, degree, ord, part): the pieces (see parts) of bundles around sources (source_id, content), with the notes that refer to them and the k nearest entries of index (note_id, embedding)."""
    asked = sources.select(F.col("source_id").alias("id"), embed(F.col("content")).alias("v"))
    near = vectors.find_similar(index.select(F.col("note_id").alias("id"), F.col("embedding").alias("v")), asked, k, max_distance)
    similar = kept(near.select(F.col("query_id").alias("bundle"), "rank", F.col("id").alias("note_id")), "similar")
    linked = _linked(notes)
    seeds, counts = _source_seeds(linked, sources.select(F.col("source_id").alias("bundle")), similar)
    seeds = kept(seeds, "seeds")
    listed = kept(_listed(linked, seeds, depth), "listed")
    text = sources.select(F.col("source_id").alias("bundle"), F.col("content").alias("source_text"))
    described = kept(_described(linked, listed, counts).join(text, "bundle"), "described")
    return parts(notes, listed, described, at)


def source_bundles(notes: DataFrame, sources: DataFrame, index: DataFrame, depth: int, at: str, k: int = 10, max_distance: float = 0.5, embed=vectors.keyword_embedding) -> DataFrame:
    """(bundle, content): the bundles of source_parts as texts."""
    return texts(source_parts(notes, sources, index, depth, at, k, max_distance, embed))


def stamped_name(title: Column, at: Column) -> Column:
    """The file name of a bundle written at that time."""
    return F.concat(T.sanitize(title), F.lit("-"), F.date_format(at, "yyyyMMdd-HHmmss"), F.lit(".md"))


# One bundle


def note_seeds(notes: DataFrame, note_id: str) -> DataFrame:
    """(note_id, ord): the note itself, its tags and its see-also links, each once; missing ones too."""
    return all_note_seeds(notes, _one(notes, note_id))[0].select("note_id", F.col("ord").cast("int").alias("ord"))


def _one(notes: DataFrame, bundle: str) -> DataFrame:
    return notes.sparkSession.createDataFrame([(bundle,)], "bundle string")


def bundle_rows(notes: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(degree, ord, note_id, rendered, content) for one set of seeds (note_id, ord)."""
    return all_bundle_rows(notes, seeds.select(F.lit("").alias("bundle"), "note_id", "ord"), depth).drop("bundle")


def note_bundle(notes: DataFrame, note_id: str, depth: int, at: str) -> DataFrame:
    """One row (bundle, content); FileNotFoundError where no note has the id."""
    done = kept(note_bundles(notes, _one(notes, note_id), depth, at), "bundle")
    if done.isEmpty():
        raise FileNotFoundError(note_id)
    return done


def source_seeds(notes: DataFrame, source: str, similar: DataFrame) -> DataFrame:
    """(note_id, ord): the notes that refer to the source, in file order, then the ids of similar (rank, note_id) not among them."""
    return all_source_seeds(notes, _one(notes, source), similar.withColumn("bundle", F.lit(source)))[0].drop("bundle")


def source_counts(notes: DataFrame, source: str, similar: DataFrame, depth: int) -> dict[str, int]:
    """The metadata of a source's bundle."""
    seeds, counts = all_source_seeds(notes, _one(notes, source), similar.withColumn("bundle", F.lit(source)))
    return metadata(all_bundle_rows(notes, seeds, depth), counts).drop("bundle").first().asDict()


def note_counts(notes: DataFrame, note_id: str, depth: int) -> dict[str, int]:
    """The metadata of a note's bundle; links that repeat count each time."""
    seeds, counts = all_note_seeds(notes, _one(notes, note_id))
    row = metadata(all_bundle_rows(notes, seeds, depth), counts).drop("bundle").first()
    if row is None:
        raise FileNotFoundError(note_id)
    return row.asDict()
