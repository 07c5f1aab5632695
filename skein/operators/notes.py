"""Notes as rows: ids, entries, collisions, links, maintenance plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def with_ids(notes: DataFrame) -> DataFrame:
    """notes (stem, content, ...) with note_id."""
    return notes.withColumn("note_id", T.normalize_id(F.col("stem")))


def entries(notes: DataFrame) -> DataFrame:
    """(note_id, document): contents that are not blank, of all files with one id, in file order."""
    rows = with_ids(notes).select("note_id", "stem", T.strip(F.col("content")).alias("c")).where("c != ''")
    parts = F.array_sort(F.collect_list(F.struct("stem", "c")))
    return rows.groupBy("note_id").agg(parts.alias("p")).select("note_id", F.array_join(F.col("p.c"), "\n\n---\n\n").alias("document"))


def collisions(notes: DataFrame) -> DataFrame:
    """(note_id, files): ids that several files share."""
    return with_ids(notes).groupBy("note_id").agg(F.array_sort(F.collect_list("stem")).alias("files")).where(F.size("files") > 1)


def links(notes: DataFrame, kind: str) -> DataFrame:
    """(stem, note_id, pos, raw, target) of the tag, see_also or reference links."""
    found = {"tag": T.tag_links, "see_also": T.see_also_links, "reference": T.reference_links}[kind](F.col("content"))
    rows = with_ids(notes).select("stem", "note_id", F.posexplode(found).alias("pos", "raw"))
    return rows.withColumn("target", T.normalize_id(F.col("raw")))


def last_files(notes: DataFrame) -> DataFrame:
    """One file for each id: the last in file order."""
    last = F.row_number().over(W.partitionBy("note_id").orderBy(F.desc("stem")))
    return with_ids(notes).withColumn("_r", last).where("_r = 1").drop("_r")


def migrate_see_also(notes: DataFrame) -> DataFrame:
    """notes with see-also links moved into the tag line; a missing tag line is added on top."""
    see, tags = T.see_also_links(F.col("content")), T.tag_links(F.col("content"))
    new = F.array_except(F.array_distinct(T.ids_of(F.col("_see"))), T.ids_of(F.col("_tags")))
    df = notes.withColumns({"_see": see, "_tags": tags})
    base = F.when(F.col("content").rlike(T.TAG_LINE), F.col("content")).otherwise(F.concat(F.lit("Tags:\n"), F.col("content")))
    moved = T.without_see_also(T.with_tags(base, F.concat(T.ids_of(F.col("_tags")), new)))
    return df.withColumn("content", F.when(F.size("_see") > 0, moved).otherwise(F.col("content"))).drop("_see", "_tags")


def missing_backlinks(notes: DataFrame) -> DataFrame:
    """(target, backlink): A is missing among the tags of B, which A tags; for colliding ids the last file of B counts."""
    edges = links(notes, "tag").select(F.col("note_id").alias("backlink"), "target").distinct()
    targets = last_files(notes)
    back = links(targets, "tag").select(F.col("note_id").alias("target"), F.col("target").alias("backlink")).distinct()
    return edges.join(targets.select(F.col("note_id").alias("target")), "target", "left_semi").join(back, ["target", "backlink"], "left_anti").select("target", "backlink")


def add_backlinks(notes: DataFrame) -> DataFrame:
    """notes with the missing backlinks appended, sorted, to the tag line of the last file of an id."""
    add = missing_backlinks(notes).groupBy(F.col("target").alias("note_id")).agg(F.array_sort(F.collect_set("backlink")).alias("_add"))
    last = last_files(notes).select("note_id", "stem").join(add, "note_id")
    df = with_ids(notes).join(last, ["note_id", "stem"], "left")
    base = F.when(F.col("content").rlike(T.TAG_LINE), F.col("content")).otherwise(F.concat(F.lit("Tags:\n"), F.col("content")))
    new = T.with_tags(base, F.concat(T.ids_of(T.tag_links(F.col("content"))), F.col("_add")))
    return df.withColumn("content", F.when(F.col("_add").isNotNull(), new).otherwise(F.col("content"))).select(*notes.columns)


def normalize_plan(notes: DataFrame) -> DataFrame:
    """(stem, n_changed, n_duplicates, tags) of the notes whose tag line is to be rewritten."""
    df = notes.select("stem", T.tag_links(F.col("content")).alias("old")).where(F.size("old") > 0).withColumn("ids", T.ids_of(F.col("old")))
    df = df.withColumn("tags", F.array_distinct("ids"))
    changed = F.size(F.filter(F.zip_with("old", "ids", lambda a, b: a != b), lambda x: x))
    return df.where(F.col("old") != F.col("tags")).select("stem", changed.cast("long").alias("n_changed"), (F.size("ids") - F.size("tags")).cast("long").alias("n_duplicates"), "tags")


def normalized(notes: DataFrame) -> DataFrame:
    """notes with tag lines rewritten to ids, each once, where that changes one."""
    df = notes.withColumn("_old", T.tag_links(F.col("content"))).withColumn("_new", F.array_distinct(T.ids_of(F.col("_old"))))
    new = F.when((F.size("_old") > 0) & (F.col("_old") != F.col("_new")), T.with_tags(F.col("content"), F.col("_new"))).otherwise(F.col("content"))
    return df.withColumn("content", new).select(*notes.columns)


def renamed(notes: DataFrame) -> DataFrame:
    """(stem, content) of notes (stem, content, mtime) as files of their ids: single ones as they are, several merged."""
    single = with_ids(notes).groupBy("note_id").agg(F.count("*").alias("n"), F.first("content").alias("content")).where("n = 1")
    return single.select(F.col("note_id").alias("stem"), "content").unionByName(merged_by_time(notes).select(F.col("note_id").alias("stem"), "content"))


def rename_plan(notes: DataFrame) -> DataFrame:
    """(note_id, action, files): files to rename, and groups to merge, in file order."""
    groups = with_ids(notes).groupBy("note_id").agg(F.array_sort(F.collect_list("stem")).alias("files"))
    action = F.when(F.size("files") > 1, "merge").when(F.element_at("files", 1) != F.col("note_id"), "rename")
    return groups.withColumn("action", action).where("action is not null").select("note_id", "action", "files")


def merged_by_time(notes: DataFrame) -> DataFrame:
    """(note_id, content): what a merge of colliding files writes, oldest first."""
    rows = with_ids(notes).select("note_id", "mtime", "stem", T.strip(F.col("content")).alias("c"))
    parts = F.array_sort(F.collect_list(F.struct("mtime", "stem", "c")))
    rows = rows.groupBy("note_id").agg(parts.alias("p")).where(F.size("p") > 1)
    kept = F.filter(F.col("p.c"), lambda x: x != "")
    return rows.select("note_id", F.concat(F.array_join(kept, "\n\n---\n\n"), F.lit("\n")).alias("content"))


def notes_of_source(notes: DataFrame, source: str) -> DataFrame:
    """Notes with a reference to the source."""
    hit = F.exists(T.ids_of(T.reference_links(F.col("content"))), lambda x: x == T.normalize_id(F.lit(source)))
    return with_ids(notes).where(hit)


def sync_backlinks(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes after see-also links moved to tags and backlinks were added, one row of counts)."""
    moved = migrate_see_also(notes)
    after = add_backlinks(moved)
    see = F.size(T.see_also_links(F.col("content")))
    first = notes.agg(F.count_if(see > 0).alias("n_sections_removed"), F.coalesce(F.sum(see), F.lit(0)).cast("long").alias("n_tags_added"))
    links_ = missing_backlinks(moved).agg(F.count("*").alias("n_backlinks_added"))
    changed = after.select("stem", F.col("content").alias("new")).join(notes.select("stem", "content"), "stem").agg(F.count_if(F.col("new") != F.col("content")).alias("n_files_modified"))
    return after, first.join(links_).join(changed)


def rename_counts(notes: DataFrame) -> DataFrame:
    """One row: files renamed, groups merged, files that merges delete (all but one that has the id as its name)."""
    plan = rename_plan(notes)
    merge = F.col("action") == "merge"
    return plan.agg(
        F.count_if(F.col("action") == "rename").alias("n_renamed"),
        F.count_if(merge).alias("n_merged"),
        F.coalesce(F.sum(F.when(merge, F.size("files") - F.array_contains("files", F.col("note_id")).cast("int"))), F.lit(0)).cast("long").alias("n_deleted"),
    )
