"""Registered queries over the derived vault and the test tables, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.chunk import section_chunks, sections, source_chunks
from ..operators import extract, graph, notes, process, runner, vectors
from ..sources.shared import kept, shared_dir
from ..sources.store import Store
from ..sources.vault import VAULT_SQL, vault

#: Chunk sizes of the queries, and the distance of duplicates in the ingest run, whose concepts are short.
TARGET, CAP, DUPLICATE = 1200, 1600, 1e-5
TEMPLATE = "# {{Title}}\n\nTags:\nWritten on {{date}} at {{time}}\n\n# See Also\n\n# References\n"
def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def note_ids(spark, sf_dir):
    return notes.with_ids(vault(spark, sf_dir)).select("doc_id", "note_id")


def _links(kind):
    def query(spark, sf_dir):
        return notes.links(vault(spark, sf_dir), kind).select("stem", F.col("pos").cast("long").alias("pos"), "raw", "target")

    return query


def processed_flags(spark, sf_dir):
    return vault(spark, sf_dir).select("doc_id", T.is_processed(F.col("content")).alias("processed"))


def mark_processed(spark, sf_dir):
    return vault(spark, sf_dir).select("doc_id", T.content_hash(T.mark_processed(F.col("content"))).alias("content_hash"))


def content_hashes(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


def see_also_removed(spark, sf_dir):
    return vault(spark, sf_dir).select("doc_id", T.content_hash(T.without_see_also(F.col("content"))).alias("content_hash"))


def tag_line_rewrite(spark, sf_dir):
    c = F.col("content")
    return vault(spark, sf_dir).select("doc_id", T.content_hash(T.with_tags(c, T.unique_ids(T.tag_links(c)))).alias("content_hash"))


def section_replaced(spark, sf_dir):
    return vault(spark, sf_dir).select("doc_id", T.content_hash(T.with_section(F.col("content"), "See Also", F.lit("- [[x]]"))).alias("content_hash"))


def source_totals(spark, sf_dir):
    return process.totals(vault(spark, sf_dir))


def index_refresh_plan(spark, sf_dir):
    return index_drift(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


def rename_counts(spark, sf_dir):
    return notes.rename_counts(vault(spark, sf_dir))


def invalid_counts(spark, sf_dir):
    sources = vault(spark, sf_dir).select(F.col("doc_id").alias("source_id"), "content")
    return extract.outcomes(sources, _replies(spark, sf_dir), 300).select("source_id", "n_chunks", "n_invalid_chunks", "n_invalid_items", "n_concepts")


def non_extractable(spark, sf_dir):
    return vault(spark, sf_dir).select("doc_id", T.is_non_extractable(F.col("content")).alias("non_extractable"))


def _pieces(df, chunks):
    """(doc_id, pos, n_chars, chunk_hash) of an array of chunks."""
    df = df.select("doc_id", F.posexplode(chunks).alias("pos", "chunk"))
    return df.select("doc_id", F.col("pos").cast("long").alias("pos"), F.length("chunk").cast("long").alias("n_chars"), T.content_hash(F.col("chunk")).alias("chunk_hash"))


def chunk_sizes(spark, sf_dir):
    return _pieces(vault(spark, sf_dir), source_chunks(F.col("content"), TARGET, CAP))


def chunk_paragraphs(spark, sf_dir):
    return _pieces(_table(spark, sf_dir, "documents"), section_chunks(F.coalesce("text", F.lit("")), 400))


def chunk_headings(spark, sf_dir):
    return _pieces(vault(spark, sf_dir), sections(T.strip(F.col("content"))))


def chunk_headings_reference_mode(spark, sf_dir):
    return _pieces(vault(spark, sf_dir), source_chunks(F.col("content"), TARGET, CAP, repeat=True))


def title_dedupe(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", "source", F.substring_index("text", "\n", 1).alias("title"))
    return vectors.title_dedupe(rows, "source", "title", "doc_id").select("doc_id", "source")


def _vectors(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def greedy_vector_dedupe(spark, sf_dir):
    return vectors.greedy_dedupe(_vectors(spark, sf_dir), "label", 0.6)


def _similar(metric, max_distance=None):
    def query(spark, sf_dir):
        v = _vectors(spark, sf_dir)
        return vectors.find_similar(v, v.where("id % 20 = 0"), 5, max_distance, metric)

    return query


def collisions(spark, sf_dir):
    return notes.collisions(vault(spark, sf_dir)).select("note_id", F.array_join("files", ",").alias("files"))


def merged_entries(spark, sf_dir):
    return notes.entries(vault(spark, sf_dir)).select("note_id", T.content_hash(F.col("document")).alias("content_hash"))


def _stored(spark, sf_dir):
    """An index of an earlier state: some entries missing, some changed, some extra."""
    e = notes.entries(vault(spark, sf_dir)).withColumn("n", F.length("document"))
    changed = F.when(F.col("n") % 5 == 0, F.concat("document", F.lit("!"))).otherwise(F.col("document"))
    old = e.where("n % 7 != 0").select("note_id", changed.alias("document"))
    return old.union(e.where("n % 11 = 0").select(F.concat(F.lit("old-"), "note_id"), "document"))


def index_drift(spark, sf_dir):
    index = _stored(spark, sf_dir).select("note_id", T.content_hash(F.col("document")).alias("content_hash"))
    return vectors.drift(notes.entries(vault(spark, sf_dir)), index)


def index_after_refresh(spark, sf_dir):
    """The index goes through the store: an older version is committed, then a refreshed one, and the latest is read."""
    store, c = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"), F.col("document")
    store.commit("index", _stored(spark, sf_dir).select("note_id", "document", T.content_hash(c).alias("content_hash"), vectors.keyword_embedding(c).alias("embedding")))
    store.commit("index", vectors.refreshed(notes.entries(vault(spark, sf_dir)), store.read("index")))
    return store.read("index").select("note_id", "content_hash", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def collection_names(spark, sf_dir):
    df = _table(spark, sf_dir, "documents").select("source", "lang").distinct()
    return df.select("source", "lang", T.collection_name(F.concat(F.lit(" "), "source"), F.concat(F.col("lang"), F.lit("-Model.v1/"))).alias("collection"))


def missing_backlinks(spark, sf_dir):
    return notes.missing_backlinks(vault(spark, sf_dir))


def see_also_migration(spark, sf_dir):
    return notes.links(notes.migrate_see_also(vault(spark, sf_dir)), "tag").select("stem", F.col("pos").cast("long").alias("pos"), "target")


def normalize_plan(spark, sf_dir):
    return notes.normalize_plan(vault(spark, sf_dir)).select("stem", "n_changed", "n_duplicates", F.array_join("tags", ",").alias("tags"))


def rename_plan(spark, sf_dir):
    return notes.rename_plan(vault(spark, sf_dir)).select("note_id", "action", F.array_join("files", ",").alias("files"))


def normalized_notes(spark, sf_dir):
    return notes.normalized(vault(spark, sf_dir)).select("stem", T.content_hash(F.col("content")).alias("content_hash"))


def renamed_notes(spark, sf_dir):
    """Notes under their ids; of files with one id the one with the larger doc_id is the older."""
    return notes.renamed(vault(spark, sf_dir).withColumn("mtime", -F.col("doc_id"))).select("stem", T.content_hash(F.col("content")).alias("content_hash"))


def source_notes(spark, sf_dir):
    return notes.notes_of_source(vault(spark, sf_dir), "src3").select("doc_id", "note_id")


def _seeds(spark, sf_dir):
    return notes.with_ids(vault(spark, sf_dir)).where("doc_id in (2, 7)").select("note_id", (F.col("doc_id") - 2).alias("ord"))


def reach_by_degree(spark, sf_dir):
    return graph.reach(vault(spark, sf_dir), _seeds(spark, sf_dir), 3).select("note_id", F.col("degree").cast("long").alias("degree"))


def reach_order(spark, sf_dir):
    return graph.reach(vault(spark, sf_dir), _seeds(spark, sf_dir), 3).select("note_id", F.col("degree").cast("long").alias("degree"), "ord")


def _rows_hashed(rows):
    return rows.select(F.col("degree").cast("long").alias("degree"), F.col("ord").cast("long").alias("ord"), "note_id", "rendered", T.content_hash(F.col("content")).alias("content_hash"))


def bundle_rows(spark, sf_dir):
    v = vault(spark, sf_dir)
    return _rows_hashed(graph.bundle_rows(v, graph.note_seeds(v, "doc-000004"), 2))


def bundle_text(spark, sf_dir):
    return graph.note_bundle(vault(spark, sf_dir), "doc-000004", 2, "2025-01-01 00:00").select("content")


def bundle_metadata(spark, sf_dir):
    """The metadata of the bundles around all notes, made at once."""
    v = vault(spark, sf_dir)
    seeds, counts = graph.all_note_seeds(v, notes.with_ids(v).select(F.col("note_id").alias("bundle")))
    return graph.metadata(graph.all_bundle_rows(v, seeds, 2), counts)


def source_bundles(spark, sf_dir):
    """Digests of the bundles of all sources, made at once, each with the notes that are near to its first text."""
    v = vault(spark, sf_dir)
    first = kept(v.groupBy("source").agg(F.min_by("text", "doc_id").alias("content")).select(F.col("source").alias("source_id"), "content"), "sources")
    index = kept(notes.entries(v).select("note_id", vectors.keyword_embedding(F.col("document")).alias("embedding")), "index")
    made = graph.digests(graph.source_parts(v, first, index, 1, "2025-01-01 00:00", 4, 60.0))
    return made.select(F.col("bundle").alias("source"), "n_chars", "content_hash")


def note_render(spark, sf_dir):
    c = F.col("content")
    note = T.render_note(F.concat(F.lit("Note "), "doc_id"), F.col("text"), T.tag_links(c), T.see_also_links(c), F.col("source"), TEMPLATE, F.lit("2025-01-02 03:04:05").cast("timestamp"))
    return vault(spark, sf_dir).select("doc_id", T.content_hash(note).alias("content_hash"))


def _sources(spark, sf_dir):
    return vault(spark, sf_dir).select(F.col("doc_id").alias("source_id"), "content")


def _replies(spark, sf_dir):
    """Every chunk of every source, sent to the extractor that needs no model."""
    return extract.extracted(_sources(spark, sf_dir), runner.extractor("outline", delay=0.0, retries=1), TARGET, CAP)


def payload_items(spark, sf_dir):
    replies = extract.payload_items(_replies(spark, sf_dir))
    return replies.select("source_id", F.col("chunk_pos").cast("long").alias("chunk_pos"), "status", "valid", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"))


def concept_validation(spark, sf_dir):
    return extract.concepts(_replies(spark, sf_dir)).select("source_id", F.col("chunk_pos").cast("long").alias("chunk_pos"), "title", F.col("ok"), F.array_join("tags", ",").alias("tags"))


def source_outcomes(spark, sf_dir):
    return extract.outcomes(_sources(spark, sf_dir), kept(_replies(spark, sf_dir), "replies"), 300)


def outcome_summary(spark, sf_dir):
    return extract.summary(source_outcomes(spark, sf_dir))


def invalid_counts(spark, sf_dir):
    return source_outcomes(spark, sf_dir).select("source_id", "n_chunks", "n_invalid_chunks", "n_invalid_items", "n_concepts")


def duplicate_reason(spark, sf_dir):
    """A concept of each document, some under the title of a note, against the vault and its index."""
    v = vault(spark, sf_dir)
    concepts = v.select(F.col("doc_id").alias("id"), F.concat(F.when(F.length("text") % 3 == 0, "Doc ").otherwise("Idea "), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("title"), F.col("text").alias("content"))
    index = notes.entries(v).select("note_id", vectors.keyword_embedding(F.col("document")).alias("embedding"))
    return process.duplicate_reasons(concepts, v, index, 0.9)


def process_concepts(spark, sf_dir):
    """The concepts that the ingest job finds in all documents, with the reasons of those that it leaves out."""
    sources = _table(spark, sf_dir, "documents").select(F.concat(F.lit("src-"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("source_id"), F.coalesce("text", F.lit("")).alias("content"))
    none = spark.createDataFrame([], "stem string, content string")
    index = spark.createDataFrame([], "note_id string, document string, content_hash string, embedding array<double>")
    settings = process.Settings(TEMPLATE, target=TARGET, cap=CAP, duplicate=DUPLICATE)
    done = process.process(sources, none, index, runner.extractor("outline", delay=0.0, retries=1), settings, F.lit("2025-01-02 03:04:05").cast("timestamp"))
    return done.concepts


# The same rows in DuckDB's SQL.

_ID = (
    "lower(substr(regexp_replace(regexp_replace(trim(regexp_replace(string_split({0}, '|')[-1], '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), ' ' || chr(9) || chr(10)), "
    "'[\\s_]+', '-', 'g'), '-+', '-', 'g'), 1, 100))"
)
_LINK = r"'\[\[([^\]]+)\]\]'"
_TAG_LINE = r"regexp_extract(content, '(?m)^Tags:([^\n]*)$', 1)"
_TAGS = f"regexp_extract_all({_TAG_LINE}, {_LINK}, 1)"


def _section(heading: str) -> str:
    return f"case when instr(content, chr(10) || '# {heading}' || chr(10)) > 0 then string_split(string_split(content, chr(10) || '# {heading}' || chr(10))[2], chr(10) || '# ')[1] else '' end"


def _id(x: str) -> str:
    return _ID.format(x)


def _v(select: str, more: str = "") -> str:
    return f"with {more and more + ', '}v as ({VAULT_SQL}) {select}"


def _link_rows(found: str) -> str:
    return _v(f"select stem, pos - 1 as pos, l[pos] as raw, {_id('l[pos]')} as target from (select stem, l, unnest(range(1, len(l) + 1)) as pos from (select stem, {found} as l from v))")


_LAST = f"last as (select * from (select *, {_id('stem')} as note_id, row_number() over (partition by {_id('stem')} order by stem desc) as r from v) where r = 1)"
_ENTRIES = f"e as (select {_id('stem')} as note_id, string_agg(trim(content, ' ' || chr(9) || chr(10)), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by stem) as document from v group by 1)"
_STATUS = r"(regexp_matches(regexp_extract(content, '(?m)^Status:([^\n]*)$', 1), '(^|\s)#processed(\s|$)') or regexp_matches(content, '\n#processed\s*$'))"
_NONE = (
    "((" + " + ".join(f"cast(contains(lower(content), '{k}') as int)" for k in T.KEYWORDS) + ") >= 2 or (select count(*) filter (where "
    + " or ".join(f"starts_with(x, '{s}')" for s in T.LIST_STARTS)
    + ") >= 0.6 * count(*) from (select trim(unnest(string_split(content, chr(10)))) as x) where x != ''))"
)
_EDGES = f"edges as (select note_id, unnest(range(len(l))) as pos, {_id('unnest(l)')} as target from (select note_id, {_TAGS} as l from last))"
_STORED = "stored as (select note_id, document || (case when length(document) % 5 = 0 then '!' else '' end) as document from e where length(document) % 7 != 0 union all select 'old-' || note_id, document from e where length(document) % 11 = 0)"
_EMB = " + ".join(f"(length(document) - length(replace(lower(document), '{t}', ''))) / {len(t)}" for t in vectors.TERMS) + " + length(document) / 1000.0"


def _distinct(xs: str) -> str:
    ids = f"list_filter(list_transform({xs}, lambda x: {_id('x')}), lambda x: x != '')"
    return f"list_filter({ids}, lambda x, i: list_position({ids}, x) = i)"


_WS_SQL = "' ' || chr(9) || chr(10)"


def _pack_sql(parts: str, sep: str, cap: int, n: str) -> str:
    """Chunks of a list of strings, as pack makes them; n tells nested names apart."""
    s, t = f"s{n}", f"t{n}"
    joined = f"{s}.cur || {sep} || {t}.cur"
    full = f"{s}.cur != '' and length({joined}) > {cap}"
    fold = (
        f"list_reduce(list_transform({parts}, lambda p{n}: {{'out': cast([] as varchar[]), 'cur': p{n}}}), lambda {s}, {t}: "
        f"{{'out': case when {full} then list_append({s}.out, {s}.cur) else {s}.out end, 'cur': case when {full} or {s}.cur = '' then {t}.cur else {joined} end}})"
    )
    return f"list_filter(list_transform(list_transform([{fold}], lambda r{n}: list_append(r{n}.out, r{n}.cur))[1], lambda c{n}: trim(c{n}, {_WS_SQL})), lambda d{n}: d{n} != '')"


def _paragraph_sql(p: str, cap: int, n: str) -> str:
    sentences = f"string_split(regexp_replace({p}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    cut = f"list_transform(range(0, (length(q{n}) - 1) // {cap} + 1), lambda k{n}: trim(substr(q{n}, k{n} * {cap} + 1, {cap}), {_WS_SQL}))"
    pieces = f"flatten(list_transform({_pack_sql(sentences, chr(39) + ' ' + chr(39), cap, n + 'a')}, lambda q{n}: case when length(q{n}) <= {cap} then [q{n}] else {cut} end))"
    return f"case when length({p}) <= {cap} then [{p}] else list_filter({pieces}, lambda z{n}: z{n} != '') end"


def _section_sql(section: str, cap: int, n: str) -> str:
    paragraphs = f"list_transform(regexp_split_to_array(trim({section}, {_WS_SQL}), '\\n\\s*\\n'), lambda g{n}: trim(g{n}, {_WS_SQL}))"
    return _pack_sql(f"flatten(list_transform({paragraphs}, lambda h{n}: {_paragraph_sql('h' + n, cap, n + 'b')}))", "chr(10) || chr(10)", cap, n + "c")


_SECTIONS = f"list_filter(list_transform(string_split(regexp_replace(trim(content, {_WS_SQL}), '(?m)^(#{{1,6}}\\s+.*)$', chr(1) || '\\1', 'g'), chr(1)), lambda x: trim(x, {_WS_SQL})), lambda x: x != '')"


def _chunks_sql(repeat: bool = False) -> str:
    """CTEs after v: chunked (doc_id, content, text, source, stem, chunks)."""
    again = "ss[: len(ss) - 1] || list_filter(ss, lambda x: regexp_matches(x, '^#{1,6}\\s'))" if repeat else "ss"
    headed = f"flatten(list_transform(ss, lambda w: case when length(w) > {CAP} then {_section_sql('w', CAP, 'm')} else [w] end))"
    parts = f"case when regexp_matches(t, '(?m)^#{{1,6}}\\s+.*$') then {headed} else {_section_sql('t', CAP, 'n')} end"
    return (
        f"cut as (select *, trim(content, {_WS_SQL}) as t, {_SECTIONS} as ss from v), twice as (select * replace ({again} as ss) from cut), parted as (select *, {parts} as parts from twice), "
        f"chunked as (select *, case when length(t) <= {CAP} then [t] else {_pack_sql('parts', 'chr(10) || chr(10)', TARGET, 'k')} end as chunks from parted)"
    )


def _piece_rows(table: str, chunks: str) -> str:
    return f"select doc_id, pos - 1 as pos, length(l[pos]) as n_chars, sha256(l[pos]) as chunk_hash from (select doc_id, l, unnest(range(1, len(l) + 1)) as pos from (select doc_id, {chunks} as l from {table}))"


def _replies_sql() -> str:
    """CTEs: v, chunked, and asked (doc_id, content, chunk_pos, chunk, form, word)."""
    return (
        f"with v as ({VAULT_SQL}), {_chunks_sql()}, each as (select doc_id, content, unnest(range(len(chunks))) as chunk_pos, unnest(chunks) as chunk from chunked), "
        "asked as (select *, length(chunk) % 7 as form, regexp_extract(chunk, '[a-z]+') as word from each)"
    )


_ITEMS = (
    "items as (select doc_id, chunk_pos, word as title, word != '' as ok, word || ',words' as tags from asked where form in (0, 1) "
    "union all select doc_id, chunk_pos, word, false, word from asked where form = 1 union all select doc_id, chunk_pos, '1', false, word || ',words' from asked where form = 5)"
)
_OUTCOMES = (
    f"{_ITEMS}, judged as (select doc_id, count(*) as n_chunks, count(*) filter (where form in (2, 3, 4)) as n_invalid_chunks, count(*) filter (where form = 3) as n_errors from asked group by 1), "
    "counted as (select doc_id, count(*) filter (where not ok) as n_invalid_items, count(*) filter (where ok) as n_concepts from items group by 1), "
    "both_ as (select v.doc_id, v.content, n_chunks, n_invalid_chunks, n_errors, coalesce(n_invalid_items, 0) as n_invalid_items, coalesce(n_concepts, 0) as n_concepts from v left join judged using (doc_id) left join counted using (doc_id)), "
    f"found as (select doc_id as source_id, case when {_STATUS} then 'already_processed' when length(trim(content, {_WS_SQL})) < 300 then 'too_short' when n_concepts > 0 then 'created' "
    "when n_errors > 0 and n_errors = n_invalid_chunks and n_invalid_items = 0 then 'provider_error' when n_invalid_chunks > 0 or n_invalid_items > 0 then 'invalid_output' "
    f"when {_NONE} then 'non_extractable' else 'no_valid_concepts' end as outcome, n_chunks, n_invalid_chunks, n_invalid_items, n_concepts from both_)"
)


def _reach_sql(depth: int) -> str:
    """CTEs after v, last, edges and seeds (bundle, note_id, ord): reached (bundle, note_id, degree, ord), level by level."""
    out, seen = [], ["select bundle, note_id from seeds"]
    for d in range(1, depth + 1):
        before = "seeds" if d == 1 else f"level{d - 1}"
        out.append(
            f"seen{d} as ({' union '.join(seen)}), step{d} as (select l.bundle, e.target as note_id, min(l.ord * 100000 + e.pos) as path from {before} l join edges e on e.note_id = l.note_id "
            f"where e.target in (select note_id from last) and not exists (select 1 from seen{d} s where s.bundle = l.bundle and s.note_id = e.target) group by 1, 2), "
            f"level{d} as (select bundle, note_id, row_number() over (partition by bundle order by path) - 1 as ord from step{d})"
        )
        seen.append(f"select bundle, note_id from level{d}")
    return ", ".join(out) + ", reached as (" + " union all ".join(f"select bundle, note_id, {d} as degree, ord from level{d}" for d in range(1, depth + 1)) + ")"


_SEE = f"regexp_extract_all({_section('See Also')}, {_LINK}, 1)"
_IDS_SQL = lambda xs: f"list_transform({xs}, lambda x: {_id('x')})"
_NOTE_SEEDS = (
    f"own as (select note_id, {_IDS_SQL(_TAGS)} as tags, {_IDS_SQL(_SEE)} as see from (select *, {_id('stem')} as note_id, row_number() over (partition by {_id('stem')} order by stem != {_id('stem')}, stem) as r from v) where r = 1), "
    "all_ids as (select note_id, [note_id] || tags || see as ids, len(tags) as direct_tags, len(see) as direct_similar_notes from own), "
    "seed_lists as (select *, list_filter(ids, lambda x, i: list_position(ids, x) = i) as firsts from all_ids), "
    "every_seed as (select note_id as bundle, unnest(firsts) as note_id, unnest(range(len(firsts))) as ord from seed_lists)"
)
_BUNDLE_ROWS = (
    f"listed as (select bundle, note_id, 0 as degree, ord from seeds union all select bundle, note_id, degree, ord from reached), "
    f"shown as (select bundle, degree, ord, l.note_id, v.stem is not null as rendered, rtrim(v.content, {_WS_SQL}) as content from listed l left join v on v.stem = l.note_id)"
)


def _bundles_sql(depth: int, seeds: str) -> str:
    """CTEs up to shown (bundle, degree, ord, note_id, rendered, content)."""
    return f"with v as ({VAULT_SQL}), {_LAST}, {_EDGES}, {seeds}, {_reach_sql(depth)}, {_BUNDLE_ROWS}"


_SEEN = "described as (select bundle, count(*) filter (where degree > 0) as traversed_notes, count(*) filter (where rendered) as total_notes, max(degree) as max_depth from shown group by 1)"
_BODIES = (
    "degrees as (select bundle, degree, '### Degree ' || degree || chr(10) || chr(10) || string_agg(case when rendered then '#### ' || note_id || chr(10) || chr(10) || content || chr(10) || chr(10) else '' end, '' order by ord) as text from shown group by 1, 2), "
    "bodies as (select bundle, string_agg(text, '' order by degree) as body from degrees group by 1)"
)


def _text_sql(source_text: str) -> str:
    counts = " || ".join(f"'{shown}: ' || {c} || chr(10)" for c, shown in graph.COUNTS)
    return (
        f"'# Bundle: ' || bundle || chr(10) || 'Generated: 2025-01-01 00:00' || chr(10) || chr(10) || {source_text} || '## Connected Knowledge' || chr(10) || chr(10) || body || "
        f"'## Metadata' || chr(10) || chr(10) || 'Source: [[' || bundle || ']]' || chr(10) || {counts}"
    )


_VECTOR = lambda text: "[" + ", ".join(f"cast((length({text}) - length(replace(lower({text}), '{t}', ''))) / {len(t)} as double)" for t in vectors.TERMS) + f", length({text}) / 1000.0]"
_SQUARED = "list_sum(list_transform(list_zip(q.v, n.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _similar_sql(metric: str, max_distance: float | None = None) -> str:
    d = "list_cosine_distance(a.v, b.v)" if metric == "cosine" else "list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    cut = f" and distance <= {max_distance}" if max_distance else ""
    return (
        "with e as (select vec_id as id, cast(embedding as double[]) as v from embeddings), "
        f"d as (select a.id as query_id, b.id as id, round({d}, 6) as distance from e a, e b where a.id % 20 = 0) "
        "select query_id, cast(rank as integer) as rank, id, distance from (select *, row_number() over (partition by query_id order by distance, id) as rank from d) "
        f"where rank <= 5{cut}"
    )


def _source_bundles_sql() -> str:
    seeds = (
        f"own as (select source as bundle, {_id('stem')} as note_id, stem from v), {_ENTRIES}, n as (select note_id, {_VECTOR('document')} as v from e), q as (select source as bundle, arg_min(text, doc_id) as text, {_VECTOR('arg_min(text, doc_id)')} as v from v group by 1), "
        f"near as (select *, row_number() over (partition by bundle order by d, note_id) as rank from (select q.bundle, n.note_id, round({_SQUARED}, 6) as d from q, n)), "
        "more as (select bundle, note_id, rank from near where rank <= 4 and d <= 60.0 and not exists (select 1 from own where own.bundle = near.bundle and own.note_id = near.note_id)), "
        "placed as (select bundle, note_id, 0 as part, min(stem) as stem, 0 as rank from own group by 1, 2 union all select bundle, note_id, 1, '', rank from more), "
        "seeds as (select bundle, note_id, row_number() over (partition by bundle order by part, stem, rank) - 1 as ord from placed)"
    )
    counts = "counts as (select q.bundle, q.text, (select count(*) from own where own.bundle = q.bundle) as source_notes, 0 as direct_tags, (select count(*) from more where more.bundle = q.bundle) as direct_similar_notes from q)"
    text = _text_sql("'## Source Content' || chr(10) || chr(10) || text || chr(10) || chr(10)")
    return (
        f"{_bundles_sql(1, seeds)}, {_SEEN}, {_BODIES}, {counts}, made as (select bundle, {text} as content from counts join described using (bundle) join bodies using (bundle)) "
        "select bundle as source, length(content) as n_chars, sha256(content) as content_hash from made"
    )


def _duplicate_sql() -> str:
    title = "case when length(text) % 3 = 0 then 'doc-' else 'idea-' end || lpad(cast(doc_id as varchar), 6, '0')"
    return (
        f"with v as ({VAULT_SQL}), {_ENTRIES}, n as (select note_id, {_VECTOR('document')} as v from e), q as (select doc_id as id, {title} as file, {_VECTOR('text')} as v from v), "
        f"near as (select id, arg_min(note_id, (d, note_id)) as twin, min(d) as d from (select q.id, n.note_id, round({_SQUARED}, 6) as d from q, n) group by 1) "
        "select q.id, case when exists (select 1 from v where v.stem = q.file) then 'file exists: ' || q.file || '.md' when near.d <= 0.9 then 'too similar to: ' || near.twin end as reason from q join near using (id)"
    )


def _queries() -> dict[str, tuple[Callable, str | None]]:
    tags_text = lambda xs: f"rtrim('Tags: ' || coalesce(list_aggregate(list_transform({xs}, lambda y: '[[' || y || ']]'), 'string_agg', ' '), ''))"
    removed = r"trim(regexp_replace(content || chr(1), '\n*# See Also\n[^#]*', chr(10)), ' ' || chr(9) || chr(10) || chr(1)) || chr(10)"
    return {
        "note_ids": (note_ids, _v(f"select doc_id, {_id('stem')} as note_id from v")),
        "tag_links": (_links("tag"), _link_rows(_TAGS)),
        "see_also_links": (_links("see_also"), _link_rows(f"regexp_extract_all({_section('See Also')}, {_LINK}, 1)")),
        "reference_links": (_links("reference"), _link_rows(f"regexp_extract_all({_section('References')}, {_LINK}, 1)")),
        "processed_flags": (processed_flags, _v(f"select doc_id, {_STATUS} as processed from v")),
        "mark_processed": (mark_processed, _v(f"select doc_id, sha256(case when {_STATUS} then content when regexp_matches(content, '(?m)^Status:') then regexp_replace(content, '(?m)^(Status:[^\\n]*)', '\\1 #processed') else rtrim(content, ' ' || chr(9) || chr(10)) || chr(10) || chr(10) || 'Status: #processed' || chr(10) end) as content_hash from v")),
        "content_hashes": (content_hashes, "select doc_id, sha256(text) as content_hash from documents"),
        "see_also_removed": (see_also_removed, _v(f"select doc_id, sha256({removed}) as content_hash from v")),
        "tag_line_rewrite": (tag_line_rewrite, _v(f"select doc_id, sha256(regexp_replace(content, '(?m)^Tags:[^\\n]*$', {tags_text(_distinct(_TAGS))}, 'g')) as content_hash from v")),
        "section_replaced": (section_replaced, _v("select doc_id, sha256(rtrim(case when instr(content, chr(10) || '# See Also' || chr(10)) > 0 then string_split(content, chr(10) || '# See Also' || chr(10))[1] || chr(10) else substr(content, 1, instr(content, chr(10) || '# References' || chr(10))) end || '# See Also' || chr(10) || chr(10) || '- [[x]]' || chr(10) || chr(10) || substr(content, instr(content, chr(10) || '# References' || chr(10)) + 1), ' ' || chr(9) || chr(10)) || chr(10)) as content_hash from v")),
        "source_totals": (source_totals, _v(f"select count(*) as n_sources, count(*) filter (where {_STATUS}) as n_processed, count(*) filter (where not {_STATUS}) as n_unprocessed from v")),
        "index_refresh_plan": (index_refresh_plan, f"with v as ({VAULT_SQL}), {_ENTRIES}, {_STORED} select case when e.note_id is null then 'extra' else 'missing_or_stale' end as status, count(*) as n from e full join stored s on e.note_id = s.note_id where e.document is distinct from s.document group by 1"),
        "rename_counts": (rename_counts, _v(f"select count(*) filter (where n = 1 and stem != note_id) as n_renamed, count(*) filter (where n > 1) as n_merged, cast(coalesce(sum(n - own) filter (where n > 1), 0) as bigint) as n_deleted from (select {_id('stem')} as note_id, count(*) as n, min(stem) as stem, max(cast(stem = {_id('stem')} as int)) as own from v group by 1)")),
        "invalid_counts": (invalid_counts, f"{_replies_sql()}, {_OUTCOMES} select source_id, n_chunks, n_invalid_chunks, n_invalid_items, n_concepts from found"),
        "non_extractable": (non_extractable, _v(f"select doc_id, {_NONE} as non_extractable from v")),
        "chunk_sizes": (chunk_sizes, f"with v as ({VAULT_SQL}), {_chunks_sql()} {_piece_rows('chunked', 'chunks')}"),
        "chunk_paragraphs": (chunk_paragraphs, _piece_rows("documents", _section_sql("coalesce(text, '')", 400, "y"))),
        "chunk_headings": (chunk_headings, _v(_piece_rows("v", _SECTIONS))),
        "chunk_headings_reference_mode": (chunk_headings_reference_mode, f"with v as ({VAULT_SQL}), {_chunks_sql(True)} {_piece_rows('chunked', 'chunks')}"),
        "title_dedupe": (title_dedupe, f"select min(doc_id) as doc_id, source from (select doc_id, source, {_id('string_split(text, chr(10))[1]')} as t from documents) group by source, t"),
        "greedy_vector_dedupe": (greedy_vector_dedupe, "with recursive e as (select label, vec_id as id, cast(embedding as double[]) as v, row_number() over (partition by label order by vec_id) as r from embeddings), g as (select label, cast(0 as bigint) as r, cast([] as struct(id bigint, v double[])[]) as kept from e group by 1 union all select g.label, g.r + 1, case when len(list_filter(g.kept, lambda k: list_cosine_distance(k.v, e.v) <= 0.6)) > 0 then g.kept else list_append(g.kept, {'id': e.id, 'v': e.v}) end from g join e on e.label = g.label and e.r = g.r + 1) select label, unnest(list_transform(kept, lambda k: k.id)) as id from (select label, arg_max(kept, r) as kept from g group by 1)"),
        "similar_topk_l2": (_similar("l2sq"), _similar_sql("l2sq")),
        "similar_topk_cosine": (_similar("cosine"), _similar_sql("cosine")),
        "similar_cutoff": (_similar("cosine", 0.62), _similar_sql("cosine", 0.62)),
        "collisions": (collisions, _v(f"select {_id('stem')} as note_id, string_agg(stem, ',' order by stem) as files from v group by 1 having count(*) > 1")),
        "merged_entries": (merged_entries, _v("select note_id, sha256(document) as content_hash from e").replace(") select", f"), {_ENTRIES} select", 1)),
        "index_drift": (index_drift, f"with v as ({VAULT_SQL}), {_ENTRIES}, {_STORED} select coalesce(e.note_id, s.note_id) as note_id, case when e.note_id is null then 'extra' else 'missing_or_stale' end as status from e full join stored s on e.note_id = s.note_id where e.document is distinct from s.document"),
        "index_after_refresh": (index_after_refresh, f"with v as ({VAULT_SQL}), {_ENTRIES} select note_id, sha256(document) as content_hash, round({_EMB}, 6) as total from e"),
        "collection_names": (collection_names, "select distinct source, lang, 'zettels__' || source || '__' || lang || '_model_v1' as collection from documents"),
        "missing_backlinks": (missing_backlinks, f"with v as ({VAULT_SQL}), {_LAST}, {_EDGES}, a as (select distinct {_id('stem')} as backlink, {_id('unnest(l)')} as target from (select stem, {_TAGS} as l from v)) select target, backlink from a where target in (select note_id from last) and not exists (select 1 from edges where edges.note_id = a.target and edges.target = a.backlink)"),
        "see_also_migration": (see_also_migration, _v(f"select stem, pos - 1 as pos, l[pos] as target from (select stem, l, unnest(range(1, len(l) + 1)) as pos from (select stem, t || list_filter(list_filter(s, lambda x, i: list_position(s, x) = i), lambda x: not list_contains(t, x)) as l from (select stem, list_transform({_TAGS}, lambda x: {_id('x')}) as t, list_transform(regexp_extract_all({_section('See Also')}, {_LINK}, 1), lambda x: {_id('x')}) as s from v)))")),
        "normalize_plan": (normalize_plan, _v(f"select stem, cast(len(list_filter(list_zip(l, i), lambda z: z[1] != z[2])) as bigint) as n_changed, cast(len(i) - len(d) as bigint) as n_duplicates, list_aggregate(d, 'string_agg', ',') as tags from (select *, list_filter(i, lambda x, k: list_position(i, x) = k) as d from (select stem, l, list_transform(l, lambda x: {_id('x')}) as i from (select stem, {_TAGS} as l from v) where len(l) > 0)) where l != d")),
        "rename_plan": (rename_plan, _v(f"select * from (select {_id('stem')} as note_id, case when count(*) > 1 then 'merge' when min(stem) != {_id('stem')} then 'rename' end as action, string_agg(stem, ',' order by stem) as files from v group by 1) where action is not null")),
        "normalized_notes": (normalized_notes, _v(f"select stem, sha256(case when len(l) > 0 and l != d then regexp_replace(content, '(?m)^Tags:[^\\n]*$', rtrim('Tags: ' || list_aggregate(list_transform(d, lambda y: '[[' || y || ']]'), 'string_agg', ' ')), 'g') else content end) as content_hash from (select *, list_filter(i, lambda x, k: list_position(i, x) = k) as d from (select stem, content, l, list_transform(l, lambda x: {_id('x')}) as i from (select stem, content, {_TAGS} as l from v)))")),
        "renamed_notes": (renamed_notes, _v(f"select stem, sha256(case when n > 1 then merged || chr(10) else content end) as content_hash from (select {_id('stem')} as stem, count(*) as n, min(content) as content, string_agg(trim(content, {_WS_SQL}), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by doc_id desc) as merged from v group by 1)")),
        "source_notes": (source_notes, _v(f"select doc_id, {_id('stem')} as note_id from v where source = 'src3'")),
        "reach_by_degree": (reach_by_degree, f"with recursive v as ({VAULT_SQL}), {_LAST}, {_EDGES}, seeds as (select {_id('stem')} as note_id from v where doc_id in (2, 7)), walk as (select note_id, 0 as degree from seeds union select e.target, w.degree + 1 from walk w join edges e on e.note_id = w.note_id where w.degree < 3 and e.target in (select note_id from last)) select note_id, cast(min(degree) as bigint) as degree from walk where note_id not in (select note_id from seeds) group by 1"),
        "reach_order": (reach_order, f"with v as ({VAULT_SQL}), {_LAST}, {_EDGES}, seeds as (select '' as bundle, {_id('stem')} as note_id, doc_id - 2 as ord from v where doc_id in (2, 7)), {_reach_sql(3)} select note_id, cast(degree as bigint) as degree, ord from reached"),
        "bundle_rows": (bundle_rows, f"{_bundles_sql(2, _NOTE_SEEDS + ', seeds as (select * from every_seed where bundle = ' + chr(39) + 'doc-000004' + chr(39) + ')')} select cast(degree as bigint) as degree, ord, note_id, rendered, sha256(content) as content_hash from shown"),
        "bundle_metadata": (bundle_metadata, f"{_bundles_sql(2, _NOTE_SEEDS + ', seeds as (select * from every_seed)')}, {_SEEN} select bundle, cast(1 as bigint) as source_notes, direct_tags, direct_similar_notes, traversed_notes, total_notes, cast(max_depth as bigint) as max_depth from seed_lists join described on bundle = note_id"),
        "bundle_text": (bundle_text, f"{_bundles_sql(2, _NOTE_SEEDS + ', seeds as (select * from every_seed where bundle = ' + chr(39) + 'doc-000004' + chr(39) + ')')}, {_SEEN}, {_BODIES} select {_text_sql(chr(39) * 2)} as content from (select *, 1 as source_notes from described join bodies using (bundle) join seed_lists on note_id = bundle)"),
        "source_bundles": (source_bundles, _source_bundles_sql()),
        "note_render": (note_render, _v(f"select doc_id, sha256('# Note ' || doc_id || chr(10) || chr(10) || trim(text, ' ' || chr(9) || chr(10)) || chr(10) || chr(10) || {tags_text(_distinct(_TAGS))} || chr(10) || 'Written on 02-01-2025 at 03:04' || chr(10) || chr(10) || '# See Also' || coalesce(chr(10) || chr(10) || list_aggregate(list_transform({_distinct(f'regexp_extract_all({_section("See Also")}, {_LINK}, 1)')}, lambda y: '- [[' || y || ']]'), 'string_agg', chr(10)), '') || chr(10) || chr(10) || '# References' || chr(10) || chr(10) || '1. [[' || source || ']]' || chr(10)) as content_hash from v")),
        "payload_items": (payload_items, f"{_replies_sql()} select doc_id as source_id, chunk_pos, case when form = 3 then 'provider_error' else 'ok' end as status, form in (0, 1, 5, 6) as valid, cast(case form when 0 then 1 when 1 then 2 when 5 then 1 else 0 end as bigint) as n_items from asked"),
        "concept_validation": (concept_validation, f"{_replies_sql()}, {_ITEMS} select doc_id as source_id, chunk_pos, title, ok, tags from items"),
        "source_outcomes": (source_outcomes, f"{_replies_sql()}, {_OUTCOMES} select * from found"),
        "duplicate_reason": (duplicate_reason, _duplicate_sql()),
        "process_concepts": (process_concepts, None),
        "outcome_summary": (outcome_summary, f"{_replies_sql()}, {_OUTCOMES} select o.outcome, count(f.outcome) as n from (select unnest({list(extract.OUTCOMES)!r}) as outcome) o left join found f on o.outcome = f.outcome group by 1"),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _queries().items() if sql}
