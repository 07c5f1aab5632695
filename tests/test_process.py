"""The ingest job and its bundle on small vaults, with a scripted extractor and the counting embedding."""

import json

import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import extract, graph, notes, vectors
from skein.operators.process import Settings, process, taken, totals

SETTINGS = Settings("# {{Title}}\n\nTags:\nOn {{date}}\n\n# References\n", min_chars=20, target=120, cap=160, duplicate=0.15)
at = lambda: F.lit("2025-01-02 03:04:05").cast("timestamp")


def counting(text):
    low = F.lower(text)
    count = lambda t: ((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)).cast("double")
    return F.array(*map(count, "lbgw"))


def concept(title, content, tags=("one", "two"), kind="pattern", level="meta-concept"):
    return {"title": title, "content": content, "suggested_tags": list(tags), "concept_type": kind, "abstraction_level": level}


def scripted(answers):
    """answers: for a word in a chunk the reply, or None for a provider that fails."""

    def run(chunks):
        raw = F.lit(json.dumps({"concepts": []}))
        status = F.lit("ok")
        for word, reply in answers.items():
            hit = F.col("chunk").contains(word)
            raw = F.when(hit, F.lit(reply if isinstance(reply, str) or reply is None else json.dumps({"concepts": reply})).cast("string")).otherwise(raw)
            status = F.when(hit & F.lit(reply is None), "provider_error").otherwise(status)
        return chunks.select("source_id", "chunk_pos", raw.alias("raw"), status.alias("status"))

    return run


def start(spark, sources, written=()):
    s = spark.createDataFrame(list(sources), "source_id string, content string")
    n = spark.createDataFrame(list(written), "stem string, content string")
    i = vectors.rebuilt(notes.entries(n), counting)
    return s, n, i


def run(spark, sources, answers, written=(), dry_run=False, settings=SETTINGS):
    s, n, i = start(spark, sources, written)
    return process(s, n, i, scripted(answers), settings, at(), dry_run, counting)


def outcomes(result):
    return {r["source_id"]: r["outcome"] for r in result.outcomes.collect()}


LONG = "Some words on alpha that are long enough to be read."


def test_dry_run_writes_nothing(spark):
    done = run(spark, [("a", LONG)], {"alpha": [concept("Alpha", "alpha text")]}, dry_run=True)
    assert outcomes(done) == {"a": "created"} and done.notes.count() == 0 and done.index.count() == 0
    assert [r["content"] for r in done.sources.collect()] == [LONG]


def test_creates_notes_and_marks_sources(spark):
    done = run(spark, [("a", LONG)], {"alpha": [concept("Alpha One", "alpha alpha", ("Tag A", "x"))]})
    [note] = done.notes.collect()
    assert note["stem"] == "alpha-one" and "Tags: [[tag-a]] [[x]]" in note["content"] and "1. [[a]]" in note["content"]
    assert "Status: #processed" in done.sources.first()["content"]
    assert vectors.drift(notes.entries(done.notes), done.index).count() == 0
    again = process(done.sources, done.notes, done.index, scripted({}), SETTINGS, at(), False, counting)
    assert outcomes(again) == {"a": "already_processed"} and again.notes.count() == 1


def test_collections_do_not_mix(spark):
    rows = [("skein__x", "keywords", "m1", "a"), ("zettels__keywords__counts_1", "keywords", "counts-1", "b"), ("zettels__keywords__m_1", "keywords", "m.1", "c")]
    index = spark.createDataFrame(rows, "collection string, provider string, model string, note_id string")
    assert [r["note_id"] for r in vectors.collection(index, "keywords").collect()] == ["b"]
    assert [r["note_id"] for r in vectors.collection(index, "keywords", "m.1").collect()] == ["c"]
    with pytest.raises(ValueError, match="holds"):
        vectors.collection(index, "keywords", "m 1")
    with pytest.raises(ValueError, match="unknown"):
        vectors.collection(index, "other")


def test_stale_index_is_refused(spark):
    n = spark.createDataFrame([("a", "text"), ("b", "text")], "stem string, content string")
    with pytest.raises(RuntimeError, match="active index is stale"):
        vectors.require_fresh(notes.entries(n), vectors.rebuilt(notes.entries(n.where("stem = 'a'"))))
    vectors.require_fresh(notes.entries(n), vectors.rebuilt(notes.entries(n)))
    assert {r["note_id"]: r["needed"] for r in vectors.needs_indexing(notes.entries(n), vectors.rebuilt(notes.entries(n.where("stem = 'a'")))).collect()} == {"a": False, "b": True}


def test_long_sources_come_in_chunks_and_lose_duplicates(spark):
    text = "# One\n\n" + "alpha words here. " * 7 + "\n\n# Two\n\n" + "beta words there. " * 7
    done = run(spark, [("a", text)], {"alpha": [concept("T", "alpha alpha alpha")], "beta": [concept("t!", "other"), concept("U", "alpha alpha alpha")]})
    assert done.outcomes.first()["n_chunks"] >= 2 and done.notes.count() == 1
    assert "Status: #processed" in done.sources.first()["content"]


def test_replies_that_fail(spark):
    sources = [("bad", "words gamma " * 4), ("down", "words beta " * 4), ("none", "plain words " * 4), ("short", "hi"), ("todo", "meeting todo " * 4), ("half", "words delta " * 4)]
    answers = {"gamma": '{"not_concepts": []}', "beta": None, "delta": [concept("D", "delta", ("one",)), concept("E", "delta")]}
    done = run(spark, sources, answers)
    assert outcomes(done) == {"bad": "invalid_output", "down": "provider_error", "none": "no_valid_concepts", "short": "too_short", "todo": "non_extractable", "half": "created"}
    marked = {r["source_id"] for r in done.sources.where(T.is_processed(F.col("content"))).collect()}
    assert marked == {"none", "todo", "half"} and done.notes.count() == 1
    assert {r["outcome"]: r["n"] for r in done.summary.collect()} == {o: int(o != "already_processed") for o in extract.OUTCOMES}


def test_later_concepts_meet_earlier_ones(spark):
    sources = [("a", "first alpha " * 4), ("b", "second beta " * 4), ("c", "third gamma " * 4)]
    answers = {"alpha": [concept("Alpha", "alpha beta gamma")], "beta": [concept("ALPHA", "beta " * 9)], "gamma": [concept("Old", "gamma " * 9), concept("New", "beta " * 20)]}
    done = run(spark, sources, answers, written=[("old", "an older note")])
    reasons = {r["title"]: r["reason"] for r in done.concepts.collect()}
    assert reasons == {"Alpha": None, "ALPHA": "duplicate of an earlier concept of this run", "Old": "file exists: old.md", "New": None}
    assert outcomes(done) == {"a": "created", "b": "no_valid_concepts", "c": "created"}
    assert {r["stem"] for r in done.notes.collect()} == {"old", "alpha", "new"}


def test_a_failing_embedding_keeps_what_titles_left(spark):
    def broken(text):
        return F.when(~text.contains("beta"), counting(text))

    answers = {"alpha": [concept("One", "alpha alpha"), concept("one!", "other"), concept("Two", "alpha alpha"), concept("Three", "beta beta beta")]}
    s, n, i = start(spark, [("a", LONG)], [])
    done = process(s, n, i, scripted(answers), SETTINGS, at(), False, broken)
    # the source's own check by contents is left out; the check against notes of the run still holds
    assert {r["title"]: r["reason"] for r in done.concepts.collect()} == {"One": None, "Two": "duplicate of an earlier concept of this run", "Three": None}


def test_names_compare_as_stored(spark):
    n = spark.createDataFrame([("Alpha", "old"), ("beta", "old")], "stem string, content string")
    c = spark.createDataFrame([(1, "Alpha", "l"), (2, "Beta", "b")], "id long, title string, content string")
    i = spark.createDataFrame([], "note_id string, embedding array<double>")
    from skein.operators.process import duplicate_reasons

    assert {r["id"]: r["reason"] for r in duplicate_reasons(c, n, i, 0.1, counting).collect()} == {1: None, 2: "file exists: beta.md"}


def test_limit_and_totals(spark):
    rows = [("a", "x\n\n#processed"), ("b", LONG), ("c", "y\n\n#processed"), ("d", LONG), ("e", LONG)]
    s = spark.createDataFrame(rows, "source_id string, content string")
    assert sorted(r["source_id"] for r in taken(s, 1).collect()) == ["a", "b", "c"]
    assert taken(s, 0).count() == taken(s, 3).count() == 5
    assert tuple(totals(s).first()) == (5, 2, 3)


def test_first_come_is_the_greedy_result(spark):
    import random

    rnd = random.Random(4)
    n = 40
    pairs = sorted({tuple(sorted(rnd.sample(range(n), 2))) for _ in range(90)})
    kept = set()
    for i in range(n):
        if not any((j, i) in pairs for j in kept):
            kept.add(i)
    done = vectors.first_come(spark.range(n), spark.createDataFrame(pairs, "earlier long, later long"))
    assert {r["id"] for r in done.where("kept").collect()} == kept and done.count() == n


def test_bundles_follow_tags_only(spark):
    written = [("a", "Tags: [[b]] [[missing]]\n# A\n\n# See Also\n- [[c]]\n\n# References\n1. [[src]]\n"), ("b", "Tags: [[d]]\n# B\n\n# See Also\n- [[e]]\n"), ("c", "# C\n"), ("d", "Tags:\n# D\n"), ("e", "# E\n")]
    n = spark.createDataFrame(written, "stem string, content string")
    rows = {r["note_id"]: (r["degree"], r["rendered"]) for r in graph.bundle_rows(n, graph.note_seeds(n, "a"), 1).collect()}
    assert rows == {"a": (0, True), "b": (0, True), "missing": (0, False), "c": (0, True), "d": (1, True)}
    similar = spark.createDataFrame([(1, "e"), (2, "a")], "rank int, note_id string")
    seeds = [r["note_id"] for r in graph.source_seeds(n, "src", similar).orderBy("ord").collect()]
    assert seeds == ["a", "e"]
    counts = graph.source_counts(n, "src", similar, 1)
    assert counts == {"source_notes": 1, "direct_tags": 0, "direct_similar_notes": 1, "traversed_notes": 1, "total_notes": 3, "max_depth": 1}
    assert graph.note_counts(n, "a", 2) == {"source_notes": 1, "direct_tags": 2, "direct_similar_notes": 1, "traversed_notes": 1, "total_notes": 4, "max_depth": 1}
    with pytest.raises(FileNotFoundError):
        graph.note_counts(n, "zz", 1)
    with pytest.raises(FileNotFoundError):
        graph.note_bundle(n, "zz", 1, "now")


def test_bundle_texts(spark):
    written = [("a", "Tags: [[b]] [[missing]]\n# A\n\n# References\n1. [[src]]\n"), ("b", "Tags: [[a]] [[c]]\n# B\n"), ("c", "# C  \n\n"), ("D d", "Tags: [[c]]\n# References\n1. [[Src]]\n2. [[other]]\n")]
    n = spark.createDataFrame(written, "stem string, content string")
    index = vectors.rebuilt(notes.entries(n.where("stem in ('a', 'c')")), counting)
    sources = spark.createDataFrame([("src", "b"), ("other", "nothing near " + "w" * 30), ("lonely", "l" * 40)], "source_id string, content string")
    made = {r["bundle"]: r["content"] for r in graph.source_bundles(n, sources, index, 1, "now", 2, 4.0, counting).collect()}
    assert made["src"] == (
        "# Bundle: src\nGenerated: now\n\n## Source Content\n\nb\n\n## Connected Knowledge\n\n### Degree 0\n\n#### a\n\nTags: [[b]] [[missing]]\n# A\n\n# References\n1. [[src]]\n\n"
        "#### c\n\n# C\n\n### Degree 1\n\n#### b\n\nTags: [[a]] [[c]]\n# B\n\n## Metadata\n\nSource: [[src]]\nSource notes: 2\nDirect tags: 0\nDirect similar notes: 1\nTraversed notes: 1\nTotal notes included: 3\nMax depth: 1\n"
    )
    # the note d-d has no file of its id's name, so that it is listed but not shown
    assert "#### d-d" not in made["other"] and "Source notes: 1\nDirect tags: 0\nDirect similar notes: 0\nTraversed notes: 1\nTotal notes included: 1\nMax depth: 1\n" in made["other"]
    assert made["lonely"].endswith("## Connected Knowledge\n\n## Metadata\n\nSource: [[lonely]]\nSource notes: 0\nDirect tags: 0\nDirect similar notes: 0\nTraversed notes: 0\nTotal notes included: 0\nMax depth: 0\n")
    name = spark.range(1).select(graph.stamped_name(F.lit("A Note!"), at())).first()[0]
    assert name == "a-note-20250102-030405.md"


def brute_reach(links, seeds, depth):
    """One bundle by a queue."""
    seen, queue, out = set(seeds), [(s, 0) for s in seeds], []
    while queue:
        note, degree = queue.pop(0)
        if degree == depth:
            continue
        for target in links.get(note, ()):
            if target in links and target not in seen:
                seen.add(target)
                queue.append((target, degree + 1))
                out.append((target, degree + 1))
    places = {}
    return {(n, d, places.setdefault(d, []).append(n) or len(places[d]) - 1) for n, d in out}


def test_reach_of_many_bundles(spark):
    import random

    rnd = random.Random(2)
    names = [f"n{i:02d}" for i in range(60)]
    links = {n: [rnd.choice([*names, "gone"]) for _ in range(rnd.randrange(4))] for n in names}
    n = spark.createDataFrame([(k, "Tags: " + " ".join(f"[[{x}]]" for x in v) + "\n# t\n") for k, v in links.items()], "stem string, content string").repartition(3)
    seeds = {f"b{i}": rnd.sample(names, 1 + i % 4) for i in range(25)}
    df = spark.createDataFrame([(b, s, i) for b, xs in seeds.items() for i, s in enumerate(xs)], "bundle string, note_id string, ord long").repartition(4)
    got = {}
    for r in graph.reach_all(n, df, 3).collect():
        got.setdefault(r["bundle"], set()).add((r["note_id"], r["degree"], r["ord"]))
    assert {b: got.get(b, set()) for b in seeds} == {b: brute_reach(links, xs, 3) for b, xs in seeds.items()}
    assert graph.reach_all(n, df, 0).count() == 0


def test_backlinks_and_merges(spark):
    n = spark.createDataFrame([("a", "Tags: [[b]]\n# A\n\n# See Also\n- [[c]]\n"), ("b", "# B\n"), ("c", "Tags:\n# C\n"), ("C!", "more")], "stem string, content string")
    after, counts = notes.sync_backlinks(n)
    tags = {r["stem"]: r["t"] for r in after.select("stem", T.tag_links(F.col("content")).alias("t")).collect()}
    assert tags == {"a": ["b", "c"], "b": ["a"], "c": ["a"], "C!": []}
    assert counts.first().asDict() == {"n_sections_removed": 1, "n_tags_added": 1, "n_backlinks_added": 2, "n_files_modified": 3}
    timed = n.withColumn("mtime", F.when(F.col("stem") == "c", 2).otherwise(1))
    assert {r["note_id"]: r["content"] for r in notes.merged_by_time(timed).collect()} == {"c": "more\n\n---\n\nTags:\n# C\n"}
    assert notes.rename_counts(n).first().asDict() == {"n_renamed": 0, "n_merged": 1, "n_deleted": 1}


def test_process_query_against_one_by_one(spark):
    """The registered ingest run over a table, held against going through the concepts in order."""
    from skein.functions.chunk import source_chunks
    from skein.operators import runner
    from skein.plans import queries as plans

    sf = "/root/testdata/sf0.001"
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", text.alias("text"), source_chunks(text, plans.TARGET, plans.CAP).alias("chunks"), (~T.is_processed(text) & (F.length(T.strip(text)) >= 100)).alias("fit"))
    ask = runner.outline()

    def vector(x):
        low = x.lower()
        return [float(low.count(t)) for t in vectors.TERMS] + [len(x) / 1000.0]

    def cosine(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return 1 - sum(x * y for x, y in zip(a, b)) / n if n else 1.0

    want, kept = {}, []
    for r in sorted(docs.where("fit").collect(), key=lambda r: r["doc_id"]):
        own, titles = [], set()
        for chunk in r["chunks"]:
            try:
                reply = ask(f"Text:\n{chunk}")
            except runner.ProviderError:
                continue
            inner = reply.split("```json")[-1].split("```")[0] if "```json" in reply else reply.split("```")[1] if "```" in reply else reply
            try:
                found = json.loads(inner)
            except ValueError:
                continue
            for item in found if isinstance(found, list) else found.get("concepts", []):
                title = item["title"].strip() if isinstance(item["title"], str) else ""
                if not title or len(item["suggested_tags"]) < 2 or title in titles:
                    continue
                titles.add(title)
                v = vector(item["content"].strip())
                if all(cosine(v, w) > plans.DUPLICATE for _, w in own):
                    own.append((title, v))
        for title, v in own:
            twin = any(t == title or round(sum((x - y) ** 2 for x, y in zip(v, w)), 6) <= plans.DUPLICATE for t, w in kept)
            want[f"src-{r['doc_id']:09d}", title] = "duplicate of an earlier concept of this run" if twin else None
            if not twin:
                kept.append((title, v))
    got = {(r["source_id"], r["title"]): r["reason"] for r in plans.process_concepts(spark, sf).collect()}
    assert got == want and 3 < len(kept) < len(want)


def test_first_come_named_is_the_greedy_result(spark):
    import random

    rnd = random.Random(9)
    items = [(i, rnd.choice("abcdefgh"), rnd.choice([None, [0.0, 0.0], [float(rnd.randrange(6)), float(rnd.randrange(6))]])) for i in range(150)]
    kept = []
    for _, name, v in items:
        if not any(name == n or v and w and sum((x - y) ** 2 for x, y in zip(v, w)) <= 1.0 for n, w in kept):
            kept.append((name, v))
    done = vectors.first_come_named(spark.createDataFrame(items, "id long, name string, v array<double>").repartition(3), 1.0).collect()
    assert len(done) == 150 and [items[r["id"]][1:] for r in sorted(done) if r["kept"]] == kept and len(kept) > 3
    assert vectors.first_come_named(spark.createDataFrame([], "id long, name string, v array<double>"), 1.0).count() == 0


def test_copies_of_concepts_make_no_pairs(spark, monkeypatch):
    """Sixty concepts of one name, or one content, are told by the earliest one: no table has a row for each two of them."""
    sizes, write = [], vectors.kept
    monkeypatch.setattr(vectors, "kept", lambda df, name: (out := write(df, name), sizes.append(out.count()))[0])
    sources = [(f"s{i:03d}", f"word{i % 3} and some more words") for i in range(60)]
    done = run(spark, sources, {"word0": [concept("Same", "alpha " * 3)], "word1": [concept("Same", "beta beta " * 9)], "word2": [concept("Other", "alpha " * 3)]})
    assert {r["source_id"] for r in done.concepts.where("reason is null").collect()} == {"s000"} and done.concepts.count() == 60
    assert max(sizes) <= 60


def test_trimming_takes_the_characters_of_the_pattern(spark):
    c = F.col("c")
    codes = spark.range(1, 0x10000).where("id not between 55296 and 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    off = codes.where((T.strip(F.concat(c, F.lit("x"), c)) == "x") != c.rlike(rf"\A{T.WS}\z"))
    assert [r["c"] for r in off.collect()] == [] and codes.where(T.rstrip(F.concat(c, c)) == "").count() == len(T.SPACES)


def test_a_processed_mark_is_a_word_or_the_last_line(spark):
    rows = [("Status: #processed\nx", True), ("x\n\n #processed \n\n", True), ("#processed\nx", False), ("Status: #processedx", False), ("x", False), ("", False), (None, None)]
    df = spark.createDataFrame(rows, "c string, want boolean")
    assert df.where(~T.is_processed(F.col("c")).eqNullSafe(F.col("want"))).count() == 0


def test_requests_share_threads_and_a_stuck_one_is_replaced():
    import threading
    import time

    from skein.operators import runner

    used = set()

    def call(prompt):
        used.add(threading.get_ident())
        if prompt in ("0", "1"):
            time.sleep(1.5)
        return prompt

    done = list(runner.answers(((i, str(i)) for i in range(50)), call, 2, 0.4, 0, 0.0))
    assert [d[2] for d in done] == ["provider_error"] * 2 + ["ok"] * 48 and [d[0] for d in done] == list(range(50)) and len(used) == 4


def test_bundles_are_digested_piece_by_piece(spark, monkeypatch):
    """The digests are those of the texts, also where a bundle spans many Arrow batches, and the query makes no row with a whole bundle."""
    import hashlib

    from skein.plans import queries as plans

    written = [(f"n{i:02d}", f"Tags: [[n{(i * 7 + 1) % 40:02d}]]\n# Nöte {i}  \n\n# References\n1. [[{'src' if i % 3 else 'other'}]]\n") for i in range(40)]
    n = spark.createDataFrame(written, "stem string, content string").repartition(3)
    index = vectors.rebuilt(notes.entries(n.where("stem < 'n05'")), counting)
    sources = spark.createDataFrame([("src", "b"), ("other", "é" * 30), ("lonely", "l" * 40)], "source_id string, content string")
    pieces = graph.source_parts(n, sources, index, 1, "now", 2, 4.0, counting)
    texts = {r["bundle"]: r["content"] for r in graph.texts(pieces).collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r["bundle"]: (r["n_chars"], r["content_hash"]) for r in graph.digests(pieces).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 3 and got == {b: (len(t), hashlib.sha256(t.encode()).hexdigest()) for b, t in texts.items()}
    monkeypatch.delattr(graph, "texts")
    assert plans.source_bundles(spark, "/root/testdata/sf0.001").count() > 0


def test_bundles_show_files_with_odd_names_where_a_caller_lists_them(spark):
    n = spark.createDataFrame([("A_b", "one"), ("c", "two"), ("D", "three")], "stem string, content string")
    told = spark.createDataFrame([("x", "x", "x", None, 1, 0, 0, 0, 1, 0)], "bundle string, title string, source string, source_text string, source_notes long, direct_tags long, direct_similar_notes long, traversed_notes long, total_notes long, max_depth long")
    listed = spark.createDataFrame([("x", 0, 0, "A_b"), ("x", 0, 1, "c")], "bundle string, degree int, ord long, note_id string")
    assert "#### A_b\n\none\n\n#### c\n\ntwo\n\n" in graph.texts(graph.parts(n, listed, told, "now")).first()["content"]
    assert "#### A_b" not in (text := graph.texts(graph.parts(n, listed.where("note_id = 'c'"), told, "now")).first()["content"]) and "#### c\n\ntwo" in text
