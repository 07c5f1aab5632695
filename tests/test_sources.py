"""The versioned store, folders of notes, the index in a store, and incremental ingestion, with writers that fail."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from skein.operators import index, notes, runner
from skein.operators.process import Settings
from skein.sources import folder
from skein.sources.store import Conflict, Store
from skein.streaming import ingest

AT = "2025-01-02 03:04:05"
SETTINGS = Settings("# {{Title}}\n\nTags:\n\n# References\n", min_chars=5, duplicate=0.0001)


def values(df):
    return sorted(tuple(r) for r in df.collect())


def failing(spark):
    @F.udf("long")
    def fail(x):
        raise RuntimeError("the disk is on fire")

    return spark.range(3).select(fail("id").alias("id"))


def test_store_switches_versions_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("t") is None and store.versions("t") == [] and store.counts("t") == {}
    assert store.commit("t", spark.range(3)) == 1 and store.commit("t", store.read("t").where("id > 0")) == 2
    assert values(store.read("t")) == [(1,), (2,)] and values(store.read("t", version=1)) == [(0,), (1,), (2,)] and store.read("t", version=9) is None
    with pytest.raises(Exception, match="on fire"):
        store.commit("t", failing(spark))
    assert store.versions("t") == [1, 2] and values(store.read("t")) == [(1,), (2,)]


def test_store_ignores_data_without_a_log_file(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    store.commit("t", spark.range(2))

    def crash(self, table, rows):
        raise RuntimeError("between data and log")

    with monkeypatch.context() as m:
        m.setattr(Store, "_switch", crash)
        with pytest.raises(RuntimeError, match="between"):
            store.commit("t", spark.range(50))
    assert values(store.read("t")) == [(0,), (1,)] and len(os.listdir(tmp_path / "t/data")) == 2
    assert store.commit("t", spark.range(1)) == 2 and store.counts("t") == {"all": 1}


def test_store_replaces_one_collection(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.commit_all("t", {"a": spark.range(2), "b": spark.range(3).withColumn("x", F.lit("y"))}, meta={"a": {"model": "m"}})
    before = store._at("t", None)["b"]["folder"]
    store.commit("t", spark.range(5), "a", tag="batch-7")
    assert store.counts("t") == {"a": 5, "b": 3} and store._at("t", None)["b"]["folder"] == before and store.read("t", "b").columns == ["id", "x"]
    assert store.commit("t", spark.range(9), "a", tag="batch-7") == 2 and store.counts("t")["a"] == 5 and store.has_tag("t", "batch-7")
    assert store.read("t", "c") is None and store.get_or_create("t", "z string", "c").columns == ["z"] and store.versions("t") == [1, 2, 3]


def test_store_refuses_a_fork(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.commit("t", spark.range(1))
    row = store.log("t").first()
    store._switch("t", [(1, "other", *row[2:])])
    with pytest.raises(Conflict):
        store.read("t")


def test_notes_round_trip(spark, tmp_path):
    rows = [("plain", "# A\n"), ("with space", "x"), ("100% é漢", "naïve 漢\r\n"), ("empty", ""), ("null", None), ("a#b?c", "q")]
    there = str(tmp_path / "vault é")
    folder.write_notes(spark.createDataFrame(rows, "stem string, content string").repartition(3), there)
    assert sorted(os.listdir(there)) == sorted(f"{s}.md" for s, _ in rows)
    got = folder.read_notes(spark, there)
    assert values(got.select("stem", "content")) == sorted((s, c or "") for s, c in rows) and got.where("mtime is null or file_name != stem || '.md'").count() == 0
    (tmp_path / "vault é/other.txt").write_text("no note")
    os.mkdir(tmp_path / "vault é/dir.md")
    assert got.count() == len(rows) and folder.read_notes(spark, f"file://{tmp_path}/none-yet".replace("none-yet", "empty-dir")).schema == got.schema
    os.mkdir(tmp_path / "nothing")
    assert folder.read_notes(spark, str(tmp_path / "nothing")).count() == 0


def test_notes_that_cannot_be_files_are_refused(spark, tmp_path):
    for rows, what in (([("a", "1"), ("a", "2")], "two rows"), ([("a/b", "1")], "no file name"), ([("", "1")], "no file name"), ([(None, "1")], "no file name")):
        with pytest.raises(ValueError, match=what):
            folder.write_notes(spark.createDataFrame(rows, "stem string, content string"), str(tmp_path / "v"))
    assert not (tmp_path / "v").exists()


def test_a_task_that_runs_again_leaves_whole_files(spark, tmp_path):
    """The writer fails behind its second row and is run again."""
    there = str(tmp_path / "v")
    schema = spark.createDataFrame([], "stem string, content string").schema

    def cut_short():
        yield from [("a", "1" * 1000), ("b", "2")]
        raise OSError("lost")

    with pytest.raises(OSError):
        folder._Writer(there, schema).write(cut_short())
    assert sorted(os.listdir(there)) == ["a.md", "b.md"]
    assert folder._Writer(there, schema).write(iter([("a", "1" * 1000), ("b", "2"), ("c", "3")])).n == 3
    assert {n: open(f"{there}/{n}").read() for n in os.listdir(there)} == {"a.md": "1" * 1000, "b.md": "2", "c.md": "3"}


def test_reads_are_tried_again_only_where_the_system_asks_for_it():
    calls = []

    def read(errno, fails):
        calls.append(1)
        if len(calls) <= fails:
            raise OSError(errno, "no")
        return "text"

    assert folder.read_retrying(lambda: read(11, 2), delay=0) == "text" and len(calls) == 3
    for errno, fails, n in ((11, 9, 3), (2, 9, 1)):
        calls.clear()
        with pytest.raises(OSError):
            folder.read_retrying(lambda: read(errno, fails), delay=0)
        assert len(calls) == n


def test_index_in_a_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    n = spark.createDataFrame([("a", "red stone"), ("b", "blue river"), ("c", "red stones")], "stem string, content string")
    e = notes.entries(n)
    asked = spark.createDataFrame([("q", "red stone")], "id string, content string")
    assert index.opened(store, "hashed-words", create=False) is None and index.similar(store, asked, "hashed-words", create=False).count() == 0 and store.versions("index") == []
    assert index.refresh(store, e, "hashed-words") == {"indexed": 3, "removed": 0, "unchanged": 0}
    assert [r["id"] for r in index.similar(store, asked, "hashed-words", k=1).collect()] == ["a"]
    changed = notes.entries(n.where("stem != 'b'").withColumn("content", F.when(F.col("stem") == "c", "green").otherwise(F.col("content"))))
    assert index.refresh(store, changed, "hashed-words") == {"indexed": 1, "removed": 1, "unchanged": 1}
    versions = store.versions("index")
    assert index.refresh(store, changed, "hashed-words") == {"indexed": 0, "removed": 0, "unchanged": 2} and store.versions("index") == versions
    assert index.rebuild(store, e.where("note_id = 'b'"), "hashed-words") == {"indexed": 1, "removed": 2}
    assert index.refresh(store, e, "keywords")["indexed"] == 3 and len(store.counts("index")) == 2
    with pytest.raises(ValueError, match="holds"):
        index.opened(store, "hashed-words", "crc 64")
    with pytest.raises(ValueError, match="unknown"):
        index.opened(store, "other")


def test_a_failing_model_leaves_the_index_as_it_was(spark, tmp_path):
    def factory(model):
        def call(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no such word")
            return [[float(len(t))] for t in texts]

        return call

    runner.register_embedding("touchy", "one", factory)
    store = Store(spark, str(tmp_path))
    entries = spark.createDataFrame([("a", "fine"), ("b", "good")], "note_id string, document string")
    index.refresh(store, entries, "touchy")
    with pytest.raises(Exception, match="no such word"):
        index.refresh(store, entries.union(spark.createDataFrame([("c", "bad")], entries.schema)), "touchy")
    assert values(index.opened(store, "touchy").select("note_id", "embedding")) == [("a", [4.0]), ("b", [4.0])]
    got = spark.createDataFrame([(1, "bad"), (2, None)], "id long, t string").select("id", runner.embedding("touchy", lenient=True)(F.col("t")).alias("v"))
    assert values(got) == [(1, None), (2, None)]


# Extractors


def chunks(spark, texts):
    return spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "source_id string, chunk_pos int, chunk string").coalesce(1)


def test_slow_failing_and_fenced_providers(spark):
    def factory(model, patience):
        tries = {}

        def call(prompt):
            text = prompt.partition("Text:\n")[2]
            tries[text] = tries.get(text, 0) + 1
            if text == "slow":
                time.sleep(30)
            if text == "down" or (text == "shaky" and tries[text] < patience):
                raise runner.ProviderError("down")
            if text == "broken":
                raise KeyError("choices")
            return f"```json\n{json.dumps({'concepts': []})}\n``` {model}"

        return call

    runner.register_extractor("scripted", factory)
    began = time.monotonic()
    texts = ["a", "slow", "down", "shaky", "broken", "b"]
    got = {r["chunk_pos"]: r for r in runner.extractor("scripted", "m", in_flight=3, timeout=3.0, retries=2, delay=0.01, patience=3)(chunks(spark, texts)).collect()}
    assert [got[i]["status"] for i in range(6)] == ["ok", "provider_error", "provider_error", "ok", "provider_error", "ok"]
    assert got[0]["raw"].endswith(" m") and "within 3 s" in got[1]["error"] and got[2]["error"] == "down" and got[4]["error"] == "KeyError: 'choices'"
    assert time.monotonic() - began < 25
    with pytest.raises(ValueError, match="unknown extraction provider"):
        runner.extractor("nobody")


def test_requests_in_flight_are_bounded():
    import threading

    now, most, lock = [0], [0], threading.Lock()

    def call(prompt):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.01)
        with lock:
            now[0] -= 1
        return prompt

    done = list(runner.answers(((i, str(i)) for i in range(40)), call, 4, 10.0, 0, 0.0))
    assert [d[:3] for d in done] == [(i, str(i), "ok") for i in range(40)] and 1 < most[0] <= 4


# Incremental ingestion


def write_batch(spark, rows, path):
    spark.createDataFrame(rows, "source_id string, content string").coalesce(1).write.mode("append").parquet(path)


def test_ingest_goes_through_each_source_once(spark, tmp_path):
    store, come = Store(spark, str(tmp_path / "store")), str(tmp_path / "in")
    seen = []
    outline = runner.extractor("outline", delay=0.0, retries=0)

    def counted(df):
        seen.append(df.count())
        return outline(df)

    write_batch(spark, [("a", "x" * 14), ("b", "river" + "!" * 9), ("c", "abc")], come)
    run = lambda: ingest.ingest_sources(store, come, counted, SETTINGS, F.lit(AT).cast("timestamp"), str(tmp_path / "checkpoint")).awaitTermination()
    run()
    first = {r["source_id"]: (r["outcome"], r["batch"]) for r in store.read(ingest.TABLE, "outcomes").collect()}
    assert first == {"a": ("created", 0), "b": ("created", 0), "c": ("too_short", 0)} and values(store.read(ingest.TABLE, "notes").select("stem")) == [("river",), ("x" * 14,)]
    versions = store.versions(ingest.TABLE)
    run()
    assert store.versions(ingest.TABLE) == versions
    write_batch(spark, [("d", "stone" + "?" * 9)], come)
    run()
    assert len(values(store.read(ingest.TABLE, "notes"))) == 3 and store.counts(ingest.TABLE)["sources"] == 4 and seen == [2, 1]


def test_a_batch_that_runs_twice_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    step = ingest.batch_step(store, runner.extractor("outline", delay=0.0), SETTINGS, F.lit(AT).cast("timestamp"))
    rows = spark.createDataFrame([("a", "x" * 14)], "source_id string, content string")
    switch = Store._switch
    with monkeypatch.context() as m:
        m.setattr(Store, "_switch", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            step(rows, 0)
    assert Store._switch is switch and store.read(ingest.TABLE, "notes") is None
    step(rows, 0)
    before = values(store.read(ingest.TABLE, "notes"))
    step(rows, 0)
    assert values(store.read(ingest.TABLE, "notes")) == before and len(before) == 1 and store.versions(ingest.TABLE) == [1]
