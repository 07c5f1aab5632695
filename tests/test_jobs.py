"""Whole jobs over a vault of files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from skein import jobs, settings
from skein.operators import extract

AT = lambda: F.lit("2025-01-02 03:04:05").cast("timestamp")


def files(path):
    return {n: (path / n).read_text() for n in sorted(os.listdir(path))} if path.exists() else {}


def made(spark, tmp_path, **folders):
    (tmp_path / "template.md").write_text("# {{Title}}\n\nTags:\n\n# References\n")
    (tmp_path / "config.json").write_text(json.dumps({"processing": {"min_source_chars": 5}, "embeddings": {"provider": "hashed-words", "max_distance": 1.5}, "bundle": {"top_k": 1}}))
    for name in ("sources", "notes"):
        (tmp_path / name).mkdir()
        for stem, text in folders.get(name, {}).items():
            (tmp_path / name / f"{stem}.md").write_text(text)
    return jobs.Vault(spark, str(tmp_path), settings.loaded(spark, str(tmp_path / "config.json")))


def test_settings(tmp_path):
    assert settings.merged({"a": {"x": 1, "y": [1]}, "b": 2}, {"a": {"y": [2]}, "c": 3}) == {"a": {"x": 1, "y": [2]}, "b": 2, "c": 3}
    assert settings.resolved("/v/", "notes") == "/v/notes" and settings.resolved("/v", "/n") == "/n" and settings.resolved("/v", "s3://b/n") == "s3://b/n"
    assert settings.resolved("/v", "~/n") == os.path.expanduser("~/n")
    assert settings.process_settings(settings.DEFAULTS, "t").cap == 6000


def test_ingest_and_bundle(spark, tmp_path):
    vault = made(spark, tmp_path, sources={"a": "x" * 14, "b b": "river" + "!" * 9, "c": "abc"}, notes={"old": "Tags: [[river]]\n# Old\n"})
    with pytest.raises(RuntimeError, match="stale"):
        jobs.ingest(vault, AT(), dry_run=True)
    before = files(tmp_path / "notes")
    with pytest.raises(FileNotFoundError):
        jobs.bundle(vault, AT(), source="zz")
    with pytest.raises(ValueError):
        jobs.bundle(vault, AT())
    assert files(tmp_path / "notes") == before
    jobs.ingest(vault, AT())
    after, sources = files(tmp_path / "notes"), files(tmp_path / "sources")
    assert set(after) == {"old.md", "river.md", f"{'x' * 14}.md"} and "1. [[b b]]" in after["river.md"] and "#processed" in sources["b b.md"] and sources["c.md"] == "abc"
    jobs.ingest(vault, AT())
    assert files(tmp_path / "notes") == after and files(tmp_path / "sources") == sources
    text = jobs.bundle(vault, AT(), source="b b.md", note="old")
    assert text.startswith("# Bundle: b b\nGenerated: 2025-01-02 03:04\n") and "#### river" in text and list(files(tmp_path / "bundles")) == ["b-b-20250102-030405.md"]
    assert jobs.bundle(vault, AT(), note="Old", dry_run=True).count("#### ") == 2 and len(files(tmp_path / "bundles")) == 1
    assert jobs.bundle(vault, AT(), source="a", depth=0, dry_run=True).endswith("Max depth: 0\n")
    assert jobs.preview("x" * 2001) == "x" * 2000 + "\n\n... (1 more characters)" and jobs.preview("x") == "x"


def test_normalize_and_rename(spark, tmp_path):
    vault = made(spark, tmp_path, notes={"a": "Tags: [[B b]] [[b-b]] [[c]]\n# A\n", "B b": "one\n", "b_b": "two\n", "c": "Tags: [[a]]\n"})
    os.utime(tmp_path / "notes/b_b.md", (1, 1))
    assert jobs.normalize(vault, dry_run=True) == {"files": 1, "links": 1, "duplicates": 1} and "[[B b]]" in files(tmp_path / "notes")["a.md"]
    jobs.normalize(vault)
    assert files(tmp_path / "notes")["a.md"] == "Tags: [[b-b]] [[c]]\n# A\n"
    assert jobs.rename(vault, dry_run=True) == {"n_renamed": 0, "n_merged": 1, "n_deleted": 2}
    jobs.rename(vault)
    assert files(tmp_path / "notes") == {"a.md": "Tags: [[b-b]] [[c]]\n# A\n", "b-b.md": "two\n\n---\n\none\n", "c.md": "Tags: [[a]]\n"}
    assert jobs.normalize(vault) == {"files": 0, "links": 0, "duplicates": 0} and jobs.rename(vault)["n_merged"] == 0


def test_valid_concepts(spark):
    item = {"title": " T ", "content": "c", "suggested_tags": ["x", "y"], "concept_type": "pattern", "abstraction_level": "meta-concept"}
    fenced = "Sure:\n```json\n" + json.dumps({"concepts": [item, {**item, "title": ""}]}) + "\n```\nDone."
    plain_fence = "```\n" + json.dumps([item]) + "\n```"
    replies = spark.createDataFrame([(1, fenced, "ok"), (2, plain_fence, "ok"), (3, None, "provider_error")], "source_id long, raw string, status string")
    got = extract.valid_concepts(replies)
    assert [c for c in got.columns if c not in ("source_id", "status", "item_pos")] == [c.split()[0] for c in extract.ITEM_SCHEMA.split(", ")]
    assert sorted((r["source_id"], r["title"]) for r in got.collect()) == [(1, "T"), (2, "T")]
