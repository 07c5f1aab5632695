"""Configuration of the jobs: a JSON file over defaults, places of folders, the note template."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import SparkSession

from .operators.process import Settings

#: What holds where a configuration says nothing; folders are below the vault's.
DEFAULTS: dict[str, Any] = {
    "folders": {"sources": "sources", "notes": "notes", "bundles": "bundles", "store": "store", "template": "template.md"},
    "extractor": {"provider": "outline", "model": None, "in_flight": 8, "timeout": 120.0},
    "embeddings": {"provider": "keywords", "model": None, "top_k": 5, "max_distance": 0.5},
    "bundle": {"depth": 1, "top_k": 10},
    "processing": {"min_source_chars": 100, "duplicate_max_distance": 0.15, "chunk_target_chars": 4000, "chunk_max_chars": 6000, "limit": 0},
}


def merged(defaults: dict, overrides: dict) -> dict:
    """defaults with what overrides says: nested dictionaries are merged, other values replaced."""
    both = lambda a, b: merged(a, b) if isinstance(a, dict) and isinstance(b, dict) else b
    return {k: both(defaults.get(k), overrides[k]) if k in overrides else defaults[k] for k in {**defaults, **overrides}}


def loaded(spark: SparkSession, path: str | None = None) -> dict:
    """The configuration in a JSON file, over DEFAULTS; DEFAULTS where no file is named."""
    return merged(DEFAULTS, json.loads(text_of(spark, path) or "{}")) if path else DEFAULTS


def text_of(spark: SparkSession, path: str) -> str:
    """One small file, such as a template or a configuration, from any store that Spark reads."""
    row = spark.read.text(path, wholetext=True).first()
    return row[0] if row else ""


def resolved(vault: str, place: str) -> str:
    """A configured place: home folders and absolute paths and URIs as they are, others below the vault."""
    place = os.path.expanduser(place)
    return place if os.path.isabs(place) or "://" in place else f"{vault.rstrip('/')}/{place}"


def process_settings(config: dict, template: str) -> Settings:
    p, e = config["processing"], config["embeddings"]
    return Settings(template, p["min_source_chars"], p["chunk_target_chars"], p["chunk_max_chars"], p["duplicate_max_distance"], e["top_k"], e["max_distance"], p["limit"])
