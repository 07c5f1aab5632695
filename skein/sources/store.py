"""Versioned tables with an atomic switch from one version to the next.

A table is a folder with ``data`` and ``log`` and consists of collections, each with its own columns.  A
commit first writes its rows to new folders below ``data`` and then one file to ``log``: a row for each
collection of the table, with the folder that holds its rows.  The file is moved into place when its
job commits, so that a reader sees the version before or the version after, whole, and never half of
one.  Data that no log file names (a writer failed in between) is never read.  Collections that a
commit does not name keep their folders; their rows are not copied.

A commit may carry a tag, such as the number of a batch; a second commit with the tag of an earlier
one does nothing, so that a batch that runs twice changes the table once.

One writer at a time for each table: two commits that were made from the same version leave a fork,
which readers refuse.  The log has one short row for each version and collection; that is all that
reaches the driver.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LOG = "version long, commit string, tag string, collection string, folder string, n_rows long, schema string, meta string"
#: The collection of a table that is not divided into any.
WHOLE = "all"


class Conflict(RuntimeError):
    """Two writers made a version from the same one."""


@dataclass(frozen=True)
class Store:
    """The tables below one folder, which all executors can reach."""

    spark: SparkSession
    root: str

    def log(self, table: str) -> DataFrame:
        """The rows of all commits; empty for a table that was never written."""
        path = f"{self.root}/{table}/log"
        # a commit without rows makes the folder, and does nothing where there is one
        self.spark.createDataFrame([], _LOG).write.mode("ignore").json(path)
        return self.spark.read.schema(_LOG).json(path)

    def _commits(self, table: str) -> dict[int, list]:
        """Log rows by version."""
        out: dict[int, list] = {}
        for r in self.log(table).collect():
            out.setdefault(r["version"], []).append(r)
        forked = [v for v, rows in sorted(out.items()) if len({r["commit"] for r in rows}) > 1]
        if forked:
            raise Conflict(f"{table}: version {forked[0]} was written more than once")
        return out

    def versions(self, table: str) -> list[int]:
        """Versions of a table, oldest first."""
        return sorted(self._commits(table))

    def _at(self, table: str, version: int | None) -> dict:
        """Log rows of a version (the latest if None) by collection."""
        commits = self._commits(table)
        at = max(commits, default=None) if version is None else version
        return {r["collection"]: r for r in commits.get(at, ())}

    def read(self, table: str, collection: str = WHOLE, version: int | None = None) -> DataFrame | None:
        """A collection in the latest or the given version; None where there is none."""
        row = self._at(table, version).get(collection)
        if row is None:
            return None
        return self.spark.read.schema(StructType.fromJson(json.loads(row["schema"]))).parquet(f"{self.root}/{table}/data/{row['folder']}")

    def meta(self, table: str, collection: str = WHOLE) -> dict | None:
        """What a collection's last commit said of it; None where there is none."""
        row = self._at(table, None).get(collection)
        return None if row is None else json.loads(row["meta"])

    def counts(self, table: str, version: int | None = None) -> dict[str, int]:
        """Rows of each collection."""
        return {c: r["n_rows"] for c, r in self._at(table, version).items()}

    def has_tag(self, table: str, tag: str) -> bool:
        return not self.log(table).where(F.col("tag") == tag).isEmpty()

    def get_or_create(self, table: str, schema: str | StructType, collection: str = WHOLE, meta: dict | None = None) -> DataFrame:
        """A collection as it stands; an empty one is committed where there is none."""
        now = self.read(table, collection)
        if now is None:
            self.commit(table, self.spark.createDataFrame([], schema), collection, meta=meta)
            now = self.read(table, collection)
        return now

    def commit(self, table: str, df: DataFrame, collection: str = WHOLE, tag: str = "", meta: dict | None = None) -> int:
        """A new version in which df replaces one collection; gives its number."""
        return self.commit_all(table, {collection: df}, tag, {collection: meta or {}})

    def commit_all(self, table: str, frames: dict[str, DataFrame], tag: str = "", meta: dict[str, dict] | None = None) -> int:
        """A new version in which frames replace the collections of their names, all at once; gives its number.

        Frames may be made from the version before, and what it says of a collection holds on where meta has nothing.
        """
        commits = self._commits(table)
        if tag:
            done = [v for v, rows in commits.items() if rows[0]["tag"] == tag]
            if done:
                return done[0]
        at = max(commits, default=0)
        commit = uuid.uuid4().hex
        rows = {r["collection"]: (r["folder"], r["n_rows"], r["schema"], r["meta"]) for r in commits.get(at, ())}
        for i, (collection, df) in enumerate(frames.items()):
            folder = f"{at + 1:08d}-{i}-{commit}"
            path = f"{self.root}/{table}/data/{folder}"
            df.write.mode("errorifexists").parquet(path)
            said = (meta or {}).get(collection)
            said = json.dumps(said) if said is not None else rows[collection][3] if collection in rows else "{}"
            rows[collection] = folder, self.spark.read.schema(df.schema).parquet(path).count(), df.schema.json(), said
        self._switch(table, [(at + 1, commit, tag, c, *r) for c, r in sorted(rows.items())])
        return at + 1

    def _switch(self, table: str, rows: list[tuple]) -> None:
        self.log(table)
        self.spark.createDataFrame(rows, _LOG).coalesce(1).write.mode("append").json(f"{self.root}/{table}/log")
