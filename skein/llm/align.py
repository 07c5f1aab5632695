"""Alignment of two tokenizers' tokens by a dangling-suffix transducer.

Tokens of A and B spell the same bytes.  The transducer reads from the side that is behind; its state
is which side leads and the bytes that the other has not matched yet.  Transitions are memoised by
state and token; an empty residual closes a group.  A's encoding is that of the vocabulary in a
``tokenizers`` file, made by the tiktoken library from the same entries (several times as fast, same
ids; the tests compare both); B is a sentencepiece model.

At a single space between two other characters the residual is always empty: A's pattern starts a
piece there, and no piece of B but runs of spaces holds a space after its first place.  So what stands
between two such spaces is a transition of its own, from the empty residual to the empty one, and is
memoised as a whole.  Where B's model has other pieces with inner spaces, texts are not cut.

Counts of linked pairs are summed over all documents: tasks sum up their own, totals are shuffled.  For
the sums of a document the pairs are looked up in the tasks while there are at most MOST_PAIRS; beyond
that the frequent ones are, and the others, each with a small share of all links, are joined.

Defined cases: null and empty texts, and texts whose tokens' bytes are not the text's (such as those
that hold U+2581), have no tokens: zeros and an empty string.  Very long texts are cut at spaces; rows
that repeat a doc_id are counted and returned each by itself; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Aligned words of a generation, and transitions, that a worker remembers; bytes of links that a task holds before it sends their sums on.
MEMORY, TRANSITIONS, HELD = 200_000, 1_000_000, 1 << 23
#: Most pairs that go to all tasks: 24 bytes each, 24 MB.
MOST_PAIRS = 1 << 20
#: Single spaces between other characters.
SEAM = re.compile(r"(?<=\S) (?=\S)")


class Transducer:
    """States are residuals: 0 is the empty one, others have the leading side's unmatched bytes."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.bytes = (a_bytes, b_bytes)
        self._forget()

    def _forget(self) -> None:
        self.rest: list[tuple[int, bytes]] = [(1, b"")]  # (side that leads, bytes); of the empty one B is said to lead, so that A is read
        self.reads = [0]
        self.memo: list[dict[int, int]] = [{}]
        self.state = {b"": 0}
        self.known = 0

    def _step(self, state: int, token: int) -> int:
        """The state after a token of the side that is behind; -1 where the bytes differ."""
        lead, rest = self.rest[state]
        new = self.bytes[1 - lead][token]
        if rest.startswith(new):
            side, left = lead, rest[len(new) :]
        elif new.startswith(rest):
            side, left = 1 - lead, new[len(rest) :]
        else:
            return -1
        key = bytes((side,)) + left if left else b""
        to = self.state.get(key)
        if to is None:
            to = self.state[key] = len(self.rest)
            self.rest.append((side, left))
            self.reads.append(1 - side)
            self.memo.append({})
        self.memo[state][token] = to
        self.known += 1
        return to

    def ends(self, a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
        """(tokens of A, tokens of B) read when each group closes; None where the two spell different bytes."""
        if self.known > TRANSITIONS:
            self._forget()
        n_a, n_b, memo, reads = len(a), len(b), self.memo, self.reads
        state, i, j, out = 0, 0, 0, []
        while state or i < n_a or j < n_b:
            if reads[state]:
                if j == n_b:
                    return None
                token = b[j]
                j += 1
            else:
                if i == n_a:
                    return None
                token = a[i]
                i += 1
            to = memo[state].get(token)
            if to is None:
                to = self._step(state, token)
                if to < 0:
                    return None
            state = to
            if not to:
                out.append((i, j))
        return out


class Aligned(NamedTuple):
    """A run of text: tokens of both sides, its groups as text, and its links as bytes of integers a * (size of B) + b."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    links: bytes


class Aligner:
    """Both tokenizers, and what a worker remembers: recent runs, and those of the generation before."""

    def __init__(self, a_path: str, b_path: str, pattern: str):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model.get("added_tokens", [])}
        ranks = {_entry_bytes(t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            a_bytes[i] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes((int(p[3:5], 16),)) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cut = all(p.strip("▁") == "" for p in pieces if "▁" in p[1:])
        self.size = len(pieces)
        self.kind = np.dtype(np.int32 if len(a_bytes) * self.size < 2**31 else np.int64)
        self.transducer = Transducer(a_bytes, b_bytes)
        self.spaced = [x.startswith(b" ") for x in a_bytes]
        self.a_bytes, self.names = a_bytes, [str(i) for i in range(max(len(a_bytes), self.size))]
        self.recent: dict[str, tuple | bool] = {}
        self.older: dict[str, tuple | bool] = {}

    def runs(self, text: str) -> list[str]:
        return SEAM.split(text) if self.cut else [text]

    def _align(self, runs: list[str]) -> list[tuple | bool]:
        """Each run's alignment as a tuple, or False; of several runs none holds a space, so that a token of A that begins with one begins a run."""
        text = " ".join(runs)
        a, b = self.a.encode_ordinary(" " + text), self.b.encode(text)
        ends = self.transducer.ends(a, b)
        if ends is None or b"".join([self.a_bytes[i] for i in a]) != (" " + text).encode():
            return [x for r in runs for x in self._align([r])] if len(runs) > 1 else [False]
        names, size, spaced, kind, several = self.names, self.size, self.spaced, self.kind.char, len(runs) > 1
        out, groups, links = [], [], []
        i = j = first_i = first_j = 0
        for x, y in ends:
            if several and i and spaced[a[i]]:
                out.append((i - first_i, j - first_j, len(links), ";".join(groups), array(kind, links).tobytes()))
                groups, links, first_i, first_j = [], [], i, j
            left = names[a[i]] if x == i + 1 else ",".join([names[k] for k in a[i:x]])
            right = names[b[j]] if y == j + 1 else ",".join([names[k] for k in b[j:y]])
            groups.append(f"{left}|{right}")
            links.append(a[x - 1] * size + b[y - 1])
            i, j = x, y
        out.append((i - first_i, j - first_j, len(links), ";".join(groups), array(kind, links).tobytes()))
        return out

    def _learn(self, runs: list[str]) -> dict[str, tuple | bool]:
        """Alignments of the runs that are not among the recent ones."""
        older, found, plain = self.older, {}, []
        for r in dict.fromkeys(runs):
            if r not in self.recent:
                if r in older:
                    found[r] = older[r]
                elif " " not in r and r == r.strip():
                    plain.append(r)
                else:
                    found[r] = self._align([r])[0]
        for at in range(0, len(plain), 256):
            part = plain[at : at + 256]
            found.update(zip(part, self._align(part)))
        return found

    def text(self, text: str | None) -> Aligned | None:
        """A text's alignment; None where it has no tokens."""
        if not text:
            return None
        runs = self.runs(text)
        parts = list(map(self.recent.get, runs))
        if None in parts:
            found = self._learn([r for r, p in zip(runs, parts) if p is None])
            parts = [p if p is not None else found[r] for r, p in zip(runs, parts)]
            if len(self.recent) > MEMORY:
                self.older, self.recent = self.recent, {}
            self.recent.update((r, p) for r, p in found.items() if len(r) <= 48)
        if False in parts:
            return None
        n_a, n_b, n_groups, groups, links = zip(*parts)
        return Aligned(sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), b"".join(links))


def _entry_bytes(entry: str) -> bytes:
    """The bytes of a byte-level vocabulary entry, in which each byte is written as one character."""
    return bytes(map(_BYTE_OF.__getitem__, entry))


def _byte_characters() -> dict[str, int]:
    """Printable bytes stand for themselves; the others, in order, for the characters from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


_BYTE_OF = _byte_characters()


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str, pattern: str) -> Aligner:
    """One for each worker; the files must exist on every machine, as a package's files do."""
    return Aligner(a_path, b_path, pattern)


@contextmanager
def _no_collection():
    """No search for reference cycles meanwhile: what a worker remembers has none, and to scan it takes a fifth of the time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def alignments(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """(doc_id, groups array<struct<a array<int>, b array<int>>>) of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(a_path, b_path, pattern)
        ids = lambda s: [int(x) for x in s.split(",")]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, made = batch.slice(at, 256), []
                for text in part.column("text").to_pylist():
                    done = al.text(text)
                    made.append([dict(zip("ab", map(ids, g.split("|")))) for g in done.groups.split(";")] if done else [])
                kind = pa.list_(pa.struct({"a": pa.list_(pa.int32()), "b": pa.list_(pa.int32())}))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(made, kind)], names=["doc_id", "groups"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, groups array<struct<a:array<int>,b:array<int>>>")


def linked(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, links) of every row of docs (doc_id, text): links as bytes of integers a * (size of B) + b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(a_path, b_path, pattern)
        kinds = (*[pa.int64()] * 3, pa.string(), pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, made = batch.slice(at, 256), []
                with _no_collection():
                    results = [al.text(t) for t in part.column("text").to_pylist()]
                for done in results:
                    made.append((*done[:3], hashlib.sha256(done.groups.encode()).hexdigest(), done.links) if done else (0, 0, 0, "", b""))
                cols = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, groups_sha256 string, links binary")


def pair_counts(rows: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """(pair, b, n, best): how many links of all rows (links) have a pair, and whether no pair of its B token has more; pair is a * (size of B) + b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(a_path, b_path, pattern)
        held, size = [], 0

        def summed():
            pairs, counts = np.unique(np.frombuffer(b"".join(held), al.kind), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array((pairs % al.size).astype(np.int32)), pa.array(counts.astype(np.int64))], names=["pair", "b", "n"])

        for batch in batches:
            for links in batch.column("links"):
                held.append(links.as_py())
                size += len(held[-1])
                if size >= HELD:
                    yield summed()
                    held, size = [], 0
        if held:
            yield summed()

    found = rows.select("links").mapInArrow(run, "pair long, b int, n long").groupBy("pair", "b").agg(F.sum("n").alias("n"))
    found = written(found, "pair-counts")
    # a row for each token of B at most
    top = found.groupBy("b").agg(F.max("n").alias("top"))
    return written(found.join(F.broadcast(top), "b").select("pair", "b", "n", (F.col("n") == F.col("top")).alias("best")), "pair-counts")


def _frequent(counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The at most ``most`` pairs for all tasks to hold, and the rest if there is one: no pair of the rest occurs more often than one of the first."""
    if counts.count() <= most:
        return counts, None
    size = F.floor(8 * F.log2("n")).cast("int")
    taken, least = 0, None
    for row in counts.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():
        taken += row["count"]
        if taken > most:
            break
        least = row["size"]
    first = F.lit(False) if least is None else size >= least
    return counts.where(first), counts.where(~first)


def token_links(docs: DataFrame, a_path: str, b_path: str, pattern: str, most: int = MOST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs (doc_id, text)."""
    rows = written(linked(docs, a_path, b_path, pattern), "token-links")
    first, rest = _frequent(pair_counts(rows, a_path, b_path, pattern), most)
    held = first.select("pair", "n", F.col("best").cast("long").alias("best")).toArrow().sort_by("pair")
    table = docs.sparkSession.sparkContext.broadcast(np.stack([held.column(c).to_numpy() for c in ("pair", "n", "best")]))
    same = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(a_path, b_path, pattern)
        pairs, n, best = table.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, made = batch.slice(at, 256), []
                for raw in part.column("links"):
                    links = np.frombuffer(raw.as_py(), al.kind)
                    place = np.searchsorted(pairs, links)
                    hit = place < len(pairs)
                    hit[hit] = pairs[place[hit]] == links[hit]
                    place = place[hit]
                    made.append((int(best[place].sum()), int(n[place].sum()), links[~hit].astype(np.int64)))
                cols = [pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in same), *cols], names=[*same, "n_best", "count_sum", "others"])

    schema = rows.select(*same, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"), F.array().cast("array<long>").alias("others")).schema
    done = rows.mapInArrow(run, schema)
    if rest is not None:
        done = written(done.withColumn("_row", F.monotonically_increasing_id()), "token-links")
        more = done.select("_row", F.explode("others").alias("pair")).join(rest, "pair").groupBy("_row").agg(F.sum("n").alias("_n"), F.sum(F.col("best").cast("long")).alias("_best"))
        done = done.join(more, "_row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_n", F.lit(0))})
    return done.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
