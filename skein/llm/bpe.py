"""Byte-level BPE as a tree reduction.

Encodings of strings form a monoid: the encoding of a concatenation follows from those of its halves
by re-encoding a window around the seam.  This holds on both levels.

Pieces: the pattern cuts a text into pieces from left to right, looking at most two characters past
a piece's first and one past its last.  So the pieces of the left half that end well before the seam
stand, and as soon as the scan of the window meets the start of a piece of the right half, all later
ones stand.  Tokens: a sequence of tokens is the encoding of its bytes if each two neighbours are the
encoding of theirs; the window grows on the side where the new neighbours are not.  Decoding
concatenates up the tree.

Defined cases: a null text is empty and gives no ids; very long texts and pieces only make the tree
deeper; each row is encoded alone, so ties and repeated rows need nothing special; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a text and bytes of a piece that a leaf of the tree takes.
TEXT_LEAF, PIECE_LEAF, ID_LEAF = 8192, 48, 8192
#: Encoded pieces that a worker remembers.
MEMORY = 300_000
_NONE = 1 << 60


class Encoder:
    """Ranks and pattern of one vocabulary, and the tree's leaves and joins."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.scan = ranks, regex.compile(pattern).findall
        self.by_id = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.by_id[i] = token
        self.known: dict[str, bytes] = {}

    # tokens of a piece

    def _leaf(self, piece: bytes) -> list[bytes]:
        """Merges the pair of lowest rank, leftmost first, until none is left."""
        rank = self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank(parts[i] + parts[i + 1], _NONE) for i in range(len(parts) - 1)]
        while pairs:
            low = min(pairs)
            if low == _NONE:
                break
            i = pairs.index(low)
            parts[i] += parts[i + 1]
            del parts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], _NONE)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], _NONE)
        return parts

    def _window(self, piece: bytes) -> list[bytes]:
        """As _leaf, with a heap for windows that have grown long."""
        if len(piece) <= 4 * PIECE_LEAF:
            return self._leaf(piece)
        rank, n = self.ranks.get, len(piece)
        ends, back = list(range(1, n + 1)), list(range(-1, n))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or ends[i] >= n or ends[ends[i]] != end:
                continue
            alive[ends[i]] = False
            ends[i] = end
            if end < n:
                back[end] = i
                if (r := rank(piece[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if (b := back[i]) >= 0 and (r := rank(piece[b:end])) is not None:
                heapq.heappush(heap, (r, b, end))
        return [piece[i : ends[i]] for i in range(n) if alive[i]]

    def _stable(self, a: bytes, b: bytes) -> bool:
        return self._window(a + b) == [a, b]

    def join_tokens(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        if not left or not right:
            return left + right
        i = j = 1
        while True:
            middle = self._window(b"".join(left[-i:] + right[:j]))
            left_ok = i >= len(left) or self._stable(left[-i - 1], middle[0])
            right_ok = j >= len(right) or self._stable(middle[-1], right[j])
            if left_ok and right_ok:
                return left[: max(0, len(left) - i)] + middle + right[j:]
            i, j = (i if left_ok else 2 * i), (j if right_ok else 2 * j)

    def tokens(self, piece: bytes) -> list[bytes]:
        if len(piece) <= PIECE_LEAF:
            return self._leaf(piece)
        half = len(piece) // 2
        return self.join_tokens(self.tokens(piece[:half]), self.tokens(piece[half:]))

    def piece_ids(self, piece: str) -> bytes:
        """The ids of one piece as little-endian 32-bit integers."""
        got = self.known.get(piece)
        if got is None:
            raw = piece.encode("utf-8")
            whole = self.ranks.get(raw)
            ids = [whole] if whole is not None else [self.ranks[t] for t in self.tokens(raw)]
            got = np.array(ids, "<u4").tobytes()
            if len(raw) <= 64:
                if len(self.known) >= MEMORY:
                    self.known.clear()
                self.known[piece] = got
        return got

    # pieces of a text

    def join_pieces(self, left: list[str], right: list[str]) -> list[str]:
        if not left or not right:
            return left + right
        # a piece that touches the seam, or starts within two characters of it, may change
        keep, tail = len(left) - 1, len(left[-1])
        while keep and tail + len(left[keep - 1]) < 3:
            keep -= 1
            tail += len(left[keep])
        while keep and tail < 3:
            keep -= 1
            tail += len(left[keep])
        loose, j = "".join(left[keep:]), 4
        while True:
            text = loose + "".join(right[:j])
            starts, at = {}, len(loose)
            for k, piece in enumerate(right[:j]):
                starts[at] = k
                at += len(piece)
            at, whole = 0, j >= len(right)
            scanned = self.scan(text)
            for m, piece in enumerate(scanned):
                if at in starts and m:
                    return left[:keep] + scanned[:m] + right[starts[at] :]
                if not whole and (at + len(piece) >= len(text) or at + 3 > len(text)):
                    break
                at += len(piece)
            else:
                return left[:keep] + scanned
            j *= 2

    def pieces(self, text: str) -> list[str]:
        if len(text) <= TEXT_LEAF:
            return self.scan(text)
        half = len(text) // 2
        return self.join_pieces(self.pieces(text[:half]), self.pieces(text[half:]))

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.piece_ids, self.pieces(text)))

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= ID_LEAF:
            return b"".join(map(self.by_id.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each vocabulary and worker; path must exist on every machine, as a package's file does."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return Encoder(ranks, pattern)


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def _map(df: DataFrame, columns: list, make, types: dict[str, pa.DataType], schema: str) -> DataFrame:
    """Rows (doc_id, x) to (doc_id, ...): make gives a tuple for each x of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = [make(x) for x in part.column(1).to_pylist()]
                made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types.values())]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names=["doc_id", *types])

    df = df.select("doc_id", *columns)
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {schema}")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers."""
    return _map(docs, ["text"], lambda x: (encoder(path, pattern).encode(x or ""),), {"ids": pa.binary()}, "ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) of rows (doc_id, ids)."""
    return _map(encoded, ["ids"], lambda x: (encoder(path, pattern).decode(np.frombuffer(x or b"", "<u4")),), {"bytes": pa.binary()}, "bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of encode and decode in one pass."""

    def digests(text: str | None) -> tuple:
        e = encoder(path, pattern)
        ids = e.encode(text or "")
        back = e.decode(np.frombuffer(ids, "<u4"))
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()

    types = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return _map(docs, ["text"], digests, types, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def with_tokens(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with n_tokens and token_ids array<int>; the input's columns of these names are replaced."""
    keep = [c for c in docs.columns if c not in ("n_tokens", "token_ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = [np.frombuffer(e.encode(x), "<u4").astype(np.int32) for x in _texts(part.column(text))]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
                cols = [part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(offsets), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=[*keep, "n_tokens", "token_ids"])

    schema = docs.select(*keep, F.lit(0).cast("long").alias("n_tokens"), F.array().cast("array<int>").alias("token_ids")).schema
    return docs.select(*keep).mapInArrow(run, schema)
