"""Exact removal of repeated byte strings with partitioned enhanced suffix arrays.

Every string of SIZE bytes has one anchor: the place of its smallest hash of GRAM bytes (leftmost of
equal ones).  Equal strings have equal anchors at the same offset, so strings need comparing only
within the groups of one anchor hash, and those whose hash occurs once in the corpus fall out before
any text is moved (a filter of fixed size; what it lets through too much is found to be alone later).

A context is the bytes around an anchor that its strings take.  Of equal contexts in one document
(runs of one byte give one at each place) only the first travels, the others are removed spans at
once.  What is left goes to its hash's task.  There equal contexts are collapsed to the oldest, and of
those that differ an enhanced suffix array is built: their suffixes of SIZE bytes at least, sorted, with
the longest common prefixes of neighbours.  One scan with a stack gives the intervals of its
common-prefix tree; those whose suffixes have different bytes before them (left-diverse) are the
maximal repeats within the contexts, with all occurrences, and all but the oldest occurrence go.  An
interval that is not left-diverse is part of the one that begins a byte earlier.
:func:`repeat_groups` lists the groups.  A hash with more than HOT anchors goes to no single task:
its equal contexts, and then the strings of different ones, are compared byte by byte in Spark's own
aggregations and joins, which spill.

Defined cases: a null or empty text has no bytes; documents under SIZE bytes lose nothing; matches
never cross documents; rows that repeat a doc_id with the same text are one document, which each of
them reports; a null doc_id comes before all others; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_table, has_bit, log2_bits, slot_bits, written
from .textbytes import BYTE_HASH, byte_chunks, mix

SIZE, GRAM = 100, 32
#: Largest offset of an anchor in its string.
REACH = SIZE - GRAM
#: Anchors that a task looks at together (more only if one hash has more), and the most of one hash.
TOGETHER, HOT = 8_000, 20_000
#: Suffixes that are sorted together (more only if one hash has more).
SUFFIXES = 60_000
#: Hashes with more than HOT anchors that are sent to all tasks as a list; more are told apart by joins.
LISTED = 100_000
#: In place of a hash: the row is a removed span.
_SPAN = -(2**63)
_STEP = 0x5851F42D4C957F2D
_BACK = pow(_STEP, -1, 1 << 64)


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op (minimum or maximum) over each width consecutive values."""
    n = len(x)
    pad = -n % width
    fill = np.iinfo(x.dtype).max if op is np.minimum else 0
    y = np.concatenate([x, np.full(pad, fill, x.dtype)]).reshape(-1, width)
    ahead = op.accumulate(y, axis=1).ravel()
    behind = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, place, first string, last string, hash of the context) of the anchors of all strings of SIZE bytes.

    A string may get more than one anchor where hashes tie; equal strings get the same ones.
    """
    n = len(data)
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64))
    if n < SIZE:
        return none
    powers = np.ones(n, np.uint64)
    powers[1:] = np.cumprod(np.full(n - 1, _STEP, np.uint64), dtype=np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_HASH[data] * powers, out=total[1:])
    back = powers[: n - GRAM + 1]
    back[1:] = np.cumprod(np.full(n - GRAM, _BACK, np.uint64), dtype=np.uint64)
    gram = mix((total[GRAM:] - total[:-GRAM]) * back)
    low = _sliding(gram, REACH + 1, np.minimum)
    # a place is an anchor if it holds the minimum of some string that reaches it
    wide = np.concatenate([np.zeros(REACH, np.uint64), low, np.zeros(REACH, np.uint64)])
    at = np.flatnonzero(_sliding(wide, REACH + 1, np.maximum) == gram)
    value = gram[at]
    # the next anchor takes over when this one is left behind, or at once if it is smaller
    last = np.minimum(at, n - SIZE)
    if len(at) > 1:
        smaller = value[1:] < value[:-1]
        last[:-1] = np.where(smaller, at[1:] - REACH - 1, last[:-1])
    first = np.maximum(0, at - REACH)
    if len(at) > 1:
        taken = np.where(smaller, at[1:] - REACH, at[:-1] + 1)
        first[1:] = np.maximum(first[1:], taken)
    doc = np.searchsorted(offsets, at, "right") - 1
    first, last = np.maximum(first, offsets[doc]), np.minimum(last, offsets[doc + 1] - SIZE)
    ok = first <= last
    value, at, first, last = value[ok], at[ok], first[ok], last[ok]
    return value, at, first, last, mix((total[last + SIZE] - total[first]) * back[first])


def _anchor_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, offsets in byte_chunks(batch.column("text")):
            h, n = np.unique(anchors(data, offsets)[0].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n, pa.int64())], names=["h", "n"])


def _again(raw: bytes, doc: np.ndarray, key: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether the bytes [first, end) stand before in the same document under an equal key; rows go from left to right."""
    order = np.lexsort((first, key, doc))
    now, past = order[1:], order[:-1]
    same = (doc[now] == doc[past]) & (key[now] == key[past])
    now, past = now[same], past[same]
    out = np.zeros(len(doc), bool)
    out[now] = [raw[a:b] == raw[c:d] for a, b, c, d in zip(first[now].tolist(), end[now].tolist(), first[past].tolist(), end[past].tolist())]
    return out


def _contexts(bits, listed: np.ndarray | None = None, inside: bool = False):
    """For mapInArrow: contexts of anchors that pass the filter; of listed hashes only these (inside), or all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy() for c in ("d", "th"))
            for row, data, offsets in byte_chunks(batch.column("text")):
                h, at, first, last, whole = anchors(data, offsets)
                if not len(h):
                    continue
                slot = h & np.uint64(64 * len(table) - 1)  # an anchor's hash is a minimum, so its upper bits are low
                hit = (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
                if listed is not None:
                    hit &= np.isin(h.view(np.int64), listed, invert=not inside)
                h, at, first, end, whole = h[hit], at[hit], first[hit], last[hit] + SIZE, whole[hit]
                doc = np.searchsorted(offsets, at, "right") - 1
                raw = data.tobytes()
                again = _again(raw, doc, mix(whole ^ mix(h) ^ ((at - first) * 128 + (end - at)).astype(np.uint64)), first, end)
                span_doc, a, b = doc[again], first[again], end[again]
                if len(a):
                    new = np.concatenate([[True], (span_doc[1:] != span_doc[:-1]) | (a[1:] > b[:-1])])
                    span_doc, a, b = span_doc[new], a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
                h, at, first, end, doc = (x[~again] for x in (h, at, first, end, doc))
                around = pa.array([*(raw[i:j] for i, j in zip(first.tolist(), end.tolist())), *[None] * len(a)], pa.binary())
                both = np.concatenate([doc, span_doc])
                cols = [pa.array(np.concatenate(x).astype(t), k) for x, t, k in (
                    ([h.view(np.int64), np.full(len(a), _SPAN)], np.int64, pa.int64()), ([ids[row + both]], np.int64, pa.int64()), ([keys[row + both]], np.int64, pa.int64()),
                    ([at - offsets[doc], a - offsets[span_doc]], np.int64, pa.int64()), ([at - end + SIZE, np.zeros(len(a))], np.int32, pa.int32()), ([at - first, b - a], np.int32, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*cols, around], names=["h", "d", "th", "at", "o_min", "o_max", "around"])

    return run


def intervals(lcp: np.ndarray, before: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the left-diverse intervals of a suffix array that are at least that deep, inner ones first.

    lcp: the common prefix of each suffix with the one before it; before: the byte before each suffix, in
    the array's order, or -1 where there is none.  One scan with a stack; an interval knows whether one
    byte stands before all of its suffixes.
    """
    deep = np.flatnonzero(lcp >= least)
    for run in np.split(deep, np.flatnonzero(np.diff(deep) > 1) + 1) if len(deep) else ():
        stack: list[list] = []  # depth, first row, byte before all (None if they differ)
        begin = int(run[0]) - 1
        ends = [*lcp[run[0] : run[-1] + 1].tolist(), -1]
        bytes_before = before[begin : int(run[-1]) + 1].tolist()
        for i, depth in enumerate(ends):
            byte, start = bytes_before[i], i
            byte = byte if byte >= 0 else None
            while stack and stack[-1][0] > depth:
                length, start, seen = stack.pop()
                byte = seen if seen == byte else None
                if byte is None:
                    yield length, begin + start, begin + i
            if stack and stack[-1][0] == depth:
                if stack[-1][2] != byte:
                    stack[-1][2] = None
            elif depth >= least:
                stack.append([depth, start, byte])


def maximal_repeats(keys: np.ndarray, before: np.ndarray, least: int) -> list[tuple[int, list[int]]]:
    """(length, rows) of the maximal repeats, at least that long, of the suffixes in a byte matrix."""
    order, lcp = _sorted_with_lcp(keys, np.full(len(keys), keys.shape[1]))
    return [(length, order[a : b + 1].tolist()) for length, a, b in intervals(lcp, before[order], least)]


def _sorted_with_lcp(keys: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte matrix, of which each has so many bytes, and the common prefix of each row with the one before it."""
    order = np.argsort(size, kind="stable")  # an end sorts before any byte, zero as well
    order = order[np.argsort(np.ascontiguousarray(keys[order]).view(f"S{keys.shape[1]}").ravel(), kind="stable")]
    a, b = keys[order[1:]], keys[order[:-1]]
    differ = a != b
    lcp = np.where(differ.any(1), differ.argmax(1), keys.shape[1])
    return order, np.concatenate([[-1], np.minimum(lcp, np.minimum(size[order[1:]], size[order[:-1]]))])


class _Group:
    """Anchors of some hashes: their contexts, the equal ones collapsed, and the repeats of those that differ."""

    def __init__(self, rows: pa.Table):
        h = rows.column("h").to_numpy()
        group = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) - 1
        several = np.flatnonzero(np.bincount(group)[group] > 1)
        rows, group = rows.take(pa.array(several, pa.int64())), group[several]
        self.doc, self.key, at, o_min, o_max = (rows.column(c).to_numpy().astype(np.int64) for c in ("d", "th", "at", "o_min", "o_max"))
        self.begin, self.size, self.group = at - o_max, SIZE + o_max - o_min, group
        around = rows.column("around").combine_chunks()
        self.bytes = around.to_pylist()
        code = around.dictionary_encode().indices.to_numpy() if len(around) else np.zeros(0, np.int64)
        # the oldest of equal contexts stands for all
        order = np.lexsort((at, self.key, self.doc, o_max, code, group))
        parts = (group[order], code[order], o_max[order])
        new = np.concatenate([[True], np.logical_or.reduce([p[1:] != p[:-1] for p in parts])]) if len(order) else np.zeros(0, bool)
        self.context = np.empty(len(order), np.int64)
        self.context[order] = np.cumsum(new) - 1
        self.oldest = order[new]

    def copies(self) -> np.ndarray:
        """Rows whose context stands in an older row."""
        o = self.oldest[self.context]
        return np.flatnonzero((self.doc != self.doc[o]) | (self.key != self.key[o]) | (self.begin != self.begin[o]))

    def repeats(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
        """(row, place, age, intervals): suffixes in the order of their array, by part; an interval's ends are places in it."""
        rows = self.oldest
        rows = rows[np.bincount(self.group[rows])[self.group[rows]] > 1] if len(rows) else rows
        many = self.size[rows] - SIZE + 1
        whole = np.cumsum(np.bincount(self.group[rows], many) if len(rows) else np.zeros(0))
        part = (whole[self.group[rows]] // SUFFIXES).astype(np.int64) if len(rows) else rows
        for p in np.unique(part).tolist():
            yield self._part(rows[part == p])

    def _part(self, rows: np.ndarray):
        size = self.size[rows]
        many = size - SIZE + 1
        flat = np.frombuffer(b"".join(self.bytes[r] for r in rows.tolist()) + bytes(SIZE + REACH), np.uint8)
        at = np.concatenate([[0], np.cumsum(size)[:-1]])
        which = np.repeat(np.arange(len(rows)), many)
        place = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        keys = np.empty((len(which), 4 + SIZE + REACH), np.uint8)
        keys[:, :4] = self.group[rows][which].astype(">u4").view(np.uint8).reshape(-1, 4)
        keys[:, 4:] = np.lib.stride_tricks.sliding_window_view(flat, SIZE + REACH)[at[which] + place]
        left = size[which] - place
        keys[:, 4:][np.arange(SIZE + REACH) >= left[:, None]] = 0
        order, lcp = _sorted_with_lcp(keys, left + 4)
        before = np.where(place > 0, flat[np.maximum(at[which] + place - 1, 0)].astype(np.int64), -1)
        row, place = rows[which][order], place[order]
        start = self.begin[row] + place
        by_age = np.lexsort((start, self.key[row], self.doc[row]))
        a, b = by_age[1:], by_age[:-1]
        older = (self.doc[row[a]] != self.doc[row[b]]) | (self.key[row[a]] != self.key[row[b]]) | (start[a] != start[b])
        age = np.zeros(len(row), np.int64)
        age[a] = np.cumsum(older)
        return row, place, age, [(length - 4, i, j) for length, i, j in intervals(lcp, before[order], SIZE + 4)]

    def spans(self) -> pa.RecordBatch:
        """(d, th, a, b): what is no oldest occurrence."""
        rows, begin, size = [self.copies()], [], []
        begin.append(self.begin[rows[0]])
        size.append(self.size[rows[0]])
        for row, place, age, found in self.repeats():
            length = np.zeros(len(row), np.int64)
            for n, i, j in found:
                later = (age[i : j + 1] > age[i : j + 1].min()) & (length[i : j + 1] == 0)
                length[i : j + 1][later] = n
            hit = length > 0
            rows.append(row[hit])
            begin.append(self.begin[row[hit]] + place[hit])
            size.append(length[hit])
        row, a, n = np.concatenate(rows), np.concatenate(begin), np.concatenate(size)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (self.doc[row], self.key[row], a, a + n)], names=["d", "th", "a", "b"])

    def groups(self) -> pa.RecordBatch:
        """(length, occurrences): the contexts with copies and the maximal repeats of the others, with all occurrences."""
        members = np.split(np.argsort(self.context, kind="stable"), np.flatnonzero(np.diff(np.sort(self.context))) + 1) if len(self.context) else []
        found = [(int(self.size[m[0]]), [(r, 0) for r in m.tolist()]) for m in members if len(m) > 1]
        for row, place, _, repeats in self.repeats():
            found += [(n, [(r, p) for k in range(i, j + 1) for p in (int(place[k]),) for r in members[self.context[row[k]]].tolist()]) for n, i, j in repeats]
        kind = pa.list_(pa.struct([("d", pa.int64()), ("th", pa.int64()), ("start", pa.int64())]))
        each = [[{"d": int(self.doc[r]), "th": int(self.key[r]), "start": int(self.begin[r]) + p} for r, p in occurrences] for _, occurrences in found]
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array(each, kind)], names=["length", "occurrences"])


def _by_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by h in tables of about TOGETHER that no hash is cut by."""
    waiting: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        waiting.append(batch)
        n += batch.num_rows
        if n >= TOGETHER:
            rows = pa.Table.from_batches(waiting)
            h = rows.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1], "left"))
            if cut:
                yield rows.slice(0, cut)
                waiting = rows.slice(cut).to_batches()
                n -= cut
    if n:
        yield pa.Table.from_batches(waiting)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h to (d, th, a, b): bytes [a, b) repeat earlier ones; rows that are spans already come first."""
    own: list[pa.RecordBatch] = []

    def contexts() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = int((batch.column("h").to_numpy() == _SPAN).sum())
            d, th, a, size = (batch.column(c).slice(0, n).cast(pa.int64()) for c in ("d", "th", "at", "o_max"))
            own.append(pa.RecordBatch.from_arrays([d, th, a, pc.add(a, size)], names=["d", "th", "a", "b"]))
            yield batch.slice(n)

    for rows in _by_hash(contexts()):
        yield from own
        own.clear()
        yield _Group(rows).spans()
    yield from own


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _by_hash(batches):
        yield _Group(rows).groups()


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
        kept, runs = [], []
        for text, found in zip(texts, spans):
            raw, merged = (text or "").encode(), []
            for s in found or ():
                if merged and s["a"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s["b"])
                else:
                    merged.append([s["a"], s["b"]])
            edges = [0, *(x for m in merged for x in m), len(raw)]
            kept.append(b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
            runs.append([{"a": a, "b": b} for a, b in merged])
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        n_bytes = [len((t or "").encode()) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def _parted(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Contexts of hashes with HOT anchors at most, and removed spans of all, and contexts of hashes with more (None without such)."""
    spark = docs.sparkSession
    often = docs.select("text").mapInArrow(_anchor_hashes, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    often = written(often.select("h", (F.col("n") > HOT).alias("hot")), "anchor-hashes")
    hot = often.where("hot").select("h")
    few = hot.limit(LISTED + 1).toArrow().column("h").to_numpy()

    def contexts(hashes: DataFrame, *which) -> DataFrame:
        log2 = log2_bits(hashes.count())
        bits = spark.sparkContext.broadcast(slot_bits(hashes, F.col("h").bitwiseAND(F.lit((1 << log2) - 1)), log2))
        return docs.mapInArrow(_contexts(bits, *which), "h long, d long, th long, at long, o_min int, o_max int, around binary")

    if not len(few):
        return contexts(often), None
    if len(few) <= LISTED:
        return contexts(often, few), contexts(hot, few, True)
    return contexts(often).join(hot, "h", "left_anti"), contexts(hot).join(hot, "h", "left_semi")


def _hot_spans(near: DataFrame) -> DataFrame:
    """(d, th, a, b) for contexts of which one hash may have any number."""
    who, context = F.struct("d", "th", "at"), ["h", "o_min", "o_max", "around"]
    firsts = written(near.groupBy(*context).agg(F.min(who).alias("first"), F.count("*").alias("n")), "hot-firsts")
    # all strings of a context stand where it stood first
    later = near.join(firsts.where("n > 1").drop("n"), context).where(who > F.col("first"))
    later = later.select("d", "th", (F.col("at") - F.col("o_max")).alias("a"), (F.col("at") - F.col("o_min") + SIZE).alias("b"))
    strings = firsts.select("h", "first.*", "o_max", "around", F.explode(F.sequence("o_min", "o_max")).alias("o"))
    strings = strings.select("h", "o", "d", "th", "at", F.substring("around", F.col("o_max") - F.col("o") + 1, F.lit(SIZE)).alias("string"))
    oldest = strings.groupBy("h", "o", "string").agg(F.min(who).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = strings.join(oldest, ["h", "o", "string"]).where(who > F.col("first"))
    again = again.groupBy("d", "th", "at").agg((F.col("at") - F.max("o")).alias("a"), (F.col("at") - F.min("o") + SIZE).alias("b"))
    return later.union(again.select("d", "th", "a", "b"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(d, th, a, b) for rows (d, th, text): spans [a, b) of documents, unmerged."""
    near, hot = _parted(docs)
    spread = F.when(F.col("h") == _SPAN, F.col("d")).otherwise(F.col("h"))
    spans = near.repartition(spread).sortWithinPartitions("h").mapInArrow(_spans, "d long, th long, a long, b long")
    if hot is None:
        return spans
    hot = written(hot, "hot-contexts")
    own = hot.where(F.col("h") == _SPAN).select("d", "th", F.col("at").alias("a"), (F.col("at") + F.col("o_max")).alias("b"))
    return spans.union(own).union(_hot_spans(hot.where(F.col("h") != _SPAN)))


def repeat_groups(docs: DataFrame) -> DataFrame:
    """(length, occurrences array<struct<d, th, start>>) for rows (d, th, text): maximal repeats within contexts, with all occurrences.

    Not listed: hashes of more than HOT anchors, and repeats of a context inside one document but its first.
    """
    near = _parted(docs)[0].where(F.col("h") != _SPAN)
    return near.repartition("h").sortWithinPartitions("h").mapInArrow(_groups, "length long, occurrences array<struct<d:long,th:long,start:long>>")


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<a, b>>, kept binary) for every row of docs (doc_id, text).

    spans are the removed runs of bytes, kept what is left.
    """
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64("text").alias("th"))
    spans = repeated_spans(keyed.select("d", "th", "text"))
    spans = spans.groupBy("d", "th").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))
    spans = written(spans, "spans")
    table = bit_table(spans.select("d"), "d")
    marked = has_bit(keyed, "d", table)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes long, spans array<struct<a:long,b:long>>, kept binary"
    hit = marked.where("maybe").join(spans, ["d", "th"], "left").select("doc_id", "text", "spans").mapInArrow(_remove, schema)
    text = F.coalesce("text", F.lit(""))
    whole = marked.where("not maybe").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.array().cast("array<struct<a:long,b:long>>").alias("spans"), text.cast("binary").alias("kept"))
    return hit.unionByName(whole)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of :func:`without_repeats`."""
    return without_repeats(docs).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
