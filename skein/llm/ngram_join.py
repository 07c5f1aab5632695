"""Exact n-gram Jaccard join with size-banded tiles and hashed bitmap signatures.

A document's set is its distinct word n-grams as 64-bit hashes; documents with equal sets share one
node (a 64-bit hash of the set).  Hashes have one global order, rarest first as far as a sketch of
fixed size can tell, and two sets that reach the threshold share one of the first hashes of each
(prefix filter), so a tile holds the nodes with one such hash.  Of two such sets the smaller one has
it among still fewer of its first hashes, as its overlap has to reach 2 t / (1 + t) of its size and
not only t; tiles and bands in which no node has it so early are left out.

Links are found in two steps.  First each node is compared with one leader only: the oldest node of
most of its tiles.  That connects the usual group of near copies with one comparison each.  Then
whatever tiles still hold nodes of several components are split into size bands, and nodes of
different components are compared if the bit counts of their bitmaps leave room for the overlap.
Bitmaps hold the parity of the hashes that fall on a bit, so each bit in which two differ is an
element that only one of them has: |A & B| <= (|A| + |B| - differing bits) / 2.  Pairs that pass get
the exact intersection of their sorted arrays.  Pairs inside a component are not compared: they
cannot change the components.

Defined cases: a null or empty text and one without words has an empty set, links with nothing and
is its own component; with fewer than n words the whole sequence is one gram; repeated rows have
equal sets and so one component; a row with a null doc_id has a null component of its own unless
linked with others; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bit_table, components, has_bit, without_ids, written
from .textbytes import BYTE_HASH, byte_chunks, mix

#: Cells of the frequency sketch: a fixed size.
LOG2_CELLS = 18
#: Nodes that are compared with one node in a group; larger groups are split.
GROUP = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_ODD = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def gram_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-grams."""
    for _, data, offsets in byte_chunks(column):
        rows = len(offsets) - 1
        if not len(data):
            yield from (np.zeros(0, np.uint64) for _ in range(rows))
            continue
        gap = _GAP[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        inside = ~gap
        first = inside & (np.concatenate(([True], gap[:-1])) | edge[:-1])
        starts = np.flatnonzero(first)
        if not len(starts):
            yield from (np.zeros(0, np.uint64) for _ in range(rows))
            continue
        # a word's hash: its bytes' values times powers of an odd number by place, summed, mixed
        place = np.zeros(len(data), np.int64)
        place[starts[0] :] = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
        longest = int(place.max()) + 1
        powers = np.ones(longest, np.uint64)
        powers[1:] = np.cumprod(np.full(longest - 1, 0x5851F42D4C957F2D, np.uint64), dtype=np.uint64)
        value = BYTE_HASH[_LOWER[data]] * powers[place]
        value[gap] = 0
        word = mix(np.add.reduceat(value, starts))
        bounds = np.searchsorted(starts, offsets)
        total = len(word)
        grams = np.zeros(total, np.uint64)
        for k in range(n):
            grams[: max(0, total - k)] += word[k:] * _ODD[k]
        grams = mix(grams)
        for i in range(rows):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield mix(np.array([(word[a:b] * _ODD[32 : 32 + b - a]).sum() + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def _node(s: np.ndarray) -> int:
    """A hash of the whole set."""
    return int(mix(np.array([mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _words(size: int) -> int:
    """Words of a bitmap: a power of two with at least a bit for each element."""
    return 1 << max(3, (size // 64).bit_length())


def _tile_words(size: int, percent: int) -> int:
    """Words of the bitmaps that tiles move: a power of two.

    Two sets of a size that can link differ in at most 2 (1 - t) / (1 + t) of that size, and bitmaps
    of unrelated sets in half their bits, so three times as many bits as the first tell them apart.
    """
    bits = 6 * size * (100 - percent) // (100 + percent)
    return 1 << max(2, (bits // 64).bit_length())


def _bitmap(s: np.ndarray, words: int) -> np.ndarray:
    """Bit b is the parity of the number of elements that fall on b."""
    odd = np.bincount((s % np.uint64(words * 64)).astype(np.int64), minlength=words * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _sketch(docs: DataFrame, n: int) -> np.ndarray:
    """How many (document, gram) fall on each cell; its size does not depend on the input."""
    cells, part = 1 << LOG2_CELLS, 1 << 12

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(cells, np.int64)
        for batch in batches:
            for s in gram_sets(batch.column("text"), n):
                seen += np.bincount((s >> np.uint64(64 - LOG2_CELLS)).astype(np.int64), minlength=cells) if len(s) > 4096 else 0
                if len(s) <= 4096:
                    np.add.at(seen, (s >> np.uint64(64 - LOG2_CELLS)).astype(np.int64), 1)
        if seen.any():
            blocks = seen.reshape(-1, part)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(blocks) + 1) * part, pa.int32()), pa.array(blocks.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks)), pa.int32()), lists], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, values in zip(batch.column("block").to_pylist(), batch.column("counts")):
                sums[block] = sums.get(block, 0) + values.values.to_numpy()
        for block, values in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([values.tolist()], pa.list_(pa.int64()))], names=["block", "counts"])

    schema = "block int, counts array<bigint>"
    out = np.zeros((cells // part, part), np.int64)
    for row in docs.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).collect():
        out[row["block"]] = row["counts"]
    return out.ravel()


def _features(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, node, prefix, bits) of every row."""
    sketch = docs.sparkSession.sparkContext.broadcast(_sketch(docs, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = sketch.value
        for batch in batches:
            sizes, nodes, prefixes, bits = [], [], [], []
            for s in gram_sets(batch.column("text"), n):
                size = len(s)
                sizes.append(size)
                nodes.append(_node(s) if size else None)
                order = np.lexsort((s, often[(s >> np.uint64(64 - LOG2_CELLS)).astype(np.int64)]))
                prefixes.append(s[order[: size - (percent * size + 99) // 100 + 1]].view(np.int64) if size else s.view(np.int64))
                bits.append(_bitmap(s, _tile_words(size, percent)))
            lists = [_lists(x) for x in (prefixes, bits)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), *lists], names=["doc_id", "n_shingles", "node", "prefix", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, node long, prefix array<bigint>, bits array<bigint>")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64), pa.int64()))


def _verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold: bitmaps first, then exact intersections.

    Only the texts of the nodes' first documents move; their sets are made after that and grouped by
    b, whose own set comes first in its group, so that a task holds two sets at a time.  A group of
    more than GROUP nodes is split into parts of about that many, each with b's set.
    """
    parts = F.ceil(F.col("count") / GROUP)
    pairs = pairs.join(pairs.groupBy("b").count(), "b").select("b", "a", F.pmod(F.xxhash64("a"), parts).alias("part"))
    roles = pairs.select("b", "part", F.col("a").alias("node")).union(pairs.select("b", "part", F.col("b").alias("node"))).distinct()
    roles = written(roles.join(nodes.select("node", "rep"), "node").select("b", "part", "node", F.col("rep").alias("doc_id")), "roles")
    table = bit_table(roles.select("doc_id").distinct(), "doc_id")
    texts = has_bit(docs.select("doc_id", "text"), "doc_id", table).where("maybe").select("doc_id", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                made, asked = list(gram_sets(part.column("text"), n)), part.column("node").to_pylist()
                same = pa.array([len(s) > 0 and _node(s) == x for s, x in zip(made, asked)], pa.bool_())
                grams = pa.array([s.tobytes() for s in made], pa.binary())
                yield pa.RecordBatch.from_arrays([x.filter(same) for x in (part.column("b"), part.column("part"), part.column("node"), grams)], names=["b", "part", "node", "grams"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, None
        for batch in batches:
            keep = []
            for b, node, grams in zip(*(batch.column(c) for c in ("b", "node", "grams"))):
                b, node, x = b.as_py(), node.as_py(), np.frombuffer(grams.as_py(), np.uint64)
                if node == b:
                    head, own = b, x
                keep.append(node != b and head == b and _reaches(x, own, percent))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("node", "b")], names=["a", "b"])

    grouped = texts.join(roles, "doc_id").select("b", "part", "node", "text").mapInArrow(sets, "b long, part long, node long, grams binary").repartition("b", "part")
    return grouped.sortWithinPartitions("b", "part", F.col("node") != F.col("b")).mapInArrow(compare, "a long, b long").distinct()


def _reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """overlap * 100 >= percent * union, which is total - overlap."""
    total = len(x) + len(y)
    words = _words(total)
    differ = int(np.bitwise_count((_bitmap(x, words) ^ _bitmap(y, words)).view(np.uint64)).sum())  # of signed numbers it counts the absolute value
    if (total - differ) // 2 * (100 + percent) < percent * total:
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) * (100 + percent) >= percent * total


def _bits_fit(a: str, b: str, total: Column, percent: int) -> Column:
    """Whether two bitmaps leave room for the overlap that the threshold asks for."""
    xor = lambda x, y: F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))
    # sizes that can link differ by less than two, so one folding makes two bitmaps equally long
    half = lambda x: xor(F.slice(x, F.lit(1), (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, (F.size(x) / 2).cast("int")))
    x = F.when(F.size(a) > F.size(b), half(F.col(a))).otherwise(F.col(a))
    y = F.when(F.size(b) > F.size(a), half(F.col(b))).otherwise(F.col(b))
    differ = F.aggregate(xor(x, y), F.lit(0), lambda s, c: s + F.bit_count(c))
    return F.floor((total - differ) / 2) * (100 + percent) >= total * percent


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _band(size: Column, percent: int) -> Column:
    """Sizes that can link are in one band or in neighbouring ones."""
    return F.floor(F.log(size.cast("double")) / F.lit(-np.log(percent / 100)) + 1e-9).cast("int")


def _early(pos: Column, size: Column, percent: int) -> Column:
    """Whether the hash at pos, from 0, can be the first that a set shares with one that is as large or larger."""
    return size * (2 * percent) <= (size - pos) * (100 + percent)


def linked(docs: DataFrame, n: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features, nodes, links): links (a, b) between nodes connect what the threshold connects."""
    features = written(_features(docs, n, percent), "features")
    # prefixes and bitmaps move only for sets that several documents may have
    sets = features.where("node is not null")
    copied = written(sets.groupBy("node").count().where("count > 1").select("node"), "copied")
    sets = has_bit(sets, "node", bit_table(copied, "node"))
    nodes = sets.where("maybe").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    nodes = written(nodes.union(sets.where("not maybe").select("node", "doc_id", "n_shingles", "prefix", "bits")), "nodes")
    rows = nodes.select("node", "rep", "n", F.posexplode("prefix").alias("pos", "gram"))
    rows = rows.select("gram", "node", "rep", "n", _early(F.col("pos"), F.col("n"), percent).alias("early"))
    tile = W.partitionBy("gram")
    lead = F.min(F.struct("rep", F.col("node").alias("lead"), F.col("n").alias("lead_n"))).over(tile)
    tiles = rows.withColumn("members", F.count("*").over(tile)).withColumn("some", F.max("early").over(tile)).withColumn("first", lead)
    tiles = tiles.where("members > 1 and some").select("gram", "node", "n", "early", "first.lead", "first.lead_n")
    tiles = written(tiles, "tiles")
    votes = tiles.where((F.col("node") != F.col("lead")) & _sizes_fit(F.col("n"), F.col("lead_n"), percent)).groupBy("node", "n", "lead", "lead_n").count()
    votes = votes.join(nodes.select("node", "bits"), "node").join(nodes.select(F.col("node").alias("lead"), F.col("bits").alias("lead_bits")), "lead")
    votes = votes.where(_bits_fit("bits", "lead_bits", F.col("n") + F.col("lead_n"), percent))
    lead_pairs = votes.groupBy("node").agg(F.max_by("lead", F.struct("count", "lead")).alias("b")).select(F.col("node").alias("a"), "b")
    lead_pairs = written(lead_pairs, "lead-pairs")
    links = written(_verified(docs, lead_pairs, nodes, n, percent), "links")

    known = components(links)
    root = F.coalesce("root", "node")
    rooted = tiles.join(known.withColumnRenamed("id", "node"), "node", "left").select("gram", "node", "n", "early", root.alias("root"))
    # a tile is looked at by bands: only where a band and the next one hold several components do bitmaps move
    at = _band(F.col("n"), percent)
    bands = F.when(F.col("early"), F.array(at, at + 1)).otherwise(F.array(at))
    banded = rooted.select("gram", "node", "n", "root", "early", F.posexplode(bands).alias("above", "band"))
    mixed = banded.groupBy("gram", "band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("above").alias("above"), F.max("early").alias("some"))
    mixed = mixed.where("low != high and above = 0 and some").select("gram", "band")
    mixed = written(banded.join(mixed, ["gram", "band"], "left_semi"), "mixed").join(nodes.select("node", "bits"), "node")
    left, right = mixed.where("early").alias("l"), mixed.where("above = 0").alias("r")
    total = F.col("l.n") + F.col("r.n")
    fits = (
        (F.col("l.gram") == F.col("r.gram"))
        & (F.col("l.band") == F.col("r.band"))
        & (F.col("l.root") != F.col("r.root"))
        & ((F.col("l.n") < F.col("r.n")) | ((F.col("l.n") == F.col("r.n")) & (F.col("l.node") < F.col("r.node"))))
        & _sizes_fit(F.col("l.n"), F.col("r.n"), percent)
        & _bits_fit("l.bits", "r.bits", total, percent)
    )
    rest = left.join(right, fits).select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()
    done = lead_pairs.union(lead_pairs.select("b", "a"))
    rest = written(rest.join(done, ["a", "b"], "left_anti"), "rest")
    more = written(_verified(docs, rest, nodes, n, percent), "links")
    return features, nodes, links.union(more)


def join_components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest doc_id that links reach."""
    features, nodes, links = linked(docs, n, percent)
    found = components(links)
    member = nodes.select("node", "rep").join(found.withColumnRenamed("id", "node"), "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    least = member.groupBy("root").agg(F.min("rep").alias("component"))
    member = member.join(least, "root").select("node", "component")
    out = features.select("doc_id", "n_shingles", "node").join(member, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id; a repeated doc_id stays repeated."""
    gone = join_components(docs, n, percent).where("component_id < doc_id").select("doc_id")
    return without_ids(docs, gone)
