"""Vector search and the hash-tracked index of notes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from ..sources.shared import kept
from .ranks import numbered

#: Vectors and queries in a block.
BLOCK, Q_BLOCK = 1024, 512
#: Most rows of a sample, centres of balls, and rings of a ball.
SAMPLE, CENTRES, RINGS = 4096, 128, 64
#: Embedding providers and their default models; only the first one works without a network.
DEFAULT_MODELS = {"keywords": "counts-1"}
#: Terms that the offline embedding counts.
TERMS = ("the", "and", "er", "on", "que", "de")


def keyword_embedding(text: Column) -> Column:
    """The offline embedding: counts of TERMS in the lower-cased text, and its length in thousands."""
    low = F.lower(text)
    count = lambda t: ((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)).cast("double")
    return F.array(*(count(t) for t in TERMS), F.length(text) / 1000.0)


@dataclass(frozen=True)
class Pieces:
    """The space cut into balls around centres, and balls into rings: a row for each piece with its ball, the least and largest distance to the centre, its rows and the parts that they are dealt over."""

    metric: str
    dim: int
    centres: np.ndarray
    sample: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    parts: np.ndarray

    def place(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centre of each row of m, and its distance."""
        d = _lengths(m, self.centres)
        cell = d.argmin(1)
        return cell, d[np.arange(len(m)), cell]

    def piece(self, cell: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """The piece of rows with that centre and distance: the last one of the ball that begins at it or before."""
        out = np.zeros(len(cell), np.int64)
        for c in np.unique(cell):
            mine = np.flatnonzero(self.cell == c)
            at = np.searchsorted(self.low[mine], dist[cell == c], "right") - 1
            out[cell == c] = mine[np.clip(at, 0, len(mine) - 1)]
        return out

    def bounds(self, m: np.ndarray) -> np.ndarray:
        """The least distance that a row of m can have to any row of each piece, by the triangle inequality."""
        d = _lengths(m, self.centres)[:, self.cell]
        return np.maximum(np.maximum(d - self.high, self.low - d), 0)

    def cut(self, m: np.ndarray, k: int | None, max_distance: float | None) -> np.ndarray:
        """A distance (of the metric) that the k nearest of each row of m, within max_distance, do not exceed: that of the k-th nearest in a sample of the rows."""
        out = np.full(len(m), np.inf if max_distance is None else max_distance)
        if k is not None and len(self.sample) >= k:
            out = np.minimum(out, np.partition(_distances(m, self.sample, self.metric), k - 1, axis=1)[:, k - 1])
        return out

    def reach(self, cut: np.ndarray) -> np.ndarray:
        """The distance between points that a cut stands for, with room for rounding."""
        return np.sqrt((2 if self.metric == "cosine" else 1) * np.maximum(cut + 2e-6, 0)) * (1 + 1e-9) + 1e-9


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def _distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances rounded to six places; rows are of length one, or zero, where the metric is cosine."""
    if metric == "cosine":
        return np.round(1 - np.clip(q @ x.T, -1, 1), 6)
    return np.round(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T, 0), 6)


def _matrix(column: pa.Array, dim: int, metric: str) -> np.ndarray:
    """Vectors as rows of doubles, shorter ones padded with zeros; of length one for cosine."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.asarray(column.offsets) - column.offsets[0].as_py()
    m = np.zeros((len(column), dim))
    width = np.diff(offsets)
    row = np.repeat(np.arange(len(column)), width)
    m[row, np.arange(len(flat)) - np.repeat(offsets[:-1], width)] = np.nan_to_num(flat)
    return _unit(m) if metric == "cosine" else m


def _usable(df: DataFrame) -> DataFrame:
    return df.select("id", "v").where("id is not null and v is not null")


def _placed(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """(id, v, cell, dist) of rows (id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, dist = pieces.place(_matrix(batch.column("v"), pieces.dim, pieces.metric))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(dist)], names=["id", "v", "cell", "dist"])

    return rows.mapInArrow(run, rows.select("id", "v", F.lit(0).alias("cell"), F.lit(0.0).alias("dist")).schema)


def cut_space(index: DataFrame, dim: int, metric: str = "l2sq", size: int = 4 * BLOCK) -> Pieces:
    """Pieces of about ``size`` rows of index (id, v).  At most SAMPLE rows, and RINGS + 4 numbers for each of at most CENTRES balls, reach the driver."""
    index = _usable(index)
    n = index.count()
    share = min(1.0, SAMPLE / 2 / max(1, n))
    picked = index.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("v").limit(SAMPLE).toArrow()
    sample = _matrix(pa.concat_arrays([c.cast(pa.list_(pa.float64())) for c in picked.column("v").chunks]), dim, metric) if picked.num_rows else np.zeros((0, dim))
    sample = sample[np.lexsort(sample.T)] if len(sample) else sample
    centres = [sample[0] if len(sample) else np.zeros(dim)]
    apart = _lengths(sample, centres[0][None])[:, 0] if len(sample) else np.zeros(0)
    # centres far from each other
    while len(centres) < min(CENTRES, -(-n // max(1, size // 4)), len(sample)) and apart.max() > 0:
        centres.append(sample[apart.argmax()])
        apart = np.minimum(apart, _lengths(sample, centres[-1][None])[:, 0])
    none = np.zeros(0)
    rough = Pieces(metric, dim, np.array(centres), sample, none, none, none, none, none)
    steps = [i / RINGS for i in range(1, RINGS)]
    stats = _placed(index, rough).groupBy("cell").agg(F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high"), F.percentile_approx("dist", steps, 2000).alias("steps")).collect()
    cell, low, high, rows = [], [], [], []
    for r in sorted(stats, key=lambda r: r["cell"]):
        rings = min(RINGS, max(1, -(-r["n"] // size)))
        marks = sorted({r["low"], *(r["steps"][i * RINGS // rings - 1] for i in range(1, rings))})
        for at, end in zip(marks, [*marks[1:], r["high"]]):
            cell.append(r["cell"])
            low.append(at)
            high.append(end)
            rows.append(r["n"] / len(marks))
    rows = np.array(rows)
    return Pieces(metric, dim, rough.centres, sample, np.array(cell, np.int64), np.array(low), np.array(high), rows, np.maximum(1, np.ceil(rows / (2 * size))).astype(np.int64))


def _stored(index: DataFrame, pieces: Pieces, kind: str) -> DataFrame:
    """Blocks (piece, part, ids, m) of rows (id, v)."""
    id_type = to_arrow_type(index.schema["id"].dataType)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, dist = pieces.place(_matrix(batch.column("v"), pieces.dim, pieces.metric))
            piece = pieces.piece(cell, dist)
            part = np.arange(len(piece)) % pieces.parts[piece]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(piece.astype(np.int32)), pa.array(part.astype(np.int32))], names=["id", "v", "piece", "part"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by piece and part
        for batch in batches:
            key = batch.column("piece").to_numpy().astype(np.int64) << 32 | batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for begin, end in zip(edges, edges[1:]):
                for at in range(begin, end, BLOCK):
                    rows = batch.slice(at, min(BLOCK, end - at))
                    m = _matrix(rows.column("v"), pieces.dim, pieces.metric)
                    ids = pa.array([rows.column("id").to_pylist()], pa.list_(id_type))
                    yield pa.RecordBatch.from_arrays([rows.column("piece").slice(0, 1), rows.column("part").slice(0, 1), ids, pa.array([m.tobytes()], pa.binary())], names=["piece", "part", "ids", "m"])

    dealt = index.mapInArrow(deal, index.select("id", "v", F.lit(0).alias("piece"), F.lit(0).alias("part")).schema)
    return dealt.repartition("piece", "part").sortWithinPartitions("piece", "part").mapInArrow(pack, f"piece int, part int, ids array<{kind}>, m binary")


def _asked(queries: DataFrame, pieces: Pieces, k: int | None, max_distance: float | None, kind: str) -> DataFrame:
    """(piece, part, q_ids, q_m, q_cut): blocks of those queries that the pieces can have results for."""
    id_type = to_arrow_type(queries.schema["id"].dataType)
    names = ["piece", "part", "q_ids", "q_m", "q_cut"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, Q_BLOCK):
                rows = batch.slice(at, Q_BLOCK)
                m = _matrix(rows.column("v"), pieces.dim, pieces.metric)
                cut = pieces.cut(m, k, max_distance)
                near = pieces.bounds(m) <= pieces.reach(cut)[:, None]
                ids = rows.column("id")
                for piece in np.flatnonzero(near.any(0)).tolist():
                    mine = np.flatnonzero(near[:, piece])
                    parts = int(pieces.parts[piece])
                    one = [pa.array([ids.take(pa.array(mine)).to_pylist()], pa.list_(id_type)), pa.array([m[mine].tobytes()], pa.binary()), pa.array([cut[mine].tobytes()], pa.binary())]
                    for part in range(parts):
                        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([part], pa.int32()), *one], names=names)

    return queries.mapInArrow(run, f"piece int, part int, q_ids array<{kind}>, q_m binary, q_cut binary")


def _compared(dim: int, metric: str, k: int | None):
    """For mapInArrow: blocks of queries and of rows to (query_id, id, distance), the k nearest of each query in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, r=r: np.frombuffer(batch.column(c)[r].as_py(), np.float64)
                d = _distances(get("q_m").reshape(-1, dim), get("m").reshape(-1, dim), metric)
                keep = d <= get("q_cut")[:, None]
                if k is not None and k < d.shape[1]:
                    # ties at the k-th distance all stay; the last ranking settles them by id
                    keep &= d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                i, j = np.nonzero(keep)
                if len(i):
                    q_ids, ids = (batch.column(c)[r].values for c in ("q_ids", "ids"))
                    yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(d[i, j])], names=["query_id", "id", "distance"])

    return run


def _dimensions(index: DataFrame, queries: DataFrame) -> int:
    return max(index.agg(F.max(F.size("v"))).first()[0] or 0, queries.agg(F.max(F.size("v"))).first()[0] or 0, 1)


def near_pairs(index: DataFrame, queries: DataFrame, k: int | None = None, max_distance: float | None = None, metric: str = "l2sq", size: int = 4 * BLOCK) -> DataFrame:
    """(query_id, id, distance) of rows of queries (id, v) and index (id, v): exact, rounded to six places.

    The index is cut into pieces (:func:`cut_space`).  A query goes only to pieces that can hold a row
    within its cut: max_distance, or the distance of its k-th nearest row in a sample, whichever is less.
    Of each meeting the k nearest of a query stay, those with equal distances too.  Null vectors take no part.
    """
    index, queries = _usable(index), _usable(queries)
    types = [df.schema["id"].dataType.simpleString() for df in (queries, index)]
    pieces = cut_space(index, _dimensions(index, queries), metric, size)
    met = _asked(queries, pieces, k, max_distance, types[0]).join(_stored(index, pieces, types[1]), ["piece", "part"]).select("q_ids", "q_m", "q_cut", "ids", "m")
    return met.mapInArrow(_compared(pieces.dim, metric, k), f"query_id {types[0]}, id {types[1]}, distance double")


def share_met(index: DataFrame, queries: DataFrame, k: int | None = None, max_distance: float | None = None, metric: str = "l2sq", size: int = 4 * BLOCK) -> float:
    """The share of all pairs of queries and rows that near_pairs compares; the others are left out by their piece's bound."""
    index, queries = _usable(index), _usable(queries)
    pieces = cut_space(index, _dimensions(index, queries), metric, size)
    asked = _asked(queries, pieces, k, max_distance, queries.schema["id"].dataType.simpleString()).where("part = 0").groupBy("piece").agg(F.sum(F.size("q_ids")).alias("q"))
    rows = _stored(index, pieces, index.schema["id"].dataType.simpleString()).groupBy("piece").agg(F.sum(F.size("ids")).alias("n"))
    met = asked.join(rows, "piece").agg(F.sum(F.col("q") * F.col("n"))).first()[0] or 0
    return met / max(1, index.count() * queries.count())


def near_in_groups(rows: DataFrame, group: str, threshold: float, block: int = 256) -> DataFrame:
    """(earlier, later): rows (group, id, v) of one group whose cosine distance is at most threshold.

    A group's rows are numbered and packed into blocks; each two blocks of a group meet under a key of
    their own, so that a large group is spread over all tasks.
    """
    rows = numbered(rows.select(group, "id", "v").where("id is not null and v is not null"), group, "id").withColumn("b", F.floor(F.col("ord") / block).cast("int"))
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 1
    kind = rows.schema["id"].dataType.simpleString()
    blocks = rows.groupBy(group, "b").agg(F.sort_array(F.collect_list(F.struct("ord", "id", "v"))).alias("x")).select(group, "b", F.col("x.id").alias("ids"), F.col("x.v").alias("vs"))
    counts = rows.groupBy(group).agg((F.max("b") + 1).alias("n"))
    blocks = blocks.alias("k").join(counts.alias("c"), F.col(f"k.{group}").eqNullSafe(F.col(f"c.{group}"))).select(f"k.{group}", "b", "ids", "vs", "n")
    first = blocks.select(group, F.col("b").alias("i"), F.explode(F.sequence("b", F.col("n") - 1)).alias("j"), F.col("ids").alias("a"), F.col("vs").alias("x"))
    second = blocks.select(group, F.explode(F.sequence(F.lit(0), "b")).alias("i"), F.col("b").alias("j"), F.col("ids").alias("b"), F.col("vs").alias("y"))
    met = first.alias("p").join(second.alias("q"), F.col(f"p.{group}").eqNullSafe(F.col(f"q.{group}")) & (F.col("p.i") == F.col("q.i")) & (F.col("p.j") == F.col("q.j")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x, y = (_matrix(batch.column(c)[r].values, dim, "cosine") for c in ("x", "y"))
                near = 1 - np.clip(x @ y.T, -1, 1) <= threshold
                # a vector of zeros has distance one to all
                near[(x == 0).all(1)] = near[:, (y == 0).all(1)] = threshold >= 1
                i, j = np.nonzero(np.triu(near, 1) if batch.column("i")[r].as_py() == batch.column("j")[r].as_py() else near)
                if len(i):
                    yield pa.RecordBatch.from_arrays([batch.column("a")[r].values.take(pa.array(i)), batch.column("b")[r].values.take(pa.array(j))], names=["earlier", "later"])

    return met.select("p.i", "p.j", "a", "x", "b", "y").mapInArrow(run, f"earlier {kind}, later {kind}")


def find_similar(index: DataFrame, queries: DataFrame, k: int = 5, max_distance: float | None = None, metric: str = "l2sq") -> DataFrame:
    """(query_id, rank, id, distance): the k nearest rows of index (id, v) to each row of queries (id, v).

    Exact; distances are rounded to six places and ties go to the smaller id.
    """
    near = near_pairs(index, queries, k, max_distance, metric)
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "distance")


def first_come(items: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(id, kept) for items (id): in turn each is kept unless it conflicts (earlier, later) with an earlier kept one.

    Each round keeps the rows without an undecided or kept earlier neighbour and drops those with a kept one,
    until no conflict is left: the result of going through them one by one, in at most one round more than
    the longest chain of conflicts has dropped rows.  A round writes the rows that it drops and the
    conflicts that are left.
    """
    edges, dropped = kept(conflicts.select("earlier", "later").distinct(), "conflicts"), None
    while not edges.isEmpty():
        late = edges.select(F.col("later").alias("earlier")).distinct()
        now = kept(edges.join(late, "earlier", "left_anti").select(F.col("later").alias("id")).distinct(), "dropped")
        dropped = now if dropped is None else dropped.union(now)
        left = edges.join(now.select(F.col("id").alias("later")), "later", "left_anti").join(now.select(F.col("id").alias("earlier")), "earlier", "left_anti")
        edges = kept(left.select("earlier", "later"), "conflicts")
    items = items.select("id").distinct()
    if dropped is None:
        return items.withColumn("kept", F.lit(True))
    return items.join(dropped.distinct().withColumn("_gone", F.lit(True)), "id", "left").select("id", F.col("_gone").isNull().alias("kept"))


def first_come_named(items: DataFrame, threshold: float) -> DataFrame:
    """(id, kept) for items (id, name, v): in turn each is kept unless an earlier kept one has its name, or a vector within threshold (a squared length).

    The result of first_come over all such pairs, without making them.  Rows of one name and one vector
    meet the same rows, so only the first of them can be kept.  Those of one name, or one vector, are told
    by their least id; only different vectors within threshold become pairs.  Null vectors have a name only.
    """
    rows = kept(items.select("id", "name", "v"), "candidates")
    firsts = kept(rows.groupBy("name", "v").agg(F.min("id").alias("id")), "firsts")
    points = kept(firsts.where("v is not null").groupBy("v").agg(F.min("id").alias("point")), "points")
    alone = points.select(F.col("point").alias("id"), "v")
    near = kept(near_pairs(alone, alone, None, threshold).where("id != query_id").select(F.col("query_id").alias("point"), F.col("id").alias("other")), "near")
    left, first = kept(firsts.join(points, "v", "left").select("id", "name", "point"), "left"), None
    while not left.isEmpty():
        of_name, of_point = left.groupBy("name").agg(F.min("id").alias("of_name")), left.groupBy("point").agg(F.min("id").alias("of_point"))
        of_near = near.join(of_point.withColumnRenamed("point", "other"), "other").groupBy("point").agg(F.min("of_point").alias("of_near"))
        both = left.join(of_name, "name").join(of_point, "point", "left").join(of_near, "point", "left")
        # nulls stand for no such rows
        now = kept(both.where("id = of_name and (of_point is null or id = of_point) and (of_near is null or id < of_near)").select("id", "name", "point"), "first")
        first = now.select("id") if first is None else first.union(now.select("id"))
        met = now.select("point").union(near.join(now.select("point"), "point").select(F.col("other").alias("point"))).distinct()
        left = kept(left.join(now.select("name"), "name", "left_anti").join(met, "point", "left_anti").select("id", "name", "point"), "left")
    if first is None:
        return rows.select("id", F.lit(True).alias("kept"))
    return rows.select("id").join(first.withColumn("_first", F.lit(True)), "id", "left").select("id", F.col("_first").isNotNull().alias("kept"))


def title_dedupe(concepts: DataFrame, group: str, title: str, *order: str) -> DataFrame:
    """The first row of each normalized title in a group."""
    df = concepts.withColumn("_t", T.normalize_id(F.col(title)))
    return df.withColumn("_r", F.row_number().over(W.partitionBy(group, "_t").orderBy(*order))).where("_r = 1").drop("_r", "_t")


def greedy_dedupe(rows: DataFrame, group: str, threshold: float) -> DataFrame:
    """(group, id): rows (group, id, v) in order of id whose cosine distance to every kept one of their group is over threshold."""
    rows = kept(rows.select(group, "id", "v"), "candidates")
    done = first_come(rows, near_in_groups(rows, group, threshold))
    return rows.join(done.where("kept"), "id", "left_semi").select(group, "id")


def drift(entries: DataFrame, index: DataFrame) -> DataFrame:
    """(note_id, status): entries (note_id, document) that index (note_id, content_hash) lacks or has otherwise, and extra ids."""
    want = entries.select("note_id", T.content_hash(F.col("document")).alias("want"))
    have = index.select("note_id", F.col("content_hash").alias("have"), F.lit(True).alias("stored"))
    both = want.join(have, "note_id", "full")
    status = F.when(F.col("want").isNull(), "extra").when(~F.col("want").eqNullSafe(F.col("have")), "missing_or_stale")
    return both.select("note_id", status.alias("status")).where("status is not null")


def refreshed(entries: DataFrame, index: DataFrame, embed=keyword_embedding) -> DataFrame:
    """The next version of index (note_id, document, content_hash, embedding): only drifted entries are embedded."""
    off = drift(entries, index)
    new = entries.join(off.where("status = 'missing_or_stale'").select("note_id"), "note_id", "left_semi")
    new = new.select("note_id", "document", T.content_hash(F.col("document")).alias("content_hash"), embed(F.col("document")).alias("embedding"))
    return index.select(*new.columns).join(off.select("note_id"), "note_id", "left_anti").unionByName(new)


def require_fresh(entries: DataFrame, index: DataFrame) -> None:
    """Raises if the index has drifted, as a dry run asks for."""
    n = {r["status"]: r["count"] for r in drift(entries, index).groupBy("status").count().collect()}
    if n:
        raise RuntimeError(f"active index is stale: {n.get('missing_or_stale', 0)} missing/stale, {n.get('extra', 0)} extra")


def collection_name_of(provider: str, model: str | None) -> tuple[str, str]:
    """(provider, model) of a collection, with the provider's default model where none is given."""
    if provider not in DEFAULT_MODELS:
        raise ValueError(f"unknown embedding provider: {provider}")
    return provider, model or DEFAULT_MODELS[provider]


def collection(index: DataFrame, provider: str, model: str | None = None) -> DataFrame:
    """The rows of index (collection, provider, model, ...) in one collection; a name that stands for another provider or model is an error."""
    provider, model = collection_name_of(provider, model)
    rows = index.where(F.col("collection") == T.collection_name(F.lit(provider), F.lit(model)))
    other = rows.where((F.col("provider") != provider) | (F.col("model") != model)).select("provider", "model").first()
    if other:
        raise ValueError(f"collection holds {other['provider']}/{other['model']}, not {provider}/{model}")
    return rows


def needs_indexing(entries: DataFrame, index: DataFrame) -> DataFrame:
    """(note_id, needed): whether an entry is missing in the index or stored otherwise."""
    off = drift(entries, index).where("status = 'missing_or_stale'").select("note_id", F.lit(True).alias("needed"))
    return entries.select("note_id").join(off, "note_id", "left").select("note_id", F.coalesce("needed", F.lit(False)).alias("needed"))


def rebuilt(entries: DataFrame, embed=keyword_embedding) -> DataFrame:
    """The index made anew: every entry is embedded, whatever was stored."""
    c = F.col("document")
    return entries.select("note_id", "document", T.content_hash(c).alias("content_hash"), embed(c).alias("embedding"))
