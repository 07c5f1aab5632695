"""Exact top-k inner products by pivot-table elimination.

With M the largest norm, a vector x gets one more coordinate sqrt(M^2 - |x|^2) and a query q a zero;
then the squared distance of the two is |q|^2 + M^2 - 2 q.x, so that the nearest is the one with the
largest product.  A block of vectors is sorted by nearest pivots into groups, each with its least and
largest distance to every pivot; for a query the largest gap between d(q, p) and that range over all
pivots p bounds the distance of the whole group from below and its products from above.  Groups whose
bound does not reach a query's k-th best product so far are left out for it; the others' products
are made a group at a time for all queries that it can matter to, as one product of matrices.

Vectors and queries travel in blocks of bounded size: every query block meets every vector block,
spread over cells.  A cell has up to CELL blocks of vectors, and a query block is copied once a cell,
as components only.  The pivots (N_PIVOTS vectors) and seven totals are all that the driver sees.

Defined cases: components so large that a product could leave 64 bits raise a ValueError before the
search; a null vector and one with a null or non-finite component take no part; shorter
vectors count as padded with zeros; a row with the query's own vec_id is no candidate of it; other repeated rows
all count; a repeated query id with several vectors keeps the smallest; ties go to the smaller
vec_id; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

N_PIVOTS = 32
#: Vectors and queries in a block, vectors in a group, and blocks of vectors in a cell.
BLOCK, Q_BLOCK, GROUP, CELL = 2048, 512, 64, 32


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<bigint>): floor(scale * x) of each usable vector."""
    x = F.col("embedding")
    usable = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(usable & F.col("vec_id").isNotNull()).select("vec_id", F.transform("embedding", lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long")).alias("v"))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    flat, offsets = col.flatten().to_numpy(zero_copy_only=False), np.asarray(col.offsets)
    offsets = offsets - offsets[0]
    if len(flat) == dim * len(col) and (np.diff(offsets) == dim).all():
        return flat.reshape(len(col), dim).astype(np.int64)
    out = np.zeros((len(col), dim), np.int64)
    for i in range(len(col)):
        row = flat[offsets[i] : offsets[i + 1]]
        out[i, : len(row)] = row
    return out


def _distances(m: np.ndarray, extra: np.ndarray, pivots: np.ndarray, p_extra: np.ndarray) -> np.ndarray:
    a, p = m.astype(np.float64), pivots.astype(np.float64)
    sq = (a * a).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * a @ p.T + (extra[:, None] - p_extra[None]) ** 2
    return np.sqrt(np.maximum(sq, 0))


def _lift(m: np.ndarray, top_sq: float) -> np.ndarray:
    return np.sqrt(np.maximum(top_sq - (m.astype(np.float64) ** 2).sum(1), 0))


def _packer(dim: int, kind: str, top_sq: float, pivots: np.ndarray, cells: int, size: int, query: bool):
    """For mapInArrow: blocks (cell, ids, m, low, high) of rows (vec_id, v); low and high are a group's distances to the pivots."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        p_extra = _lift(pivots, top_sq)
        cell = TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                m = _matrix(part.column("v"), dim)
                ids = np.asarray(part.column("vec_id").to_numpy(zero_copy_only=False), np.int64)
                low = high = np.zeros(0)
                if not query:
                    d = _distances(m, _lift(m, top_sq), pivots, p_extra)
                    near = np.argsort(d, axis=1)[:, :2]
                    order = np.lexsort((near[:, -1], near[:, 0]))
                    m, ids, d = m[order], ids[order], d[order]
                    starts = np.arange(0, len(m), GROUP)
                    low, high = np.minimum.reduceat(d, starts), np.maximum.reduceat(d, starts)
                cell += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cell % cells], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, m.astype(kind), low, high))],
                    names=["cell", "ids", "m", "low", "high"],
                )

    return pack


class _Best:
    """The k best of each query of a block among the vectors met so far; ties go to the smaller id."""

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, k: int, top_sq: float, pivots: np.ndarray, number: type) -> None:
        self.q, self.q_ids, self.k, self.top_sq = q.astype(number), q_ids, k, top_sq
        self.none = -np.inf if number is not np.int64 else np.iinfo(np.int64).min
        self.cut = np.full(len(q), self.none, number)
        self.q_sq = (q.astype(np.float64) ** 2).sum(1)
        self.d = _distances(q, np.zeros(len(q)), pivots, _lift(pivots, top_sq))
        self.rows, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, number)
        self.at = np.argsort(q_ids)

    def may(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a query's k best can have a vector of a group: a row a query, a column a group."""
        gap = np.zeros((len(self.q), len(low)))
        for p in range(low.shape[1]):
            d = self.d[:, p, None]
            np.maximum(gap, np.maximum(low[None, :, p] - d, d - high[None, :, p]), out=gap)
        bound = (self.q_sq[:, None] + self.top_sq - gap * gap) / 2
        bound += 1e-6 * (1 + np.abs(bound) + self.q_sq[:, None] + self.top_sq)
        return bound >= self.cut[:, None]

    def meet(self, x: np.ndarray, x_ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        may = self.may(low, high)
        x = x.astype(self.q.dtype)
        if may.all():
            s = self.q @ x.T
        else:
            s = np.full((len(self.q), len(x)), self.none, self.q.dtype)
            for g in np.flatnonzero(may.any(0)):
                who, part = np.flatnonzero(may[:, g]), slice(g * GROUP, (g + 1) * GROUP)
                s[who, part] = self.q[who] @ x[part].T
        # a row of the query's own id is no candidate
        place = np.minimum(np.searchsorted(self.q_ids, x_ids, sorter=self.at), len(self.at) - 1)
        same = self.q_ids[self.at[place]] == x_ids
        s[self.at[place[same]], np.flatnonzero(same)] = self.none
        cut = self.cut
        if s.shape[1] >= self.k:
            open_ = np.flatnonzero(cut == self.none)
            cut = cut.copy()
            cut[open_] = np.partition(s[open_], s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
        rows, cols = np.nonzero((s >= cut[:, None]) & (s > self.none))
        if not len(rows):
            return
        rows, ids, scores = np.concatenate([self.rows, rows]), np.concatenate([self.ids, x_ids[cols]]), np.concatenate([self.scores, s[rows, cols]])
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        starts = np.searchsorted(rows, np.arange(len(self.q)))
        stay = np.arange(len(rows)) - starts[rows] < self.k
        self.rows, self.ids, self.scores = rows[stay], ids[stay], scores[stay]
        last = starts + self.k - 1
        full = np.append(starts[1:], len(rows)) > last
        self.cut[full] = scores[last[full]]

    def found(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.q_ids[self.rows]), pa.array(self.ids), pa.array(self.scores.astype(np.int64))], names=["query_id", "vec_id", "score"])


def _searcher(dim: int, kind: str, top_sq: float, k: int, pivots: np.ndarray, number: type):
    """For mapInArrow: the k best of each query block among the vector blocks that stand beside it in a row."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, best = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, t, r=r: np.frombuffer(batch.column(c)[r].as_buffer(), t)
                key = (batch.column("cell")[r].as_py(), batch.column("q_ids")[r].as_buffer().to_pybytes())
                if key != last:
                    if best:
                        yield best.found()
                    last, best = key, _Best(get("q_m", kind).reshape(-1, dim).astype(np.int64), get("q_ids", np.int64), k, top_sq, pivots, number)
                best.meet(get("m", kind).reshape(-1, dim), get("ids", np.int64), get("low", np.float64).reshape(-1, len(pivots)), get("high", np.float64).reshape(-1, len(pivots)))
        if best:
            yield best.found()

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, n_pivots: int = N_PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k best of vectors."""
    spark = vectors.sparkSession
    out = "query_id long, vec_id long, score long"
    data = quantised(vectors, scale)
    asked = quantised(queries, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    largest = F.aggregate("v", F.lit(0.0), lambda s, c: F.greatest(s, F.abs(c.cast("double"))))
    n, top_sq, dim, most = data.agg(F.count("*"), F.max(norm), F.max(F.size("v")), F.max(largest)).first()
    q_n, q_dim, q_most = asked.agg(F.count("*"), F.max(F.size("v")), F.max(largest)).first()
    if not n or not q_n or not max(dim, q_dim):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(dim, q_dim)
    if dim * most * q_most >= 2.0**62:
        raise ValueError(f"components up to {most:g} and {q_most:g} in {dim} dimensions: products would not fit in 64 bits")
    kind = next(t for t, m in (("int16", 2**15), ("int32", 2**31), ("int64", 2**63)) if max(most, q_most) < m)
    picked = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).select("v").collect()
    pivots = np.zeros((len(picked), dim), np.int64)
    for i, row in enumerate(picked):
        pivots[i, : len(row["v"])] = row["v"]
    cells = max(-(-n // (CELL * BLOCK)), min(-(-n // BLOCK), spark.sparkContext.defaultParallelism))
    # products are exact as doubles or single floats if all their partial sums are whole numbers that fit
    number = next((t for t, m in ((np.float32, 2**24), (np.float64, 2**53)) if dim * most * q_most < m), np.int64)
    schema = "cell int, ids binary, m binary, low binary, high binary"
    blocks = data.mapInArrow(_packer(dim, kind, top_sq, pivots, cells, BLOCK, False), schema)
    q_blocks = asked.repartition(max(1, -(-q_n // Q_BLOCK))).mapInArrow(_packer(dim, kind, top_sq, pivots, 1, Q_BLOCK, True), schema)
    q_blocks = q_blocks.select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.col("ids").alias("q_ids"), F.col("m").alias("q_m"))
    met = q_blocks.join(blocks, "cell").select("cell", "q_ids", "q_m", "ids", "m", "low", "high")
    found = met.mapInArrow(_searcher(dim, kind, top_sq, k, pivots, number), out)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
