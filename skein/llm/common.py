"""What several operators share: word cutting, scratch tables, bounded filters, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words.
GAP = r"[\x20\x09-\x0D]+"
#: Most bits of a filter that goes to all tasks: 2**26, 8 MB.
MOST_LOG2 = 26


def words(text: Column) -> Column:
    """Runs of characters other than space and \\t to \\r; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def once(expr: Column) -> Column:
    """expr, made once a row: the optimizer neither copies it into lambdas that read its column nor
    moves filters on later columns below it, as it may with an expression that it knows to be pure."""
    return F.when(F.monotonically_increasing_id() >= 0, expr)


def scratch_dir(spark: SparkSession) -> str:
    """A folder in the one that the cluster shares; a temporary one only where none is set and all runs in one process, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{shared.rstrip('/')}/skein"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, and every executor can read it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slot_bits(df: DataFrame, slot: Column, log2_bits: int) -> np.ndarray:
    """A bit for each slot (0 to 2**log2_bits - 1) that df has, as 64-bit words.

    The size is fixed by log2_bits, whatever the input; at most 2**log2_bits / 64 rows reach the driver.
    """
    found = (
        df.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).cast("long").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
        .toArrow()
    )
    table = np.zeros(1 << (log2_bits - 6), np.int64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return table.view(np.uint64)


def log2_bits(n: int, most: int = MOST_LOG2) -> int:
    """Bits of a filter for n keys, eight to a key but 2**most at most; with more keys it clears fewer rows."""
    return min(most, max(16, (8 * n).bit_length()))


def bit_table(df: DataFrame, key: str) -> DataFrame:
    """One row ``_bits array<long>``: a bit for each slot that an xxhash64 of ``key`` falls in; df is a written table.

    Every key of df passes :func:`has_bit`; a full table only lets more rows through.
    """
    log2 = log2_bits(df.count())
    slots = slot_bits(df, F.pmod(F.xxhash64(key), F.lit(1 << log2)), log2)
    return df.sparkSession.createDataFrame([(0, slots.view(np.int64).tolist())], "_one int, _bits array<bigint>")


def has_bit(df: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """df with a column ``maybe``: whether key's slot is set.  The one row of the table, of 2**MOST_LOG2 bits at most, is broadcast."""
    slot = F.pmod(F.xxhash64(key), F.size("_bits").cast("long") * 64)
    word = F.get(F.col("_bits"), F.shiftright(slot, 6).cast("int"))
    hit = F.getbit(word, slot.bitwiseAND(F.lit(63)).cast("int")) == 1
    return df.withColumn("_one", F.lit(0)).join(F.broadcast(table), "_one").withColumn("maybe", hit).drop("_one", "_bits")


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """docs as one column _row, so that no name can clash, beside the columns in more."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *(c.alias(n) for n, c in more.items()))


def without_ids(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in gone (doc_id).

    Rows that the filter clears are not shuffled.
    """
    gone = written(gone.select(F.col("doc_id").alias("_id")).distinct(), "gone")
    marked = has_bit(packed(docs, _id=F.col("doc_id")), "_id", bit_table(gone, "_id"))
    left = marked.where("maybe").join(gone, "_id", "left_anti")
    return left.select("_row").union(marked.where("not maybe").select("_row")).select("_row.*")


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(id, root): for each id in an edge (a, b), the smallest id of its component.

    Labels flow along edges and then jump to their label's label, so that the number of rounds
    grows with the logarithm of a component's width.  Each round ends in a written table, and the job
    fails if labels still change after so many rounds (enough for any component that fits in a table).
    """
    both = written(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(),
        "edges",
    )
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("root")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        stepped = labels.join(near, "id").select("id", F.least("root", "near").alias("mid"), F.col("root").alias("old"))
        # the old root of an id learns the smaller label as well, and each label is followed once more
        hooked = (
            stepped.where("mid < old").groupBy(F.col("old").alias("id")).agg(F.min("mid").alias("hook"))
        )
        stepped = stepped.join(hooked, "id", "left").select("id", "old", F.least("mid", F.coalesce("hook", "mid")).alias("mid"))
        jumped = stepped.join(stepped.select(F.col("id").alias("mid"), F.col("mid").alias("jump")), "mid", "left")
        new = written(jumped.select("id", "old", F.least("mid", F.coalesce("jump", "mid")).alias("root")), "labels")
        labels = new.select("id", "root")
        if new.where("old != root").isEmpty():
            return labels
    raise RuntimeError(f"labels of components still change after {rounds} rounds")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
