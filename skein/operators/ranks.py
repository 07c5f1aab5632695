"""Numbers of rows in an order, without bringing the rows of a group together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept


def numbered(df: DataFrame, by: str, *order: str) -> DataFrame:
    """df as a written table with ord: a row's number from 0 among those of its ``by``, in the given order (which tells all of them apart).

    Rows are sorted by ranges of (by, order); a partition's offset is the number of rows in those before it.
    """
    placed = df.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = kept(placed, "ordered").withColumns({"_part": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    # one row a partition
    sizes = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    offsets, at = [], 0
    for part, n in sizes:
        offsets.append((part, at))
        at += n
    offsets = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    rows = placed.join(F.broadcast(offsets), "_part").withColumn("_n", F.col("_before") + F.col("_place"))
    first = rows.groupBy(F.col(by).alias("_by")).agg(F.min("_n").alias("_first"))
    return rows.join(first, F.col(by).eqNullSafe(F.col("_by"))).withColumn("ord", F.col("_n") - F.col("_first")).select(*df.columns, "ord")
