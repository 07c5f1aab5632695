"""Importance resampling towards a target distribution over hashed word features.

Features are runs of 1 to n consecutive words; a feature's bucket is the crc32 of its bytes modulo
BUCKETS.  Bucket counts of the documents and of the target texts give each bucket a gain, the log
ratio of its smoothed shares in thousandths.  Scoring needs no explode: higher-order functions make a
row's array of buckets, and its gains are summed with element_at over one literal array of BUCKETS
entries.  Only bucket totals and counts of scores are shuffled; a document's weight is its mean gain,
and Gumbel noise from a hash of its id turns the highest scores into a sample without replacement.

The rank of a drawn document is the number of higher scores, known from the counts of scores, and its
place among equal scores.  A score is a whole number: a mean of gains and a noise of thousandths, both
of the size of a logarithm, so that there are at most some 10**5 different ones whatever the table.

Defined cases: a null or empty text has no features and weight 0; a null doc_id is hashed as an empty
one and comes first among ties; rows that repeat a doc_id are scored and ranked each by itself, in the
order of their weights and counts; without target texts or documents the smoothing alone makes the
gains; an empty table gives an empty table; other columns, whatever their names, are ignored by
:func:`scored` and kept by :func:`resampled`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lower_ascii, once, packed, written

BUCKETS, SHARE, MIN_WORDS, SEED = 10_000, 10, 20, "2024"
#: Separators: all ASCII but digits and small letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def feature_words(text: Column) -> Column:
    """Lower-cased words of ASCII letters and digits and of all characters from U+0080."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP), "")


def bucket_array(words: Column, n: int, buckets: int) -> Column:
    """The bucket of each run of 1 to n of the words."""
    bucket = lambda x: (F.crc32(x) % buckets).cast("int")

    def runs(k: int) -> Column:
        starts = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: bucket(F.array_join(F.slice(words, i, k), " ")))

    one = F.transform(words, bucket)
    return F.concat(one, *map(runs, range(2, n + 1))) if n > 1 else one


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> list[int]:
    """How many features of all texts (text) fall in each bucket: one row a bucket reaches the driver."""
    found = texts.select(F.explode(bucket_array(feature_words(F.col("text")), n, buckets)).alias("bucket")).groupBy("bucket").count()
    out = [0] * buckets
    for row in found.collect():
        out[row["bucket"]] = row["count"]
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Thousandths of ln of the smoothed share in the target over that in the corpus, floored."""
    s_all, t_all, m = sum(corpus), sum(target), len(corpus)
    return [math.floor(1000 * math.log((t + 1) * (s_all + m) / ((s + 1) * (t_all + m)))) for s, t in zip(corpus, target)]


def _floored(total: Column, n: Column) -> Column:
    """total / n, rounded down, in whole numbers."""
    return ((total - F.pmod(total, n)) / n).cast("long")


def scored(docs: DataFrame, gain: list[int], n: int = 1, seed: str = SEED, **more: Column) -> DataFrame:
    """(n_words, n_features, weight, score, ...) of every row of docs (doc_id, text), and the columns in more."""
    literal = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<int>")
    rows = docs.select(F.col("doc_id").alias("_id"), once(feature_words(F.col("text"))).alias("_ws"), *(c.alias(name) for name, c in more.items()))
    rows = rows.withColumn("_b", once(bucket_array(F.col("_ws"), n, len(gain))))
    total = F.aggregate("_b", F.lit(0).cast("long"), lambda s, b: s + F.element_at(literal, b + 1))
    rows = rows.select("_id", *more, F.size("_ws").cast("long").alias("n_words"), F.size("_b").cast("long").alias("n_features"), once(total).alias("_total"))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("")))
    draw = (F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-1000 * F.log(-F.log(draw))).cast("long")
    weight = F.when(F.col("n_features") > 0, _floored(F.col("_total"), F.col("n_features"))).otherwise(F.lit(0).cast("long"))
    return rows.withColumn("weight", weight).select(*more, "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))


def ranked(rows: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """rows (doc_id, n_words, n_features, weight, score, ...) with rank among the share percent drawn of rows with min_words words, else null.

    rows is a written table.
    """
    fits = F.col("n_words") >= min_words
    n_by_score = written(rows.where(fits).groupBy("score").agg(F.count("*").alias("n")), "score-counts")
    # one row a score, of which there are a bounded number
    higher = n_by_score.select("score", (F.sum("n").over(W.orderBy(F.desc("score"))) - F.col("n")).alias("above"), F.sum("n").over(W.partitionBy()).alias("n_fit"))
    higher = higher.withColumn("draw", F.floor(F.col("n_fit") * share / 100).cast("long")).where("above < draw").select("score", "above", "draw")
    marked = rows.join(F.broadcast(higher), "score", "left").withColumn("draw", F.when(fits, F.col("draw")))
    place = F.row_number().over(W.partitionBy("score").orderBy("doc_id", "weight", "n_features"))
    drawn = marked.where("draw is not null").withColumn("rank", F.col("above") + place)
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= F.col("draw"), F.col("rank")))
    rest = marked.where("draw is null").withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*rows.columns, "rank").unionByName(rest.select(*rows.columns, "rank"))


def resample_scores(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, share: int = SHARE, min_words: int = MIN_WORDS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs (doc_id, text) towards target (text)."""
    gain = gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    return ranked(written(scored(docs, gain, n, seed, doc_id=F.col("doc_id")), "importance"), share, min_words)


def resampled(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, share: int = SHARE, min_words: int = MIN_WORDS, seed: str = SEED) -> DataFrame:
    """The rows of docs that are drawn, with docs' columns."""
    gain = gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    rows = packed(docs, doc_id=F.col("doc_id"), text=F.col("text"))
    made = written(scored(rows, gain, n, seed, doc_id=F.col("doc_id"), _row=F.col("_row")), "importance")
    return ranked(made, share, min_words).where("rank is not null").select("_row.*")
