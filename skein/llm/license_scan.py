"""License scans by diagonal voting, in DataFrame functions only.

All rolling k-word hashes of all texts are joined with the k-word hashes of license templates; each
match votes for the diagonal (word position less template position) of its template.  Votes are
summed by diagonal, neighbouring diagonals merged (an inserted or lost word moves the diagonal by
one), and a merged run is verified: its matches have to follow each other in text and template alike,
and make up COVER of the longer of the two.

The template table is the only side that is broadcast, and only up to MOST_CHARS characters.

Defined cases: a null or empty text has no words and no labels; repeated rows each get their own
result row (a repeated doc_id shares the labels that its rows have); a null doc_id counts as one id;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lower_ascii, once

#: Phrase and label of the plain test.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices of common licenses, by label.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
#: Words to a hash; diagonals so far apart at most are one run; least share of a template's hashes.
K, SLACK, COVER = 3, 2, 0.6
#: Characters of templates up to which their hashes go to all tasks.
MOST_CHARS = 2_000_000


def scan_words(text: Column) -> Column:
    """Words of ASCII letters and digits and of all other characters from U+0080."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _grams(ws: str) -> Column:
    """xxhash64 of every K consecutive words of column ws."""
    starts = F.when(F.size(ws) >= K, F.slice(ws, F.lit(1), F.size(ws) - (K - 1))).otherwise(F.array().cast("array<string>"))
    return F.transform(starts, lambda w, i: F.xxhash64(w, *(F.get(F.col(ws), i + k) for k in range(1, K))))


def template_grams(spark, templates=TEMPLATES) -> DataFrame:
    """(h, t, label, t_pos, t_size): the hashes of the templates."""
    df = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "t int, label string, text string")
    df = df.withColumn("ws", scan_words(F.col("text"))).withColumn("g", _grams("ws"))
    return df.select("t", "label", F.size("g").alias("t_size"), F.posexplode("g").alias("t_pos", "h"))


def _chain(matches: Column, size: Column) -> Column:
    """The most matches (pos, t_pos) that follow each other in text and template alike: best has the longest chain that ends at each template place."""
    order = F.array_sort(F.transform(matches, lambda m: F.struct(m["pos"].alias("pos"), (-m["t_pos"]).alias("t"))))
    # matches of one text place come from the template's end, so that none follows another
    step = lambda best, m: F.transform(best, lambda n, i: F.when(i == -m["t"], F.greatest(n, 1 + F.coalesce(F.array_max(F.slice(best, F.lit(1), -m["t"])), F.lit(0)))).otherwise(n))
    return F.array_max(F.aggregate(order, F.array_repeat(F.lit(0), size), step))


def license_spans(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, label, t, first_word, last_word, cover): verified runs of template words; several a document.

    cover is the share of hashes that text and template have in the same order, of the longer of the two.
    """
    spark = docs.sparkSession
    tmpl = template_grams(spark, templates)
    if sum(len(text) for _, text in templates) <= MOST_CHARS:
        tmpl = F.broadcast(tmpl)
    grams = docs.select("doc_id", once(scan_words(F.col("text"))).alias("ws")).select("doc_id", once(_grams("ws")).alias("g"))
    grams = grams.select("doc_id", F.posexplode("g").alias("pos", "h"))
    votes = grams.join(tmpl, "h").withColumn("diagonal", F.col("pos") - F.col("t_pos"))
    votes = votes.groupBy("doc_id", "label", "t", "t_size", "diagonal").agg(F.collect_set(F.struct("pos", "t_pos")).alias("matches"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    by = W.partitionBy("doc_id", "t").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(by) > SLACK
    runs = votes.withColumn("run", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(by))
    runs = runs.groupBy("doc_id", "label", "t", "t_size", "run").agg(F.flatten(F.collect_list("matches")).alias("matches"), F.min("first").alias("first"), F.max("last").alias("last"))
    span = F.col("last") - F.col("first") + 1
    runs = runs.where(span <= 2 * F.col("t_size") + SLACK)
    cover = _chain(F.col("matches"), F.col("t_size")) / F.greatest(F.col("t_size"), span)
    runs = runs.withColumn("cover", once(cover)).where(F.col("cover") >= COVER)
    return runs.select("doc_id", "label", "t", F.col("first").cast("long").alias("first_word"), (F.col("last") + K - 1).cast("long").alias("last_word"), "cover")


def _places() -> Column:
    """array<struct<pos, label>> of PHRASES in column ws, only looked for where the last word occurs at all."""
    at = lambda i: F.get(F.col("ws"), i)
    hits = F.filter(
        F.transform(
            "ws",
            lambda w, i: F.when(
                w == "license",
                F.when(at(i - 1) == "mit", F.struct((i - 1).alias("pos"), F.lit("mit").alias("label")))
                .when(at(i - 1) == "apache", F.struct((i - 1).alias("pos"), F.lit("apache").alias("label")))
                .when((at(i - 1) == "public") & (at(i - 2) == "general"), F.struct((i - 2).alias("pos"), F.lit("gpl").alias("label"))),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    none = F.array().cast("array<struct<pos:int,label:string>>")
    return F.when(F.array_contains("ws", "license"), hits).otherwise(none)


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of docs."""
    found = license_spans(docs, templates).groupBy("doc_id").agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"))
    base = docs.select("doc_id", once(scan_words(F.col("text"))).alias("ws")).select("doc_id", F.size("ws").alias("n"), once(_places()).alias("hits"))
    base = base.select("doc_id", "n", F.col("hits.pos").alias("pos"), F.array_distinct("hits.label").alias("said"))
    both = base.alias("b").join(found.alias("f"), F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")), "left")
    joined = lambda a: F.array_join(F.array_sort(a), ",")
    none = F.array().cast("array<string>")
    return both.select(
        "b.doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.size("pos").cast("long").alias("n_base"),
        F.array_min("pos").cast("long").alias("first_word"),
        F.array_max("pos").cast("long").alias("last_word"),
        joined(F.col("said")).alias("base_labels"),
        joined(F.array_union("said", F.coalesce("more", none))).alias("labels"),
        F.when(F.size("pos") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
    )
