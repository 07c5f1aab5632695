"""Operators against the whole job where an earlier version did less."""

import random

import pytest
from pyspark.sql import functions as F

from skein.llm import line_dedup, mixing, queries, repeats

from . import brute


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def allowed(n):
    """The edits README names for a shorter line of n characters."""
    step = max(4, 1 << (n.bit_length() - 3))
    return max(2, (n - n % step) // 50)


def test_near_lines_grow_with_length(spark):
    rnd = random.Random(12)
    lines = set()
    for n in (30, 62, 63, 129, 190, 255, 319, 384, 520, 640, 900, 2050, 2300):
        base = "".join(rnd.choice("abcdefgh é") for _ in range(n))
        lines.add(base)
        for k in range(6 if n < 2000 else 3):
            s = base
            for _ in range(max(1, allowed(n) + (k % 3 - 1))):
                i = rnd.randrange(len(s))
                s = rnd.choice([s[:i] + s[i + 1 :], s[:i] + "x" + s[i:], s[:i] + "y" + s[i + 1 :]])
            lines.add(s)
    lines = sorted(lines)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    ids = {r[0]: r[1] for r in docs.selectExpr("xxhash64(text)", "doc_id").collect()}
    got = {(ids[r["a"]], ids[r["b"]]) for r in line_dedup.edit_links(docs).collect()}
    want = set()
    for i, a in enumerate(lines):
        for j, b in enumerate(lines):
            most = allowed(min(len(a), len(b)))
            if i != j and abs(len(a) - len(b)) <= most and edits(a, b) <= most:
                want.add((i, j))
    assert got == want
    assert any(edits(lines[i], lines[j]) > 2 for i, j in want)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_mixing_meets_feasible_targets_and_keeps_its_share(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").drop("n_chars")
    done = mixing.decided(docs).drop("_row").cache()
    targets = mixing.within(done, mixing.tempered(done, mixing.TEMPER), mixing.KEEP)
    chance = F.col("tokens") * F.col("probability")
    kept = F.when(F.col("kept"), F.col("tokens")).otherwise(0)
    total, expected, real, spread = done.agg(F.sum("tokens"), F.sum(chance), F.sum(kept), F.sum(chance * F.col("tokens") * (1 - F.col("probability")))).first()
    assert abs(expected / total - mixing.KEEP) < 0.001 and abs(real / total - mixing.KEEP) < 0.01 + 4 * spread**0.5 / total
    assert 0 < done.agg(F.max("probability")).first()[0] <= 1
    for r in mixing.marginals(done, targets).collect():
        assert abs(r["expected"] - r["target"]) < 1e-3, r
    for d in mixing.DIMS:
        want = {r[d]: r["target"] for r in targets[d].collect()}
        for r in done.groupBy(d).agg(F.sum(kept).alias("k")).collect():
            assert abs(r["k"] / real - want[r[d]]) < 1e-3 + 4 * spread**0.5 / real


def test_mixing_targets_that_cannot_be_met(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a" if i < 50 else "b", "x" if i < 50 else "y") for i in range(100)], "doc_id long, text string, source string, lang string")
    goal = lambda d, **shares: spark.createDataFrame(list(shares.items()), f"{d} string, target double")
    aims = {"source": goal("source", a=0.4, b=0.6), "lang": goal("lang", x=0.6, y=0.4), "topic": goal("topic", note=1.0)}
    with pytest.raises(ValueError, match="can't be met"):
        mixing.decided(docs, targets=aims)
    fit = mixing.decided(docs, targets={**aims, "lang": goal("lang", x=0.4, y=0.6)}).collect()
    assert {(r["source"], round(r["probability"], 3)) for r in fit} == {("a", 0.64), ("b", 0.96)}
    # b has half of all tokens, so that of a sample of 0.8 it can be 0.625 at most
    most = mixing.within(spark.createDataFrame([("a", "x", "note", 500.0), ("b", "x", "note", 500.0)], "source string, lang string, topic string, tokens double"), {**aims, "source": goal("source", a=0.1, b=0.9), "lang": goal("lang", x=1.0)}, 0.8)
    assert {r["source"]: round(r["target"], 6) for r in most["source"].collect()} == {"a": 0.375, "b": 0.625}


def test_short_lines_repeat(spark):
    docs = spark.createDataFrame([(1, "Les.\n\nA\n \t\nLes."), (2, "Les!\n\nA\n \t\nb"), (3, "A\nLes.")], "doc_id long, text string")
    got = {r[0]: r[1] for r in line_dedup.counted(docs).select("_row.doc_id", "kept").collect()}
    assert got == {1: "Les.\n\nA\n \t", 2: "Les!\n\n \t\nb", 3: ""}
    assert {r["doc_id"] for r in line_dedup.without_repeated_lines(docs).collect()} == {1, 2}


def test_repeats_of_hot_hashes(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 20)
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    passage = word(260)
    texts = [word(rnd.randrange(150)) + passage + word(rnd.randrange(150)) for _ in range(60)]
    texts += ["x" * 700, passage[:180], passage[90:] + "x" * 300, word(500), None]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.digests(docs).collect()}
    assert got == brute.op4(rows)
    near, hot = repeats._parted(docs.selectExpr("doc_id as d", "xxhash64(text) as th", "text"))
    assert near.groupBy("h").count().agg(F.max("count")).first()[0] <= 20 < hot.groupBy("h").count().agg(F.max("count")).first()[0]
