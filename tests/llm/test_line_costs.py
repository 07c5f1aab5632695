"""Line dedup: cheaper keys, counts and distances decide as before."""

import os
import random

import pytest
from pyspark.sql import functions as F

from skein.llm import line_dedup

from .test_whole_job import edits

ALPHABETS = ["ab", "abcdefgh ", "aé日\U0001f600 .", "ëé"]


def edited(rnd, x, n, letters):
    for _ in range(n):
        i, c = rnd.randrange(len(x) + 1), rnd.choice(letters)
        x = rnd.choice([x[:i] + x[i + 1 :], x[:i] + c + x[i:], x[:i] + c + x[i + 1 :]])
    return x


def test_keys_grow_less_than_the_square_of_edits(spark):
    rnd = random.Random(4)
    for n, most in ((600, 40), (1000, 85), (1900, 220)):
        line = spark.createDataFrame([("".join(rnd.choice("abcdefgh ") for _ in range(n)),)], "line string")
        keys = line_dedup._keyed(line, 2).groupBy(F.floor(F.col("mark") / 2)).count().collect()
        assert max(r["count"] for r in keys) <= most


def test_trimmed_between_characters(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(2000):
        letters = rnd.choice(ALPHABETS)
        x = "".join(rnd.choice(letters) for _ in range(rnd.randrange(12)))
        rows.append((i, x, edited(rnd, x, rnd.randrange(4), letters)))
    got = {r["i"]: (r["x"], r["y"]) for r in line_dedup._trimmed(spark.createDataFrame(rows, "i int, x string, y string")).collect()}
    for i, x, y in rows:
        k = len(os.path.commonprefix([x, y]))
        a, b = x[k:], y[k:]
        j = len(os.path.commonprefix([a[::-1], b[::-1]]))
        assert got[i] == (a[: len(a) - j], b[: len(b) - j])


@pytest.mark.parametrize("reach", [(24, 16, 6), (60, 30, 2)])
def test_near_by_parts(spark, monkeypatch, reach):
    """Texts that repeat themselves as well, so that parts are cut at wrong places; the whole texts decide then."""
    for name, value in zip(("LONG", "PART", "ANCHOR"), reach):
        monkeypatch.setattr(line_dedup, name, value)
    rnd = random.Random(6)
    rows = []
    for i in range(300):
        letters = rnd.choice(ALPHABETS)
        x = "".join(rnd.choice(letters) for _ in range(rnd.choice((5, 40, 90, 150))))
        x = rnd.choice([x, x[:20] * (len(x) // 20)])
        rows.append((i, x, edited(rnd, x, rnd.randrange(14), letters), rnd.randrange(14)))
    near = line_dedup._near(F.col("x"), F.col("y"), F.col("t")).alias("near")
    got = {r["i"]: r["near"] for r in spark.createDataFrame(rows, "i int, x string, y string, t int").select("i", near).collect()}
    want = {i: edits(x, y) <= t for i, x, y, t in rows}
    assert got == want and 30 < sum(want.values()) < 270
