"""Exact search that leaves out pieces of the space, and greedy dedupe, against numpy."""

import numpy as np
import pytest

from skein.operators import vectors


def frame(spark, m, ids=None):
    ids = range(len(m)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v]) for i, v in zip(ids, m)], "id long, v array<double>").repartition(3)


def brute(x, q, metric, k, cut):
    out = []
    for qi, a in q:
        d = []
        for i, b in x:
            if metric == "cosine":
                n = np.linalg.norm(a) * np.linalg.norm(b)
                d.append((round(float(1 - (np.clip(a @ b / n, -1, 1) if n else 0)), 6), i))
            else:
                d.append((round(float(((a - b) ** 2).sum()), 6), i))
        out += [(qi, r, i, s) for r, (s, i) in enumerate(sorted(d)[:k], 1) if cut is None or s <= cut]
    return out


def clustered(rng, n, dim=8, clusters=12):
    centres = rng.normal(size=(clusters, dim)) * 10
    return centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, dim)) * 0.3


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
@pytest.mark.parametrize("cut", [None, 0.01])
def test_nearest_of_clustered_vectors(spark, metric, cut):
    rng = np.random.default_rng(3)
    x = clustered(rng, 900)
    x[5] = 0
    x[6] = x[7]
    got = [tuple(r) for r in vectors.find_similar(frame(spark, x), frame(spark, x[::20], range(0, 900, 20)), 4, cut, metric).collect()]
    want = brute(list(enumerate(x)), [(i, x[i]) for i in range(0, 900, 20)], metric, 4, cut)
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:2] == b[:2] and abs(a[3] - b[3]) <= 2e-6


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_pieces_are_left_out_and_nothing_is_lost(spark, metric):
    rng = np.random.default_rng(4)
    x = clustered(rng, 1500)
    i, q = frame(spark, x), frame(spark, x[::20], range(0, 1500, 20))
    full = {tuple(r)[:2] for r in vectors.near_pairs(i, q, 5, None, metric, 10**6).collect()}
    small = {tuple(r)[:2] for r in vectors.near_pairs(i, q, 5, None, metric, 40).collect()}
    best = lambda pairs: {(a, b) for a, b in pairs}
    top = {(a, b) for a, r, b, _ in brute(list(enumerate(x)), [(j, x[j]) for j in range(0, 1500, 20)], metric, 4, None)}
    assert top <= best(full) and top <= best(small)
    assert vectors.share_met(i, q, 5, None, metric, 40) < 0.4 and vectors.share_met(i, q, None, 0.0, metric, 40) < 0.2


def test_odd_vectors(spark):
    x = frame(spark, [[1, 0], None, [0], [], [1, 0, 0], [0, 0]])
    got = {(r["query_id"], r["id"]): r["distance"] for r in vectors.find_similar(x, x, 9).collect()}
    assert {q for q, _ in got} == {0, 2, 3, 4, 5} and got[0, 4] == 0 and got[2, 5] == 0 and got[0, 5] == 1
    assert vectors.find_similar(x.limit(0), x, 3).count() == 0 and vectors.find_similar(x, x.limit(0), 3).count() == 0
    same = frame(spark, [[1, 2]] * 300)
    assert vectors.find_similar(same, same.where("id < 3"), 3).count() == 9
    assert [r["id"] for r in vectors.find_similar(same, same.where("id = 9"), 3).orderBy("rank").collect()] == [0, 1, 2]


def test_greedy_dedupe_of_a_large_group(spark):
    rng = np.random.default_rng(5)
    x = clustered(rng, 700, 4, 30)
    x[3] = 0
    rows = spark.createDataFrame([("big" if i % 7 else ("small" if i % 2 else None), i, [float(c) for c in v]) for i, v in enumerate(x)], "g string, id long, v array<double>").repartition(5)
    want = set()
    for g in ("big", "small", None):
        kept = []
        for i, v in enumerate(x):
            if ("big" if i % 7 else ("small" if i % 2 else None)) != g:
                continue
            n = np.linalg.norm(v)
            if all(not n or not np.linalg.norm(k) or 1 - v @ k / n / np.linalg.norm(k) > 0.002 for _, k in kept):
                kept.append((i, v))
        want |= {i for i, _ in kept}
    assert {r["id"] for r in vectors.greedy_dedupe(rows, "g", 0.002).collect()} == want
