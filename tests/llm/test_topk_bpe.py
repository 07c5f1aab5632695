import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from skein.llm import bpe, queries, topk

from . import brute

SF = "/root/testdata/sf0.001"
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_top_k_query(spark):
    vectors = [(r[0], list(r[1])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = sorted(tuple(r) for r in queries.op1_topk(spark, SF).select("query_id", "rank", "vec_id", "score").collect())
    assert got == sorted(brute.op1(vectors))


def test_top_k_odd_vectors(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rnd.normal(size=4)]) for i in range(1, 120)]
    rows += [(150, None), (151, [1.0, None, 0.0, 0.0]), (152, [float("nan")] * 4), (153, [float("inf")] * 4), (0, [0.0] * 4)]
    rows += [(200 + i, [0.5, 0.5, -0.5, 0.5]) for i in range(60)]  # ties
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(5)
    rows = [(r[0], r[1]) for r in df.select("vec_id", "embedding").collect()]
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 50 = 0")).collect())
    assert got == sorted(brute.op1(rows))
    assert topk.top_k(df.limit(0), df).count() == 0
    assert sorted(tuple(r) for r in topk.top_k(df.where("vec_id < 3"), df.where("vec_id = 0"), k=5).collect()) == [(0, 1, 1, 0), (0, 2, 2, 0)]


def test_top_k_large_components(spark):
    df = spark.createDataFrame([(0, [1e20, 1.0]), (1, [-1e20, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(df, df)
    near = spark.createDataFrame([(0, [1e6, 1.0]), (1, [-1e6, 2.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r)[:3] for r in topk.top_k(near, near).collect()) == [(0, 1, 1), (1, 1, 0)]


def test_top_k_copies_of_queries(spark, monkeypatch):
    """A query block is copied once for many vector blocks, not once for every four of them."""
    made, packer = [], topk._packer

    def watched(dim, kind, top_sq, pivots, cells, size, query):
        made.append(cells)
        return packer(dim, kind, top_sq, pivots, cells, size, query)

    monkeypatch.setattr(topk, "_packer", watched)
    monkeypatch.setattr(topk, "BLOCK", 16)
    rnd = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.round(rnd.normal(size=4), 3)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 50 = 0")).collect())
    assert got == sorted(brute.op1(rows))
    assert max(made) <= 8


def test_top_k_leaves_groups_out():
    """Vectors in clusters: groups are left out, blocks meet one after another, ties and own ids stand."""
    rnd = np.random.default_rng(3)
    x = np.concatenate([rnd.integers(-9, 10, (500, 8)) + 400 * c for c in rnd.permutation(np.eye(8, dtype=int))[:6]])
    x[100:140] = x[100]
    ids = rnd.permutation(len(x)).astype(np.int64)
    top_sq, pivots, k = float((x.astype(float) ** 2).sum(1).max()), x[rnd.choice(len(x), 16, replace=False)], 5
    q, q_ids = x[::40], ids[::40]
    for number in (np.float32, np.float64, np.int64):
        best, out = topk._Best(q, q_ids, k, top_sq, pivots, number), 0
        for block in np.array_split(np.arange(len(x)), 7):
            d = topk._distances(x[block], topk._lift(x[block], top_sq), pivots, topk._lift(pivots, top_sq))
            order = np.argsort(d[:, 0])
            d, starts = d[order], np.arange(0, len(block), topk.GROUP)
            low, high = np.minimum.reduceat(d, starts), np.maximum.reduceat(d, starts)
            out += (~best.may(low, high)).sum()
            best.meet(x[block][order], ids[block][order], low, high)
        assert out > 0
        want = {(int(i), int(ids[j]), int(s[j])) for i, s in zip(q_ids, q @ x.T) for j in [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]}
        assert set(zip(*(c.to_pylist() for c in best.found().columns))) == want


def test_bpe_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op10_bpe(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        ids = library.encode_ordinary(text)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == brute.sha(np.array(ids, "<u4").tobytes())
        assert got[i]["decoded_sha256"] == brute.sha(text)


def test_bpe_tree_against_the_library(library, monkeypatch):
    monkeypatch.setattr(bpe, "TEXT_LEAF", 5)
    monkeypatch.setattr(bpe, "PIECE_LEAF", 3)
    monkeypatch.setattr(bpe, "ID_LEAF", 4)
    e, rnd = bpe.Encoder(library._mergeable_ranks, PATTERN), random.Random(5)
    alphabets = ["ab", "aé 日\n", " \t\n", "'sretlvmd ", "the in  on'ing.,!? 0123", "a", "ACGT", "\U0001f600 x'"]
    for n in range(1500):
        text = "".join(rnd.choice(alphabets[n % len(alphabets)]) for _ in range(rnd.randrange(120)))
        assert e.pieces(text) == e.scan(text), repr(text)
        ids = np.frombuffer(e.encode(text), "<u4")
        assert ids.tolist() == library.encode_ordinary(text), repr(text)
        assert e.decode(ids) == text.encode()


def test_bpe_long_pieces(library):
    e, rnd = bpe.Encoder(library._mergeable_ranks, PATTERN), random.Random(6)
    for text in ("a" * 5000, "ab" * 3000, "".join(rnd.choice("abcdefgh") for _ in range(20_000)), "日" * 3000, "=" * 3001, " " * 4000 + "x"):
        assert np.frombuffer(e.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_bpe_odd_rows(spark, library):
    texts = [None, "", "a", "a", "x" * 30_000, "<|endoftext|>"]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, token_ids string")
    back = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN)
    assert sorted((r[0], bytes(r[1]).decode()) for r in back.collect()) == [(i, t or "") for i, t in enumerate(texts)]
    full = {r["doc_id"]: r for r in bpe.with_tokens(docs, PATH, PATTERN).collect()}
    assert [list(full[i]["token_ids"]) for i in range(6)] == [library.encode_ordinary(t or "") for t in texts]
    assert bpe.with_tokens(docs.limit(0), PATH, PATTERN).count() == 0
    assert bpe.with_tokens(docs, PATH, PATTERN).where(F.size("token_ids") != F.col("n_tokens")).count() == 0
