"""The pipeline on tables with odd rows and columns."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, weight double, kept boolean, id string, root int, n_tokens string, tokens int"


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randrange(3, 9))) for _ in range(n)).capitalize() + "."


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    rnd = random.Random(1)
    texts = {i: prose(rnd, 60) for i in range(30)}
    copy = prose(rnd, 80)
    rows = [(i, t, "s1" if i % 3 else None, "en" if i % 2 else None) for i, t in texts.items()]
    rows += [(100, None, "s1", "en"), (101, "", "s1", "en"), (102, " \n\t\n", "s1", "en"), (103, prose(rnd, 30_000), "s2", "en"), (None, prose(rnd, 50), "s1", "en")]
    rows += [(200 + k, copy, "s1", "en") for k in range(6)] + [(210, copy + " end", "s1", "en"), (220, prose(rnd, 40), "s2", "de")] * 2
    df = spark.createDataFrame([(d, t, s, la, len(t or ""), 0.5, False, "x", 7, "y", 3) for d, t, s, la in rows], SCHEMA)
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(got.columns) == sorted([*df.columns, "token_ids"])
    out = got.collect()
    ids = [r["doc_id"] for r in out]
    assert not {100, 101, 102} & set(ids) and sum(i is not None and 200 <= i <= 210 for i in ids) <= 1 and ids.count(220) in (0, 2)
    # KEEP is 0.8: most of the documents apart are there, whole
    whole = {i: t for i, t in texts.items()}
    assert sum(i in whole for i in ids) >= 15
    for r in out:
        assert (r["weight"], r["kept"], r["id"], r["root"], r["tokens"]) == (0.5, False, "x", 7, 3) and r["n_tokens"] == len(r["token_ids"]) > 0
        if r["doc_id"] in whole:
            assert r["text"] == whole[r["doc_id"]]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and "token_ids" in got.columns
