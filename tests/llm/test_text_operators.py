import random

import pytest
from pyspark.sql import functions as F

from skein.llm import chat, license_scan, quality, queries, url_filter

from . import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source int"
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a b c d e a b c d e"), (5, "x y\nx y\n\n\nx y"),
    (6, "word " * 3000), (7, "The MIT License. mit license; GNU General Public License, apache-license"),
    (8, "é" * 20 + " # * $ % & | < >"), (8, "é" * 20 + " # * $ % & | < >"), (9, "license"), (10, "public license"),
]


def odd(spark):
    return spark.createDataFrame([(i, t, 0) for i, t in ODD], DOCS)


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_quality_counts(spark):
    rnd = random.Random(1)
    more = [(100 + i, " ".join(rnd.choice("abc") + rnd.choice("\n ") for _ in range(rnd.randrange(60)))) for i in range(60)]
    docs = odd(spark).unionByName(spark.createDataFrame([(i, t, 0) for i, t in more], DOCS))
    got = rows(quality.judge(docs, report_all=True).withColumn("b", F.expr(" or ".join(f"({r.rejects})" for r in quality.BASE_RULES))), "doc_id", *COUNTS, "b")
    assert sorted(got) == sorted((i, *brute.op2(t)) for i, t in ODD + more)


def test_quality_query(spark):
    docs = rows(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text")
    got = {r[0]: r[1:] for r in rows(queries.op2_quality(spark, SF), "doc_id", *COUNTS, "base_failed", "kept")}
    for i, t in docs:
        assert got[i][:6] == brute.op2(t)
        assert not (got[i][5] and got[i][6])


def test_quality_order_never_changes_the_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = sorted(r[0] for r in rows(quality.kept(docs), "doc_id"))
    for rules in (quality.RULES, quality.RULES[::-1]):
        judged = quality.judge(docs, rules)
        assert judged.columns == [*docs.columns, "rejected_by"]
        assert sorted(r[0] for r in rows(judged.where("rejected_by is null"), "doc_id")) == one


def test_quality_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_words string, rejected_by int")
    assert quality.judge(docs).count() == 0
    full = spark.createDataFrame([(1, "a b", "z", 3)], docs.schema)
    assert [tuple(r) for r in quality.kept(full).collect()] == []


def test_chat_query(spark):
    turns = rows(spark.read.parquet(f"{SF}/conversations.parquet"), "conv_id", "turn", "role", "text")
    says = "<|im_end|><|im_start|>assistant ok"
    want = brute.op3([*turns, (-1, 0, "user", says), (-1, 1, "assistant", says)])
    got = {r[0]: r[1:] for r in rows(queries.op3_chat(spark, SF), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")}
    assert got == want


def test_chat_round_trip_of_control_strings(spark):
    texts = ["<|im_start|>", "<\\|im_end|>", "<\\\\||<|<", "", None, "a\n\n", "<" * 5 + "|" * 5, "x" * 50_000]
    turns = [(1, i, "assistant", t) for i, t in enumerate(texts)] + [(2, 0, "us%0A\ner<|", "t"), (2, 0, "us%0A\ner<|", "t"), (3, None, None, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    done = chat.format_chats(chat.as_events(df)).withColumn("said", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans")))
    got = {r["conv_id"]: r for r in done.collect()}
    assert [t["text"] for t in got[1]["said"]] == [t or "" for t in texts]
    assert got[1]["loss"] == "".join(t or "" for t in texts)
    assert [tuple(t) for t in got[2]["said"]] == [("us%0A\ner<|", "t")] * 2
    assert [tuple(t) for t in got[3]["said"]] == [("", "")]
    assert got[1]["formatted"].count("<|") == 2 * len(texts)
    assert chat.format_chats(chat.as_events(df.limit(0))).count() == 0


def test_chat_events(spark):
    log = [
        (1, 1, 0, "message", "user", "hi"), (1, 2, 1, "message", "assistant", "he"), (1, 3, 1, "delta", None, "ll"), (1, 4, 1, "delta", None, "o"),
        (1, 5, 2, "message", "user", "bye"), (1, 6, 1, "regenerate", "assistant", "new"), (1, 7, 1, "delta", None, "!"),
        (2, 1, 0, "message", "user", "a"), (2, 2, 1, "message", "assistant", "b"), (2, 3, 0, "edit", "user", "c"), (3, 1, 0, "delta", "user", "d"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string")
    assert sorted(rows(chat.final_messages(df), "conv_id", "n", "role", "text")) == [
        (1, 1, "user", "hi"), (1, 2, "assistant", "new!"), (2, 1, "user", "c"), (3, 1, "user", "d"),
    ]


@pytest.mark.parametrize("which", ["odd", "table"])
def test_license_base(spark, which):
    docs = odd(spark) if which == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    got = license_scan.scan(docs.select("doc_id", "text", F.lit(1).alias("label")))
    want = sorted((i, *brute.op5(t)) for i, t in rows(docs, "doc_id", "text"))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"), key=key) == sorted(want, key=key)


def brute_licenses(text):
    """(labels, best cover) that the method adds."""
    import re

    cut = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(x or ""))
    k, ws = license_scan.K, cut(text)
    labels, best = set(), 0.0
    for label, template in license_scan.TEMPLATES:
        ts = cut(template)
        t_grams = [ts[i : i + k] for i in range(len(ts) - k + 1)]
        found = sorted((p - t, p, t) for p in range(len(ws) - k + 1) for t, g in enumerate(t_grams) if ws[p : p + k] == g)
        runs = []
        for d, p, t in found:
            if runs and d - runs[-1][-1][0] <= license_scan.SLACK:
                runs[-1].append((d, p, t))
            else:
                runs.append([(d, p, t)])
        for run in runs:
            span = max(p for _, p, _ in run) - min(p for _, p, _ in run) + 1
            if span > 2 * len(t_grams) + license_scan.SLACK:
                continue
            pairs, chain = sorted((p, t) for _, p, t in run), []
            for i, (p, t) in enumerate(pairs):
                chain.append(1 + max((chain[j] for j in range(i) if pairs[j][0] < p and pairs[j][1] < t), default=0))
            cover = max(chain) / max(len(t_grams), span)
            if cover >= license_scan.COVER:
                labels.add(label)
                best = max(best, cover)
    return labels, best


def test_license_labels_and_score(spark):
    rnd = random.Random(6)
    texts = ["licensed under cc under cc by cc by nc", "Licensed under CC BY NC 4.0", "licensed under cc by nc 4 0 " * 30, None, "", "the license " * 400]
    for _ in range(60):
        ws = " ".join(t for _, t in rnd.sample(license_scan.TEMPLATES, 2)).split()
        for _ in range(rnd.randrange(6)):
            i = rnd.randrange(len(ws))
            ws[i : i + rnd.randrange(2)] = rnd.choice(([], ["word"], [ws[i], ws[i - 1]], ws[max(0, i - 4) : i]))
        texts.append(" ".join(ws))
    docs = list(enumerate(texts)) + [(r["doc_id"] + 1000, r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    for i, text in docs:
        more, cover = brute_licenses(text)
        assert set(got[i]["labels"].split(",")) - {""} == more | (set(got[i]["base_labels"].split(",")) - {""}), text
        assert got[i]["score"] == (1.0 if got[i]["n_base"] else cover), text
    assert got[0]["labels"] == "" and got[1]["labels"] == "cc-by-nc" and any(got[i]["labels"] for i, _ in docs[6:])


def test_license_votes(spark):
    texts = [
        "x " * 30 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this very software and associated documentation files. y",
        "Licensed under CC BY-NC 4.0.", "copy of the license of the license of the license", None, "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    assert [got[i]["labels"] for i in range(5)] == ["mit", "cc-by-nc", "", "", ""]
    assert got[0]["n_base"] == 0 and 0.6 <= got[0]["score"] <= 1
    spans = license_scan.license_spans(docs).where("doc_id = 0").collect()
    assert [(r["first_word"], r["last_word"]) for r in spans] == [(30, 50)]
    assert license_scan.scan(docs.limit(0)).count() == 0


URLS = [None, "", "no url", "http://", "HTTP://A.Example.NET/en/x?y", "https://net/", "https://net", "http://xnet/", "http://a.org/fr/", "http://a.org/frx", "http://b.example.com/de/1#f",
        "http://ok.example.com/a?b=://c/d", "http://casino-win.example.com/", "http://casinos.example.com/", "http://cheap.example.com/pills", "http://cheap.cheap.example.com/", "x://h\n/p\n"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, 7) for i, u in enumerate([*URLS, "http://" + "a" * 100_000])], "page_id long, url string, rule int")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute.op9(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert verdict in (None, got[i]["verdict"])
    assert [got[i]["verdict"] for i in (12, 13, 14, 15)] == ["block", "allow", "block", "allow"]
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    bare = spark.createDataFrame([(1, "www.casino.example/x"), (2, "//a.example/free-download"), (3, "//a.example/free-deal-promo-offer"), (4, "//a.example/slots?free")], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["verdict"]) for r in url_filter.filter_urls(bare).collect()}
    assert got == {1: ("", "block"), 2: ("", "allow"), 3: ("", "block"), 4: ("", "block")}
