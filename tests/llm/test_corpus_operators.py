import math
import random
from collections import Counter

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import bpe, edits, line_dedup, mixing, ngram_join, quality, queries, repeats
from skein.llm.common import components

from . import brute

SF = "/root/testdata/sf0.001"


def read(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def make(spark, texts, more="z"):
    return spark.createDataFrame([(i, t, more) for i, t in texts], "doc_id long, text string, n string")


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(1000, 1040)] + [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(7, 7)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute.roots({x for a, b in edges if a != b for x in (a, b)}, [e for e in edges if e[0] != e[1]])
    assert got == want


@pytest.mark.parametrize("which", ["table", "odd"])
def test_ngram_join(spark, which):
    if which == "table":
        docs = read(spark)
        got = queries.op8_ngram(spark, SF)
    else:
        rnd = random.Random(4)
        base = [[rnd.choice("abcdefgh") * rnd.randrange(1, 4) + str(rnd.randrange(40)) for _ in range(120)] for _ in range(4)]
        texts = [None, "", " \n", "One two", "one TWO", "one two three four", "one two three four"]
        for _ in range(60):
            w = list(rnd.choice(base))
            for _ in range(rnd.randrange(5)):
                w[rnd.randrange(len(w))] = "x"
            texts.append(" ".join(w))
        texts += ["same passage of words " * 40 + " ".join(rnd.choice("pqrst") * 3 + str(rnd.random()) for _ in range(6)) for _ in range(40)]
        docs = make(spark, list(enumerate(texts))).repartition(3)
        got = ngram_join.join_components(docs)
    want = brute.op8(pairs(docs))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want


def test_ngram_join_rows(spark):
    docs = make(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None)])
    assert sorted(r["doc_id"] for r in ngram_join.one_of_each(docs).collect()) == [1, 1, 3]
    assert ngram_join.one_of_each(docs).columns == docs.columns
    assert ngram_join.join_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("which", ["table", "odd"])
def test_repeats(spark, which):
    if which == "table":
        docs, got = read(spark), queries.op4_repeats(spark, SF)
    else:
        rnd = random.Random(7)
        long = "".join(rnd.choice("abcdefgh é\n") for _ in range(700))
        texts = [None, "", "x" * 99, "x" * 100, "x" * 400, "ab" * 300, long[:300], "q" + long[100:420], long[50:250] + "zz" + long[300:], long, long, "é" * 120, "abc" * 90 + long[:101], long[:100], long[1:100]]
        docs = make(spark, list(enumerate(texts))).repartition(3)
        got = repeats.digests(docs)
    want = brute.op4(pairs(docs))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()} == want


def test_repeats_rows(spark):
    docs = make(spark, [(1, "x1y2" * 60 + "z"), (1, "x1y2" * 60 + "z"), (None, "short")])
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in repeats.digests(docs).collect())
    assert got[0] == (0, 0) and got[1] == got[2] and got[1][1] == brute.op4([(1, "x1y2" * 60 + "z")])[1][1]
    assert repeats.digests(docs.limit(0)).count() == 0


def test_repeats_in_runs_and_variants(spark):
    """Runs of one byte, bytes of zero and many variants of one passage."""
    rnd = random.Random(11)
    long = "".join(rnd.choice("abcdefgh é\n\0") for _ in range(700))
    texts = [" " * 300 + "\0" * 150, "\0" * 260 + "a", "x" * 3000, long]
    for _ in range(60):
        t = list(long[rnd.randrange(300) :])
        for _ in range(rnd.randrange(4)):
            t[rnd.randrange(len(t))] = rnd.choice("abx")
        texts.append("".join(t))
    docs = make(spark, list(enumerate(texts))).repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.digests(docs).collect()}
    assert got == brute.op4(list(enumerate(texts)))
    groups = repeats.repeat_groups(docs.selectExpr("doc_id as d", "xxhash64(text) as th", "text")).collect()
    raw = {i: t.encode() for i, t in enumerate(texts)}
    assert any(len(g["occurrences"]) > 30 for g in groups)
    for g in groups:
        assert len({raw[o["d"]][o["start"] : o["start"] + g["length"]] for o in g["occurrences"]}) == 1 and g["length"] >= 100


def test_repeats_of_a_long_run(spark):
    got = repeats.digests(make(spark, [(1, "a" * 1_000_000), (2, "b" + "a" * 50_000)])).collect()
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in got} == {1: (999_999, 1), 2: (50_000, 1)}


def test_maximal_repeats():
    text = b"xabcdyabcdzabcdx"
    keys = np.array([np.frombuffer(text[i:].ljust(len(text) + 1, b"\0"), np.uint8) for i in range(len(text))])
    before = np.array([-1, *text[:-1]])
    found = {text[rows[0] : rows[0] + d]: sorted(rows) for d, rows in repeats.maximal_repeats(keys, before, 2)}
    assert found == {b"abcd": [1, 6, 11]}


def distance(a, b, most):
    """The edit distance if it is at most most, else most + 1."""
    if abs(len(a) - len(b)) > most or sum(((Counter(a) - Counter(b)) + Counter()).values()) > most:
        return most + 1
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            new[j] = min(row.get(j, most) + 1, new.get(j - 1, most) + 1, row.get(j - 1, most) + (x != b[j - 1]) if j else most + 1)
        row = new
        if min(row.values()) > most:
            return most + 1
    return min(row.get(len(b), most + 1), most + 1)


def allowed(n):
    """The edits allowed to a shorter line of n characters: two, or one for each 50 of the band's lower end."""
    step = max(4, 1 << (n.bit_length() - 3))
    return max(2, (n - n % step) // 50)


def brute_lines(docs):
    """doc_id → its text without lines that repeat earlier ones, or, from 20 characters on, nearly do."""
    seen, by_len, out = set(), {}, {}
    for d, text in sorted(docs, key=lambda x: x[0]):
        keep = []
        for line in (text or "").split("\n"):
            n = len(line)
            if line.strip(" \t\r"):
                gone = line in seen
                if n >= 20 and not gone:
                    most = allowed(n)
                    gone = any(distance(line, o, allowed(min(n, k))) <= allowed(min(n, k)) for k in range(n - most, n + most + 1) for o in by_len.get(k, ()))
                    by_len.setdefault(n, []).append(line)
                seen.add(line)
                if gone:
                    continue
            keep.append(line)
        out[d] = text if text is None else "\n".join(keep)
    return out


def test_lines_of_one_template(spark):
    """Thousands of lines share most of their segments, and dealing hot keys over tasks changes nothing."""
    lines = [f"Posted by the editors on page two, item number {(i * 7919) % 10**7:07d}" for i in range(3000)]
    docs = make(spark, list(enumerate(lines)))
    got = {r[0] for r in line_dedup.counted(docs).where("n_removed = 1").select("_row.doc_id").collect()}
    digits, want, seen = {}, set(), set()
    for i, line in enumerate(lines):
        d = line[-7:]
        keys = {d[:a] + "*" + d[a + 1 : b] + "*" + d[b + 1 :] for a in range(7) for b in range(a + 1, 7)}
        shifted = {d[:a] + d[a + 1 :] for a in range(7)}
        near = any(k in seen for k in keys) or any(("-", s) in seen for s in shifted)
        if near:
            want.add(i)
        seen |= keys | {("-", s) for s in shifted}
    assert got == want


@pytest.mark.parametrize("size", [120, 530])
def test_lines_of_frequent_keys(spark, monkeypatch, size):
    """Variants of one line about as far apart as is allowed, where most keys are frequent and dealt over tasks."""
    monkeypatch.setattr(line_dedup, "OFTEN", 2)
    monkeypatch.setattr(line_dedup, "TOGETHER", 50)
    rnd = random.Random(size)
    base = [rnd.choice(["the", "onan", "thre", "edinre", "was", "eaor"]) for _ in range(size // 4)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rnd.randrange(5)):
            w[rnd.randrange(len(w))] = rnd.choice(["ander", "of", "thth", "in.", "reat7", ""])
        texts.append(" ".join(w)[: size + rnd.randrange(-4, 5)])
    docs = make(spark, list(enumerate(texts))).repartition(3)
    got = {r[0]: r[1] for r in line_dedup.counted(docs).select("_row.doc_id", "kept").collect()}
    want = brute_lines(list(enumerate(texts)))
    assert got == want and 10 < sum(t == "" for t in want.values()) < 140
    links = {(r["a"], r["b"]) for r in line_dedup.edit_links(docs).collect()}
    h = {t: xxhash.xxh64(t.encode(), seed=42).intdigest() for t in texts}
    h = {t: x - (1 << 64) if x >> 63 else x for t, x in h.items()}
    near = lambda a, b: (m := allowed(min(len(a), len(b)))) >= distance(a, b, m)
    assert links == {(h[a], h[b]) for a in h for b in h if a != b and near(a, b)}


def test_edits_at_once():
    rnd = random.Random(2)
    pairs = []
    for _ in range(400):
        letters = rnd.choice(["ab", "abcdefgh", "aé日\U0001f600 .*"])
        x = y = "".join(rnd.choice(letters) for _ in range(rnd.randrange(90)))
        for _ in range(rnd.randrange(14)):
            i, c = rnd.randrange(len(y) + 1), rnd.choice(letters)
            y = rnd.choice([y[:i] + y[i + 1 :], y[:i] + c + y[i:], y[:i] + c + y[i + 1 :]])
        pairs.append((x, y, rnd.randrange(45)))
    got = edits.within([p[0] for p in pairs], [p[1] for p in pairs], np.array([p[2] for p in pairs]))
    assert got.tolist() == [distance(x, y, t) <= t for x, y, t in pairs]


@pytest.mark.parametrize("span", [5, 64])
def test_edits_of_wide_bands(monkeypatch, span):
    monkeypatch.setattr(edits, "SPAN", span)
    rnd = random.Random(3)
    for _ in range(300):
        letters = rnd.choice(["ab", "abcdefgh", "aé日\U0001f600 .*"])
        x = y = "".join(rnd.choice(letters) for _ in range(rnd.randrange(150)))
        for _ in range(rnd.randrange(60)):
            i, c = rnd.randrange(len(y) + 1), rnd.choice(letters)
            y = rnd.choice([y[:i] + y[i + 1 :], y[:i] + c + y[i:], y[:i] + c + y[i + 1 :]])
        t = rnd.randrange(60)
        assert (edits.banded_long(x, y, t) <= t) == (distance(x, y, t) <= t), (x, y, t)


@pytest.mark.parametrize("which", ["table", "odd"])
def test_lines(spark, which):
    if which == "table":
        docs = read(spark)
    else:
        rnd = random.Random(9)
        lines = ["".join(rnd.choice("abc dé") for _ in range(rnd.randrange(18, 40))) for _ in range(25)]

        def edited(s):
            for _ in range(rnd.randrange(4)):
                i = rnd.randrange(len(s))
                s = rnd.choice([s[:i] + s[i + 1 :], s[:i] + "x" + s[i:], s[:i] + "y" + s[i + 1 :]])
            return s

        texts = [None, "", "\n\n", lines[0], "short"] + ["\n".join(edited(rnd.choice(lines)) for _ in range(5)) for _ in range(40)]
        docs = make(spark, list(enumerate(texts))).repartition(3)
    want = brute_lines(pairs(docs))
    got = {r[0]: (r[1], r[2]) for r in line_dedup.counted(docs).select("_row.doc_id", "kept", "n_removed").collect()}
    assert {k: v[0] for k, v in got.items()} == want
    left = {r["doc_id"]: r for r in line_dedup.without_repeated_lines(docs).collect()}
    assert set(left) == {d for d, t in want.items() if not got[d][1] or t.strip(" \t\n\r")}


def test_lines_rows(spark):
    docs = make(spark, [(1, "a line of twenty characters"), (1, "a line of twenty characters"), (2, "a line of twenty character")])
    got = line_dedup.without_repeated_lines(docs)
    assert [r["doc_id"] for r in got.collect()] == [1, 1] and got.columns == docs.columns
    assert line_dedup.without_repeated_lines(docs.limit(0)).count() == 0


def fill(us, goal):
    """us {key: (u, most)} scaled by one factor so that the sum of min(u, most) is the goal, or, where that is too much, until all are full."""
    if not any(u > 0 for u, _ in us.values()):
        return us
    top = max(m / u for u, m in us.values() if u > 0)
    sum_at = lambda f: math.fsum(min(u * f, m) for u, m in us.values())
    low, high = 0.0, top
    if sum_at(top) > goal:
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum_at(mid) < goal else (low, mid)
    return {k: (u * high, m) for k, (u, m) in us.items()}


def brute_mixing(rows, temper=0.7, keep=0.8, seed=17):
    """The doc_ids kept of rows (doc_id, source, lang, topic, tokens)."""
    cells = Counter()
    for _, *cell, n in rows:
        cells[tuple(cell)] += n
    total, goal = float(sum(cells.values())), []
    for d in range(3):
        m = Counter()
        for c, n in cells.items():
            m[c[d]] += n
        up = {k: n**temper for k, n in m.items()}
        aim = fill({k: (x / sum(up.values()), m[k] / (keep * total)) for k, x in up.items()}, 1.0)
        goal.append({k: min(x) for k, x in aim.items()})
    w, off = {c: (float(n), n / keep) for c, n in cells.items() if n}, math.inf
    for i in range(200):
        for d in range(3):
            for v, g in goal[d].items():
                w.update(fill({c: x for c, x in w.items() if c[d] == v}, g * total))
        if i % 2 == 1:
            last, off = off, 0.0
            for d in range(3):
                m = Counter()
                for c, x in w.items():
                    m[c[d]] += min(x)
                off = max(off, *(abs(m[k] / total - g) for k, g in goal[d].items()))
            if off <= 1e-4 or off > 0.98 * last:
                break
    out = set()
    share = {c: round(min(w[c]) / n, 6) if n else 1.0 for c, n in cells.items()}
    for i, *cell, _ in rows:
        h = xxhash.xxh64(seed.to_bytes(4, "little"), seed=xxhash.xxh64(i.to_bytes(8, "little", signed=True), seed=42).intdigest()).intdigest()
        if (h % (1 << 53)) / (1 << 53) < min(1.0, share[tuple(cell)] * keep):
            out.add(i)
    return out


def topic_of(text):
    t = text or ""
    return "note" if len(t) < 500 else "list" if t.count("\n") * 200 > len(t) else "article" if len(t) < 4000 else "book"


def test_mixing(spark):
    rows = [(r["doc_id"], r["source"], r["lang"], topic_of(r["text"]), len(brute.WORD.findall(r["text"] or ""))) for r in read(spark).collect()]
    got = {r["doc_id"] for r in queries.op6_mixing(spark, SF).where("kept").collect()}
    assert got == brute_mixing(rows)
    cells = spark.createDataFrame([("a", "x", "p", 60.0), ("a", "y", "q", 20.0), ("b", "x", "q", 10.0), (None, "y", "p", 10.0), (None, "x", "q", 5.0), ("b", "y", "p", 5.0)], "source string, lang string, topic string, tokens double")
    done = mixing.rake(cells, mixing.tempered(cells, 0.5))
    for d in mixing.DIMS:
        want = {r[d]: r["target"] for r in mixing.tempered(cells, 0.5)[d].collect()}
        for r in done.groupBy(d).agg(F.sum("weight").alias("w")).collect():
            assert abs(r["w"] / 110 - want[r[d]]) < 1e-3


def test_mixing_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, 1), (2, "", "a", "b", 2), (2, "", "a", "b", 2), (3, "w " * 90_000, "a", "b", 3)], "doc_id long, text string, source string, lang string, weight int")
    done = mixing.decided(docs).collect()
    assert len(done) == 4 and all(0 <= r["probability"] <= 1 for r in done)
    assert mixing.sampled(docs).columns == docs.columns
    assert mixing.sampled(docs.limit(0)).count() == 0


def test_ngram_large_group(spark):
    """More near copies of one text than a group of comparisons holds, and as many texts apart."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{base} end{i}") for i in range(200)] + [(1000 + i, " ".join(f"x{i}_{k}" for k in range(30))) for i in range(200)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join_components(make(spark, rows)).collect()}
    assert got == {i: 0 if i < 1000 else i for i, _ in rows}


def test_pipeline(spark):
    table = [r.asDict() for r in read(spark).collect()]
    rules = lambda t: (lambda w, c, s, d, r, base: not base and 100 * s <= 5 * c and 100 * sum(ch.isupper() for ch in t) <= 50 * c)(*brute.op2(t))
    table = [r for r in table if rules(r["text"]) and not ((n := [x for x in r["text"].split("\n") if x.strip()]) and len(n) >= 4 and 100 * (len(n) - len(set(n))) > 50 * len(n))]
    texts = brute_lines([(r["doc_id"], r["text"]) for r in table])
    table = [r | {"text": texts[r["doc_id"]]} for r in table]
    table = [r for r in table if r["text"].strip(" \t\n\r")]
    sets = {r["doc_id"]: brute.shingles(r["text"], 5) for r in table}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (n := len(sets[a] & sets[b])) and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    root = brute.roots(ids, links)
    table = [r for r in table if root[r["doc_id"]] == r["doc_id"]]
    kept = brute_mixing([(r["doc_id"], r["source"], r["lang"], topic_of(r["text"]), len(brute.WORD.findall(r["text"]))) for r in table])
    want = {r["doc_id"]: r["text"] for r in table if r["doc_id"] in kept}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    e = bpe.encoder(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.tiktoken"), corpus_pipeline.public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=corpus_pipeline.public_tokenizers.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    for i, text in want.items():
        assert list(got[i]["token_ids"]) == library.encode_ordinary(text) and got[i]["n_chars"] == len(text)


def test_quality_keeps_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    got = {r[0]: r[1] for r in quality.kept(docs).groupBy("quality").count().collect()}
    all_ = {r[0]: r[1] for r in docs.groupBy("quality").count().collect()}
    assert got[1] >= 0.97 * all_[1] and got.get(0, 0) <= 0.1 * all_[0]


@pytest.mark.parametrize("keep", [0.0, 0.8])
def test_mixing_rakes_few_cells_in_one_job(spark, monkeypatch, keep):
    """The fold over arrays gives the weights of the rounds with windows, and writes two tables, not one a round."""
    rnd, rows = random.Random(4), []
    for a in (None, "", "b", "c", "d"):
        for b in (None, "x", "y", "z"):
            rows += [(a, b, c, float(rnd.choice([0, 3, 50, 700, 9000]))) for c in ("note", "list", "book") if rnd.random() < 0.8]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens double")
    targets = mixing.within(cells, mixing.tempered(cells, 0.7), keep) if keep else mixing.tempered(cells, 0.7)
    made, write = [], mixing.written
    monkeypatch.setattr(mixing, "written", lambda df, name: made.append(name) or write(df, name))
    key = lambda r: (r["source"] or "-" + str(r["source"]), r["lang"] or "-", r["topic"])
    got = {key(r): r["weight"] for r in mixing.rake(cells, targets, keep, strict=False).collect()}
    assert len(made) == 2
    monkeypatch.setattr(mixing, "FOLDED", 0)
    want = {key(r): r["weight"] for r in mixing.rake(cells, targets, keep, strict=False).collect()}
    assert len(got) == len(rows) and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) <= 1e-6 * (1 + want[k]) for k in want)
