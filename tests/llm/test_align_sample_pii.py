"""Operators 11 to 13 against plain Python over small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers as P
import pytest

from skein.llm import align, importance, pii, queries

SF = "/root/testdata/sf0.001"
FILES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN
ODD = [
    (1, None), (2, ""), (3, "hello\n\nworld  x"), (4, " lead"), (5, "trail "), (6, "▁x y"), (6, "x▁ ▁y"), (7, "<|endoftext|> <s> a"), (8, "ﬁ 😀 a\x00b nbsp\xa0x"), (9, "don't 's  's"),
    (10, "word " * 4000), (10, "word " * 4000), (11, "a" * 3000 + "é" * 300), (None, "no id"), (12, "   "),
]


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_transducer_closes_groups_on_empty_residuals():
    t = align.Transducer([b" a", b"b", b"cd", b"x"], [b" ", b"ab", b"c", b"d"])
    assert t.ends([0, 1, 2], [0, 1, 2, 3]) == [(2, 2), (3, 4)]
    assert t.ends([0, 1, 2], [0, 1, 2, 3]) == [(2, 2), (3, 4)]
    assert t.ends([0, 3], [0, 1]) is None and t.ends([0], [0]) is None and t.ends([], []) == []


def brute_align(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    a_side, b_side = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a_side.encode_special_tokens = True
    out, counts = [], Counter()
    for doc, text in docs:
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        a_bytes = [align._entry_bytes(a_side.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        want = (" " + text).encode() if text else b""
        if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            a = b = []
            a_bytes = b_bytes = []
        ends = lambda xs: {sum(map(len, xs[: i + 1])): i for i in range(len(xs))} if len(xs) < 500 else _ends(xs)
        ea, eb = ends(a_bytes), ends(b_bytes)
        groups, links, i, j = [], [], 0, 0
        for end in sorted(ea.keys() & eb.keys()):
            x, y = ea[end], eb[end]
            groups.append(",".join(map(str, a[i : x + 1])) + "|" + ",".join(map(str, b[j : y + 1])))
            links.append((a[x], b[y]))
            i, j = x + 1, y + 1
        counts.update(links)
        out.append((doc, len(a), len(b), groups, links))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return [(d, na, nb, len(g), len(li), sum(counts[p] == top[p[1]] for p in li), sum(counts[p] for p in li), digest(g)) for d, na, nb, g, li in out]


def _ends(xs):
    out, at = {}, 0
    for i, x in enumerate(xs):
        at += len(x)
        out[at] = i
    return out


@pytest.mark.parametrize("most", [align.MOST_PAIRS, 20, 0])
def test_token_links(spark, most):
    docs = ODD + rows(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40))
    df = spark.createDataFrame([(d, t, "n", 1) for d, t in docs], "doc_id long, text string, n_a string, links int").repartition(3)
    got = rows(align.token_links(df, *FILES, most=most))
    assert sorted(got, key=repr) == sorted(brute_align(docs), key=repr)
    assert rows(align.token_links(df.limit(0), *FILES)) == []


def test_token_links_query(spark):
    docs = rows(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    assert sorted(rows(queries.op11_align(spark, SF))) == sorted(brute_align(docs))


def test_alignments_give_the_groups(spark):
    df = spark.createDataFrame([(1, "hello wörld"), (2, None), (3, "▁")], "doc_id long, text string")
    got = {r["doc_id"]: r["groups"] for r in align.alignments(df, *FILES).collect()}
    assert got[2] == got[3] == [] and len(got[1]) >= 2 and all(g["a"] and g["b"] for g in got[1])


def test_few_runs_are_remembered(monkeypatch):
    monkeypatch.setattr(align, "MEMORY", 3)
    monkeypatch.setattr(align, "TRANSITIONS", 5)
    small, large = align.Aligner(*FILES), align.aligner(*FILES)
    rnd = random.Random(3)
    for _ in range(30):
        text = " ".join(rnd.choice(("one", "zwölf", "naïveté", "x-y", "▁", "thing", "42nd")) for _ in range(6))
        assert small.text(text) == large.text(text)


def brute_importance(docs, target, n=1, buckets=10_000, share=10, min_words=20, seed="2024"):
    def features(text):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(ws), [zlib.crc32(" ".join(ws[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(ws) - k + 1)]

    made = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for *_, f in made for b in f), Counter(b for x in target for b in features(x)[1])
    total, t_total = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (t_total + buckets))))
    out = []
    for d, n_words, f in made:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, n_words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[3], r[2]))
    for k, r in enumerate(fit[: share * len(fit) // 100]):
        r[5] = k + 1
    return [tuple(r) for r in out]


@pytest.mark.parametrize("n", [1, 3])
def test_importance(spark, n):
    rnd = random.Random(n)
    text = lambda: " ".join(rnd.choice(("Alpha", "beta", "Γδ", "x9", "naïve", "the-end")) for _ in range(rnd.randrange(15, 40)))
    docs = [(i // 2, text()) for i in range(120)] + [(500, None), (501, ""), (502, "!?"), (None, text()), (7, "same " * 25), (7, "same " * 25)]
    target = ["alpha beta", None, "x9 x9"]
    df = spark.createDataFrame([(d, t, 1, "w") for d, t in docs], "doc_id long, text string, score int, weight string").repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    want = brute_importance(docs, target, n, share=30)
    got = rows(importance.resample_scores(df, aim, n, share=30))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    drawn = importance.resampled(df, aim, n, share=30)
    assert drawn.columns == df.columns and drawn.count() == sum(r[5] is not None for r in want)
    assert rows(importance.resample_scores(df.limit(0), aim)) == [] and importance.resample_scores(df, aim.limit(0)).count() == len(docs)


def test_importance_query_against_sql(spark):
    from ..oracle import compare, duck

    compare(spark, duck(SF), queries.op12_importance, queries.oracle_sql()["op12_importance"], SF)


PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_base(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            double = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (12 <= len(digits) <= 19 and sum(double) % 10 == 0) or k == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    rnd = random.Random(5)
    for _ in range(3000):
        text = "".join(rnd.choice(("a", "b.c", "@", "x@y.de", "_", "1", "12", "255.", ".", "-", " ", "+1", "(", ")", "4111 1111 1111 1111", "é", "٣", "\n")) for _ in range(rnd.randrange(14)))
        assert pii.base_spans(text) == brute_base(text), text
    long = "9" * 6000 + "." + "1" * 5000 + ".2.3 00001.002.3.4"
    assert pii.base_spans(long) == [(len(long) - 13, 1, len(long))]


@pytest.fixture(scope="module")
def weights(spark):
    return pii.trained(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_dynamic_program_finds_the_best_labelling(weights):
    rnd = random.Random(8)
    for _ in range(150):
        text = "".join(rnd.choice(("jo", " at ", " dot ", "@", ".", "12", "555", "1234", "-", " ", "+4", "(555) ")) for _ in range(6)) + "1234567"
        for s, e in pii.stretches(text):
            n, segments = pii.candidates(text, s, e)

            def best(i, segments=segments, n=n):
                if i == n:
                    return 0.0
                return max([best(i + 1), *(weights[x[2]][x[5]].sum() + best(x[1]) for x in segments if x[0] == i)])

            got = pii.best_segments(n, segments, weights)
            spans = {(x[3], x[2], x[4]): weights[x[2]][x[5]].sum() for x in segments}
            assert sum(spans[g] for g in got) == pytest.approx(best(0), abs=1e-6)
            assert all(a[2] <= b[0] for a, b in zip(got, got[1:]))


def test_other_forms_are_found_and_look_alikes_are_not(spark, weights):
    """Held out: documents of another table, and other values than those of the fit."""
    rnd = random.Random(99)
    texts = [t for (t,) in rows(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id >= 9000 and length(text) < 5000").select("text").limit(250)) if not pii.base_spans(t) and " " in t]
    hit = total = wrong = 0
    for text in texts:
        at = rnd.choice([m.end() for m in re.finditer(" ", text)])
        for k in range(4):
            value = pii._other_form(k, pii._made_up(k, rnd), rnd)
            total += 1
            hit += (at, k, at + len(value)) in pii.all_spans(f"{text[:at]}{value} {text[at:]}", weights)[1]
            base, spans = pii.all_spans(f"{text[:at]}{pii._look_alike(rnd)} {text[at:]}", weights)
            wrong += len(spans) > len(base)
        base, spans = pii.all_spans(text, weights)
        assert spans == base
    assert total > 400 and hit >= 0.95 * total and wrong <= 0.01 * total, (hit, wrong, total)


def test_personal_data_of_odd_rows(spark, weights):
    docs = [(1, None), (2, ""), (3, "é mail a@b.co, again a@b.co"), (3, "é mail a@b.co, again a@b.co"), (None, "1.2.3.4"), (4, "x " * 5000 + "+49 (30) 1234-5678"), (5, "1 " * 20000), (6, "call 4111-1111-1111-1111")]
    df = spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id long, text string, spans string").repartition(2)
    got = {(r["doc_id"], r["spans"]) for r in pii.digests(df).collect()}
    assert {(1, ""), (2, ""), (3, "email:7:13,email:21:27"), (None, "ip:0:7"), (5, ""), (6, "card:5:24")} <= got
    assert pii.digests(df).count() == len(docs) and pii.digests(df.limit(0)).count() == 0
    hidden = {r["doc_id"]: r["text"] for r in pii.masked(df, weights).collect()}
    assert hidden[3] == "é mail [email], again [email]" and hidden[1] is None and pii.masked(df, weights).columns == df.columns


def test_personal_data_query(spark):
    docs = dict(rows(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")))
    for r in queries.op13_pii(spark, SF).collect():
        base = brute_base(docs[r["doc_id"]])
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[1] == i for b in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest() and set(said.split(",")) <= set(r["spans"].split(","))
