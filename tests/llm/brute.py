"""The operators' results by plain Python over small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def op1(vectors, k=5):
    q = {i: [math.floor(256 * float(x)) for x in v] for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in (i for i in q if i % 50 == 0):
        best = sorted((-sum(x * y for x, y in zip(q[a], q[b])), b) for b in q if b != a)[:k]
        out += [(a, r, b, -s) for r, (s, b) in enumerate(best, 1)]
    return out


def op2(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    base = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), base


def op3(turns):
    conv = defaultdict(list)
    for c, t, r, x in turns:
        conv[c].append((t, r or "", x or ""))
    out = {}
    for c, rows in conv.items():
        rows.sort()
        said, loss = "".join(f"{r}\n{x}\n" for _, r, x in rows), "".join(x for _, r, x in rows if r == "assistant")
        out[c] = (len(rows), sha(said), len(loss), sha(loss))
    return out


def op4(docs, size=100):
    seen, out = set(), {}
    for doc, text in sorted(docs):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            if w in seen:
                gone[i : i + size] = b"\1" * size
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[doc] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept))
    return out


def op5(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    hits = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        hits += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def shingles(text, n=4):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in up}


def op8(docs):
    sets = {d: shingles(t) for d, t in docs}
    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    pairs = Counter()
    for ds in by.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                pairs[a, b] += 1
    links = [(a, b) for (a, b), n in pairs.items() if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n)]
    root = roots(sets, links)
    return {d: (len(sets[d]), root[d]) for d in sets}


def op9(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url) if url and "://" in url else None
    host, path = (lower(m[1]), m[2]) if m else ("", "")
    best = None
    for verdict, rule in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")):
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return (host, path, *(best or (None, None)))
