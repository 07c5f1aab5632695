"""Personal data by plain patterns and a semi-Markov conditional random field.

Base spans are the leftmost, non-overlapping matches of one pattern a kind that pass its test.  The
field adds spans in other forms: written-out addresses (``jo (at) mail dot org``), numbers without a
plus or with other separators, masked dots.  Stretches of text that hold digits, an at sign or a
written ``at`` are cut into atoms (letters, digits, single signs).  Every run of at most LONGEST atoms
that can be a kind's is a candidate segment with features of the whole span: digits and their groups,
check digits, octets, separators, brackets, what touches it, and words before it.  A dynamic program
over atoms picks boundaries and kinds jointly; atoms outside of segments score zero, so the stretches
of a text are independent of each other and the text's best labelling is that of all of them.

The weights are those that make the labels of a bounded sample most likely (forward-backward over
segments, TRAIN_ROWS texts of at most TRAIN_CHARS characters, picked by a hash of their id).  Labels
there are the base spans, copies of them in other forms, and values made up for kinds that the sample
lacks; look-alikes (dates, versions, prices, numbers that fail a test) have none.  Only the windows
around them reach the driver, at most TRAIN_WINDOWS.

Each row is read alone and nothing but the weights is shared.  Secrets such as keys are no kind here.

Defined cases: a null text is empty and has no spans; very long texts take time in proportion to their
length, and numbers of any length are tested without being converted; ties between segmentations go to
the fewer atoms in segments, then to the earlier kind; rows that repeat a doc_id get a row each; an
empty table gives an empty table and untrained weights; other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone")
#: Most atoms of a segment; sample for the weights: texts, their length, windows, characters on both sides of a window's value.
LONGEST, TRAIN_ROWS, TRAIN_CHARS, TRAIN_WINDOWS, AROUND = 32, 4000, 20_000, 2400, 40
#: Values made up for each kind in the sample, rounds and step of the fit, and its penalty.
MADE_UP, ROUNDS, STEP, RIDGE = 120, 120, 0.3, 0.02

# Base patterns.  A start inside a run of characters fails if the run's own start does, so that runs are
# entered at their start only (or where the last match ended) and are not read again for each character.
_EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_EMAIL_AT, _EMAIL_NEXT = re.compile(_EMAIL), re.compile(r"(?<![A-Za-z0-9._%+-])" + _EMAIL)
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain patterns' matches that pass, in order."""
    out = []
    if "@" in text:
        at = 0
        while m := _EMAIL_AT.match(text, at) or _EMAIL_NEXT.search(text, at):
            out.append((m.start(), 0, m.end()))
            at = m.end()
    if not _DIGIT.search(text):
        return out
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


# Stretches, atoms and candidate segments

_NUMBERS = re.compile(r"(?:[0-9+()\[\]./-]|(?<=[\[(])dot(?=[\])])|(?<=[0-9)]) {1,2}(?=[0-9+(])|(?<=[0-9]) (?=[\[(]?dot[\])]? [0-9])|(?<=[0-9] )dot(?= [0-9])|(?<=dot) (?=[0-9]))+")
_AT = re.compile(r"@| at | ?[\[(] ?at ?[\])] ?", re.IGNORECASE)
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.| ?[\[(] ?dot ?[\])] ?| dot )[A-Za-z0-9-]+)+", re.IGNORECASE)
_ATOM = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Words before a span that hint at its kind.
_HINTS = (("mail", "contact", "write"), ("ip", "host", "server", "addr"), ("card", "visa", "credit", "debit"), ("phone", "tel", "call", "mobile", "fax"))
#: Longest local part of an address.
_LOCAL_CHARS = 64


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of a text that can hold candidates, in order and apart."""
    found = []
    if _DIGIT.search(text):
        found += [(m.start(), m.end()) for m in _NUMBERS.finditer(text) if m.end() - m.start() >= 7]
    for m in _AT.finditer(text):
        right = _DOMAIN.match(text, m.end())
        start = m.start()
        while start > 0 and m.start() - start < _LOCAL_CHARS and text[start - 1] in _LOCAL:
            start -= 1
        if right and start < m.start():
            found.append((start, right.end()))
    out: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


N_FEATURES = 42
_GOES_ON = re.compile(r"(?:\.| ?[\[(] ?dot ?[\])] ?| dot )[A-Za-z0-9]", re.IGNORECASE)


def _features(text: str, start: int, end: int, digits: str, groups: list[str], seps: list[str]) -> list[int]:
    """Numbers of the features that a span has."""
    span, n = text[start:end], len(digits)
    left, right = text[start - 1 : start], text[end : end + 1]
    low = span.lower()
    f = [0]
    if span[0] == "+":
        f.append(1)
    if "(" in span:
        f.append(2 if span.count("(") == span.count(")") else 38)
    if left and (left.isalnum() or left in "@_#=\""):
        f.append(3)
    if right and (right.isalnum() or right in "@_\""):
        f.append(4)
    if left and left in ".-+/(:,":
        f.append(5)
    if right and (right in "-/:" or (right in ".," and text[end + 1 : end + 2].isalnum())):
        f.append(6)
    f.append(12 if n < 7 else 7 if n < 9 else 8 if n < 12 else 9 if n == 12 else 10 if n < 20 else 11)
    if 12 <= n <= 19:
        f.append(13 if luhn(digits) else 14)
    sizes = [len(g) for g in groups]
    if len(groups) == 1:
        f.append(15)
    if sizes == [4, 4, 4, 4]:
        f.append(16)
    if sizes and sizes[-1] == 4:
        f.append(17)
    if sizes[-2:] == [3, 4]:
        f.append(18)
    dots = [s for s in seps if s.strip(" ()[]") in (".", "dot")]
    if len(groups) == 4 and len(dots) == 3 == len(seps):
        f.append(19 if all(map(_octet, groups)) and max(sizes) <= 3 else 20)
    kinds = {s.strip() for s in seps}
    if len(kinds) > 2:
        f.append(21)
    if any(c in span for c in "/:,"):
        f.append(22)
    if "@" in span:
        f.append(23)
    elif re.search(r"[\[(] ?at ?[\])]", low):
        f.append(24)
    elif " at " in low:
        f.append(25)
    elif any(c.isalpha() for c in low.replace("dot", "")):
        f.append(29)
    last = re.split(r"[^a-z0-9-]+", low)[-1]
    if last.isalpha() and 2 <= len(last) <= 10:
        f.append(26)
    if "dot" in low:
        f.append(27)
    if 25 in f and 27 in f:
        f.append(28)
    if any(len(s.strip("()[] ")) > 1 and "dot" not in s.lower() or "  " in s for s in seps):
        f.append(30)
    before = text[max(0, start - 30) : start].lower()
    f += [31 + k for k, words in enumerate(_HINTS) if any(w in before for w in words)]
    if groups and len(groups[0]) == 4 and groups[0][:2] in ("19", "20") and n <= 14:
        f.append(35)
    if sizes and max(sizes) <= 2:
        f.append(36)
    if len(groups) >= 3 and sizes[:1] == [3] and n == 10:
        f.append(37)
    if text[end : end + 1] and text[end] == " " and text[end + 1 : end + 2].isdigit() or (left == " " and text[start - 2 : start - 1].isdigit()):
        f.append(39)
    if len(groups) > 1 and sizes not in ([4] * len(groups), [4, 6, 5]):
        f.append(40)
    if _GOES_ON.match(text, end):
        f.append(41)
    return f


def candidates(text: str, start: int, end: int) -> tuple[int, list[tuple[int, int, int, int, int, list[int]]]]:
    """(number of atoms, segments (first atom, atom after the last, kind, start, end, features)) of a stretch, by last atom."""
    atoms = [(m.start() + start, m.end() + start) for m in _ATOM.finditer(text[start:end])]
    n = len(atoms)
    what = [text[s] for s, _ in atoms]
    digit, letter = [c.isascii() and c.isdigit() for c in what], [c.isascii() and c.isalpha() for c in what]
    low = [text[s:e].lower() if x and e - s <= 3 else "" for (s, e), x in zip(atoms, letter)]
    n_digits, n_marks, n_words, n_plus, n_groups, n_dots = [0], [0], [0], [0], [0], [0]
    for i, (s, e) in enumerate(atoms):
        n_digits.append(n_digits[-1] + (e - s if digit[i] else 0))
        n_marks.append(n_marks[-1] + (what[i] == "@" or low[i] == "at"))
        n_words.append(n_words[-1] + (letter[i] and low[i] != "dot"))
        n_plus.append(n_plus[-1] + (what[i] == "+"))
        n_groups.append(n_groups[-1] + digit[i])
        n_dots.append(n_dots[-1] + (what[i] == "." or low[i] == "dot"))
    has_mark = n_marks[n] > 0
    # digits just before and behind: a number is no part of a longer run of numbers, unless a plus or a bracket begins it
    after_digit = [any(digit[max(0, i - 3) : i]) for i in range(n)]
    before_digit = [any(digit[j : j + 3]) for j in range(n + 1)]
    opens = [what[i] in "+(" or ((digit[i] or letter[i]) and (has_mark or not after_digit[i])) for i in range(n)]
    out, starts = [], []
    for j in range(1, n + 1):
        if opens[j - 1]:
            starts.append(j - 1)
        if starts and starts[0] < j - LONGEST:
            starts = [i for i in starts if i >= j - LONGEST]
        if not (digit[j - 1] or letter[j - 1]):
            continue
        for i in starts:
            count, marks, words = n_digits[j] - n_digits[i], n_marks[j] - n_marks[i], n_words[j] - n_words[i]
            kinds: tuple[int, ...] = ()
            if marks == 1 and (letter[j - 1] or words > 1) and what[i] not in "+(":
                kinds = (0,)
            elif words == 0 and digit[j - 1] and not letter[i] and 4 <= count <= 19 and n_plus[j] == n_plus[i + 1]:
                if what[i] not in "+(" and (before_digit[j] or after_digit[i]):
                    continue
                parts = n_groups[j] - n_groups[i]
                if parts == 4 and n_dots[j] - n_dots[i] == 3 and count <= 12 and digit[i]:
                    kinds = (1,)
                if 12 <= count and 3 * parts <= count and digit[i]:
                    kinds += (2,)
                if 7 <= count <= 15 and 2 * parts <= count:
                    kinds += (3,)
            if not kinds:
                continue
            groups, seps, gap = [], [], ""
            for k in range(i, j):
                part = text[atoms[k][0] : atoms[k][1]]
                if digit[k]:
                    if groups and gap:
                        seps.append(gap)
                    groups.append(part)
                    gap = ""
                else:
                    gap += part
            if kinds == (0,):
                span = text[atoms[i][0] : atoms[j - 1][1]]
                mark = _AT.search(span)
                if not mark or not mark.start() or not _LOCAL.issuperset(span[: mark.start()]) or not _DOMAIN.fullmatch(span, mark.end()):
                    continue
                # an at between words is only one of an address if its dots are written out as well
                if mark[0].lower() == " at " and "dot" not in span[mark.end() :].lower():
                    continue
            elif 1 in kinds and not (all(map(_octet, groups)) and all(x.strip(" ()[]").lower() in (".", "dot") for x in seps)):
                kinds = tuple(k for k in kinds if k != 1)
            if 2 in kinds and not luhn("".join(groups)):
                kinds = tuple(k for k in kinds if k != 2)
            feats = _features(text, atoms[i][0], atoms[j - 1][1], "".join(groups), groups, seps) if kinds else []
            out += [(i, j, k, atoms[i][0], atoms[j - 1][1], feats) for k in kinds]
    return n, out


def best_segments(n: int, segments: list, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the labelling of n atoms with the largest score."""
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    at = 0
    for j in range(1, n + 1):
        top, how = best[j - 1], None
        while at < len(segments) and segments[at][1] == j:
            i, _, k, _, _, f = segments[at]
            score = best[i] + float(weights[k][f].sum())
            if score > top + 1e-9:
                top, how = score, at
            at += 1
        best[j], back[j] = top, how
    out, j = [], n
    while j > 0:
        how = back[j]
        if how is None:
            j -= 1
        else:
            i, _, k, s, e, _ = segments[how]
            out.append((s, k, e))
            j = i
    return out[::-1]


def all_spans(text: str, weights: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and these with the field's spans that overlap none of them."""
    base = base_spans(text)
    more = []
    for s, e in stretches(text):
        n, segments = candidates(text, s, e)
        if segments:
            more += [x for x in best_segments(n, segments, weights) if not any(b[0] < x[2] and x[0] < b[2] for b in base)]
    return base, sorted(base + more)


# Fitting the weights


def _other_form(kind: int, value: str, rnd: random.Random) -> str:
    """A value in a form that the base patterns do not know."""
    if kind == 0:
        at, dot = rnd.choice(((" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), (" (at) ", " dot "), ("[at]", "[dot]")))
        local, _, domain = value.partition("@")
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return value.replace(".", rnd.choice(("[.]", "(.)", "[dot]", " dot ")))
    digits = re.sub(r"[^0-9]", "", value)
    if kind == 2:
        return rnd.choice((".", "/", "  ")).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    tail = digits[-10:]
    sep = rnd.choice("-. ")
    return rnd.choice((f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", sep.join((tail[:3], tail[3:6], tail[6:])), f"1-{tail[:3]}-{tail[3:6]}-{tail[6:]}"))


def _made_up(kind: int, rnd: random.Random) -> str:
    number = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rnd.choice("abcdefghilmnoprstuv") for _ in range(rnd.randrange(3, 9)))
    if kind == 0:
        return f"{word()}{rnd.choice(('', '.' + word(), number(2)))}@{word()}.{rnd.choice(('com', 'org', 'net', 'example.com', 'de'))}"
    if kind == 1:
        return ".".join(str(rnd.randrange(256)) for _ in range(4))
    if kind == 2:
        head = rnd.choice("3456") + number(14)
        return next(head + c for c in "0123456789" if luhn(head + c))
    return f"+{rnd.randrange(1, 50)} ({number(3)}) {number(3)}-{number(4)}"


def _look_alike(rnd: random.Random) -> str:
    number = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    year = str(rnd.randrange(1900, 2030))
    return rnd.choice((
        f"{year}-{rnd.randrange(10, 13)}-{rnd.randrange(10, 29)}", f"{rnd.randrange(10, 29)}.{rnd.randrange(10, 13)}.{year}", f"{rnd.randrange(10, 29)}/{rnd.randrange(10, 13)}/{year}",
        f"{rnd.randrange(9)}.{rnd.randrange(20)}.{rnd.randrange(20)}", f"{year}-{rnd.randrange(1900, 2030)}", f"{number(1)}.{number(3)}.{number(3)}", number(rnd.choice((7, 8, 9, 11, 13))),
        f"{rnd.randrange(256, 999)}.{rnd.randrange(256, 999)}.{number(2)}.{number(2)}", f"{number(4)} {number(4)}", f"{number(2)} {number(3)} {number(2)}", ("0" + number(15)) if not luhn("0" + number(15)) else number(21),
        f"{year}-{rnd.randrange(10, 13)}-{rnd.randrange(10, 29)} {rnd.randrange(10, 24)}.{rnd.randrange(10, 60)}", f"arrived at noon.{number(2)}", f"{number(3)}.{number(2)}.{number(4)}.{number(3)}.{number(1)}",
    ))


def windows(texts: list[str]) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, gold spans) to learn from: places with base spans, copies in other forms, made-up values and look-alikes."""
    rnd = random.Random(7)
    out, seen, places = [], [0] * len(KINDS), []
    for text in texts:
        base = base_spans(text)
        for s, k, e in base:
            left, right = text[max(0, s - AROUND) : s], text[e : e + AROUND]
            if base_spans(left) or base_spans(right) or any(b != (s, k, e) and b[0] < e and s < b[2] for b in base):
                continue
            seen[k] += 1
            for value in (text[s:e], _other_form(k, text[s:e], rnd), _other_form(k, text[s:e], rnd)):
                out.append((left + value + right, [(len(left), k, len(left) + len(value))]))
        spots = [m.start() for m in re.finditer(" ", text[:2000])]
        if spots and not base:
            at = rnd.choice(spots)
            left, right = text[max(0, at - AROUND) : at + 1], text[at : at + AROUND]
            if not base_spans(left) and not base_spans(right):
                places.append((left, right))
        out += [(text[max(0, s - AROUND) : e + AROUND], []) for s, e in stretches(text) if e - s < 400 and not base_spans(text[max(0, s - AROUND) : e + AROUND])]
    rnd.shuffle(places)
    for left, right in places[:MADE_UP] if places else []:
        for k in range(len(KINDS)):
            value = _made_up(k, rnd)
            for value in (value, _other_form(k, value, rnd), _other_form(k, value, rnd)):
                out.append((left + value + right, [(len(left), k, len(left) + len(value))]))
        out += [(left + x + right, []) for x in (_look_alike(rnd) for _ in range(8))]
    rnd.shuffle(out)
    return out[:TRAIN_WINDOWS]


def fit(examples: list[tuple[str, list[tuple[int, int, int]]]]) -> np.ndarray:
    """Weights (kind, feature) that maximise the penalised log-likelihood of the gold spans."""
    weights = np.zeros((len(KINDS), N_FEATURES))
    weights[:, 0] = -1.0
    parts, rows, sizes, gold = [], [], [], []
    for text, spans in examples:
        wanted = {(s, e, k) for s, k, e in spans}
        for s, e in stretches(text):
            n, segments = candidates(text, s, e)
            if not segments:
                continue
            here = [(x[3], x[4], x[2]) in wanted for x in segments]
            parts.append((n, len(rows), [(x[0], x[1]) for x in segments]))
            for x in segments:
                rows.append(np.array(x[5]) + x[2] * N_FEATURES)
                sizes.append(len(x[5]))
            gold += here
    if not rows:
        return weights
    flat, starts = np.concatenate(rows), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(rows)), sizes)
    gold_row = np.array(gold, float)
    w, seen = weights.ravel().copy(), np.zeros(weights.size)
    for _ in range(ROUNDS):
        score = np.add.reduceat(w[flat], starts).tolist()
        marginal = np.zeros(len(rows))
        for n, first, ends in parts:
            by_end: list[list[int]] = [[] for _ in range(n + 1)]
            for c, (_, j) in enumerate(ends):
                by_end[j].append(c)
            alpha = [0.0] * (n + 1)
            for j in range(1, n + 1):
                total = alpha[j - 1]
                for c in by_end[j]:
                    x = alpha[ends[c][0]] + score[first + c]
                    total = max(total, x) + math.log1p(math.exp(-abs(total - x)))
                alpha[j] = total
            beta = [None] * n + [0.0]
            for j in range(n, 0, -1):
                here = beta[j]
                if here is None:
                    here = beta[j] = -math.inf
                x = here
                beta[j - 1] = x if beta[j - 1] is None else max(x, beta[j - 1]) + math.log1p(math.exp(-abs(x - beta[j - 1])))
                for c in by_end[j]:
                    i, x = ends[c][0], here + score[first + c]
                    marginal[first + c] = math.exp(min(0.0, alpha[i] + x - alpha[n]))
                    beta[i] = x if beta[i] is None else max(x, beta[i]) + math.log1p(math.exp(-abs(x - beta[i])))
        step = np.bincount(flat, (gold_row - marginal)[owner], minlength=len(w)) - RIDGE * w
        seen += step * step
        w += STEP * step / (np.sqrt(seen) + 1e-6)
    return w.reshape(weights.shape)


def trained(docs: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights from about ``rows`` texts of docs (doc_id, text), all if there are fewer."""
    short = docs.where(F.length("text") <= TRAIN_CHARS)
    share = min(1.0, rows / max(1, docs.count()))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)), F.lit(1 << 30))
    picked = short.where(place < int(share * (1 << 30))).select(place.alias("place"), "text")

    def useful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of a text only what windows() looks at: the stretches and what is around them, else the start
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                near = [text[max(0, s - 2 * AROUND) : e + 2 * AROUND] for s, e in stretches(text)[:8] if e - s < 400]
                out.append(near or [text[:400]])
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(out, pa.list_(pa.string()))], names=["place", "parts"])

    parts = picked.mapInArrow(useful, "place long, parts array<string>").collect()
    return fit(windows([x for r in sorted(parts, key=lambda r: (r["place"], r["parts"])) for x in r["parts"]]))


def personal_data(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """(doc_id, base, spans) of every row of docs (doc_id, text): arrays of (kind, start, end), places in characters, end exclusive."""
    docs = docs.select("doc_id", "text")
    weights = trained(docs) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct({"kind": pa.string(), "start": pa.int32(), "end": pa.int32()}))
        shown = lambda xs: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in xs]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [all_spans(t or "", weights) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([shown(m[i]) for m in made], kind) for i in range(2))], names=["doc_id", "base", "spans"])

    spans = "array<struct<kind:string,start:int,end:int>>"
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {spans}, spans {spans}")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of base spans, and all spans as text."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    found = personal_data(docs)
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def masked(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """docs (doc_id, text) with each span of a text replaced by its kind in brackets; overlapping spans are replaced together."""
    weights = trained(docs.select("doc_id", "text")) if weights is None else weights

    def cover(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for s, k, e in all_spans(text, weights)[1]:
            if s >= at:
                out += [text[at:s], f"[{KINDS[k]}]"]
            at = max(at, e)
        return "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([cover(t) for t in batch.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([text if n == "text" else batch.column(i) for i, n in enumerate(batch.schema.names)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
