"""Edit distances of many pairs of lines at once, in numpy, for use inside tasks."""

from __future__ import annotations

import numpy as np

#: Edits for which a band of rows fits in the bits of an unsigned long.
NARROW = 31
#: Columns of a long pair whose characters are looked up together.
SPAN = 4096
#: Characters of the pairs that are worked on together.
CHARS = 1 << 20


def _padded(texts: list[str], before: int, width: int, fill: int) -> np.ndarray:
    """The texts' code points as rows of a matrix of that width, each behind so many fillers."""
    out = np.full((len(texts), width), fill, np.uint32)
    for row, text in zip(out, texts):
        row[before : before + len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _low(k: np.ndarray | int) -> np.ndarray:
    return (np.uint64(1) << np.asarray(k, np.uint64)) - np.uint64(1)


def banded_bits(x: list[str], y: list[str], t: int) -> np.ndarray:
    """For each pair its edit distance if that is at most t (up to NARROW), else some larger number.

    y is sorted by length, and the lengths of a pair differ by t at most.  The rows j - t to j + t of
    column j are the bits of two longs, which of them are one more and which one less than the row above
    (Myers' vectors, Hyyrö's band along the diagonal); all pairs take their next column together.
    """
    m, n = np.array([len(s) for s in x], np.int64), np.array([len(s) for s in y], np.int64)
    out = np.maximum(m, n)
    width, one = 2 * t + 1, np.uint64(1)
    octets = -(-width // 8)
    last = int(n[-1])
    xs, ys = _padded(x, t, last + 8 * octets + t, 0xFFFFFFFE), _padded(y, 0, last, 0xFFFFFFFF)
    full, top = _low(width), one << np.uint64(2 * t)
    row = np.flatnonzero((n > 0) & (m > 0))
    xs, ys = xs[row], ys[row]
    vp, vn, score = np.full(len(row), full & ~_low(t)), np.zeros(len(row), np.uint64), np.full(len(row), t)
    limit = 2 * t + n[row] - m[row]
    for j in range(1, last + 1):
        if not len(row):
            break
        same = np.packbits(xs[:, j - 1 : j - 1 + 8 * octets] == ys[:, j - 1 : j], axis=1, bitorder="little")
        eq = np.zeros((len(row), 8), np.uint8)
        eq[:, :octets] = same
        eq = eq.view("<u8")[:, 0] & full
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        lower = d0 >> one
        score = score + (d0 < top)
        vp, vn = ((d0 & vp) | ~(lower | hp)) & full, lower & hp
        end = int(np.searchsorted(n[row], j, "right"))
        if end:
            i = row[:end]
            below = _low(2 * t) & ~_low(m[i] - n[i] + t)
            out[i] = score[:end] - np.bitwise_count(vp[:end] & below).astype(np.int64) + np.bitwise_count(vn[:end] & below)
        # the lowest row's score only grows, and at most one goes for each row that lies below the result
        if end or j % 16 == 0:
            on = score <= limit
            on[:end] = False
            over = ~on
            over[:end] = False
            out[row[over]] = t + 1
            row, xs, ys, vp, vn, score, limit = row[on], xs[on], ys[on], vp[on], vn[on], score[on], limit[on]
    return out


def banded_long(x: str, y: str, t: int) -> int:
    """The edit distance of one pair if it is at most t, else some larger number, for a band of any width.

    The bits of :func:`banded_bits` as whole numbers of Python.  Where the rows of a character stand is
    noted for SPAN columns (or one band, if that is more) and their rows at a time.
    """
    m, n = len(x), len(y)
    if not m or not n or abs(m - n) > t:
        return max(m, n)
    xs, ys = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (x, y))
    full, top = (1 << (2 * t + 1)) - 1, 2 * t
    vp, vn, score, limit = full & ~((1 << t) - 1), 0, t, 2 * t + n - m
    span = max(SPAN, 2 * t + 1)
    for begin in range(0, n, span):
        above = begin - t  # the row of x, from 0, at bit 0 of the first column
        low = max(above, 0)
        rows, columns = xs[low : begin + span + t], ys[begin : begin + span].tolist()
        # rows sorted by character, so that each one's rows lie together
        order = np.argsort(rows, kind="stable")
        chars, starts = np.unique(rows[order], return_index=True)
        places = dict(zip(chars.tolist(), np.split(order, starts[1:])))
        where = {c: _set_bits(places[c] + (low - above), span + 2 * t) if c in places else 0 for c in set(columns)}
        for k, c in enumerate(columns):
            eq = (where[c] >> k) & full
            d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
            hp = full & (vn | ~(d0 | vp))
            lower = d0 >> 1
            if not d0 >> top:
                score += 1
                if score > limit:
                    return t + 1
            vp, vn = full & ((d0 & vp) | ~(lower | hp)), lower & hp
    below = ((1 << 2 * t) - 1) & ~((1 << (m - n + t)) - 1)
    return score - (vp & below).bit_count() + (vn & below).bit_count()


def _set_bits(places: np.ndarray, n: int) -> int:
    """A whole number of n bits with those at the given places set."""
    bits = np.zeros(n, np.uint8)
    bits[places] = 1
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def within(x: list[str], y: list[str], t: np.ndarray) -> np.ndarray:
    """For each pair whether its edit distance is at most its t."""
    m, n = np.array([len(s) for s in x], np.int64), np.array([len(s) for s in y], np.int64)
    out = np.zeros(len(x), bool)
    possible = np.abs(m - n) <= t
    for i in np.flatnonzero(possible & (t > NARROW)).tolist():
        out[i] = banded_long(x[i], y[i], int(t[i])) <= t[i]
    rows = np.flatnonzero(possible & (t <= NARROW))
    for edits in np.unique(t[rows]).tolist():
        mine = rows[t[rows] == edits]
        mine = mine[np.argsort(n[mine], kind="stable")]
        part = np.cumsum(n[mine] + 2 * edits + 1) // CHARS
        for p in np.unique(part).tolist():
            take = mine[part == p]
            out[take] = banded_bits([x[i] for i in take], [y[i] for i in take], edits) <= edits
    return out
