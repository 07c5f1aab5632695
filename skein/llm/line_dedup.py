"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A line goes if an equal line stands earlier in the corpus (smaller doc_id, or the same document and a
smaller line number), and one of at least MIN_CHARS characters if a near line does.  Lines of white
space only stay.  Two lines are near if their edit
distance is at most THRESHOLD or one for each SHARE characters of the shorter line's band (its lower
end), whichever is more; bands are four from one power of two to the next.

Edits: a line is cut into one block more than its band allows edits, as wide as the band's shortest
line allows, the first ones counted from its start and the last ones from its end.  Of two near lines
some block i has none of the t edits, at most i - 1 edits before and at most t + 1 - i behind it (the
multi-match bounds of partition-based similarity joins), so it is shifted by at most the smaller of
the two.  A block gives segments, shorter by that shift, at its first places and probes further in, a stride
apart; with the block whole, one of the lines has one of the other's segments among its probes.  Their number
still grows faster than t, so bands from LONG on take strings of block - step + 1 characters instead: a block has
those at its first step places, and the line has one at each step-th place, so a block that is whole
holds one of the other line's.  Segments are keyed by band, number and hash; a line that a band's
edits can bring in from above takes the band below as well.  Keys that only one line has fall out
where hashes meet, before any text moves.

A line only needs one earlier near line.  So the earliest line of each key is tried first, then a few
others of those that share a key, and all pairs only for lines that are still without one.  Pairs are
made where lengths and counts of characters, on both sides of two cuts, leave room for the edits (one edit
moves two counts at most), inside the join; the pairs of a key with many lines are dealt over many tasks,
and made once where lines share many such keys.  Pairs are
verified by Spark's banded edit distance, on what lies between their first and last difference.

Defined cases: a null text has no lines and stays null; rows that repeat a doc_id with the same text
have their lines at equal places, so neither removes the other's; a null doc_id comes first; an empty
table gives an empty table; all columns of the input are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bit_table, has_bit, once, packed, written

THRESHOLD, MIN_CHARS = 2, 20
#: Characters of a band's lower end for each edit allowed, and the band from which on strings have no numbers.
SHARE, LONG = 50, 2048
#: Characters that a segment keeps where it stands at several places to save probes.
WIDE = 16
#: Probes of a long line that one row makes.
PIECE = 64
#: Comparisons of one key that one task makes; keys with more are dealt over several.
TOGETHER = 2_000_000
#: Candidates that a line is compared with before all others.
TRIES = 4
#: Pairs of lines from which on a key is a frequent one, and frequent keys that a line carries.
OFTEN, CARRIED = 10_000, 16
#: Characters whose counts are compared before a distance is computed, a rare one or none beside a frequent one; fifteen counts to a long.
_COUNTED = ("ez", "tq", "ax", "oj", "ik", "nv", "sb", "rw", "hp", "dy", "lf", "um", "gc", " ", ".,")
#: A one and a seven in each four bits of a long.
_ONES, _SEVENS = 0x111111111111111, 0x777777777777777
#: Characters of the parts that long lines are compared by, and of what has to be equal where they are cut.
PART, ANCHOR = 128, 24
#: Cells of bands of edit distances that a task fills.
WORK = 30_000_000


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(d, th, pos, line) of the lines that take part; th tells different texts under one doc_id apart."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64("text").alias("th"), F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
    return rows.where((F.length("line") >= min_chars) & (F.trim("line", F.lit(" \t\r")) != ""))


def _band(n: Column, threshold: int) -> Column:
    """The shortest length of the band of length n: four bands from one power of two to the next, but none narrower than threshold + 1."""
    narrowest = 1 << threshold.bit_length()
    octave = F.length(F.bin(n)) - 1
    step = F.greatest(F.lit(narrowest), F.pow(F.lit(2.0), octave - 2).cast("int"))
    return n - n % step


def _edits(band: Column, threshold: int) -> Column:
    """Edits allowed between two lines of which the shorter one is of that band."""
    return F.greatest(F.lit(threshold), F.floor(band / SHARE).cast("int"))


def _keyed(lines: DataFrame, threshold: int) -> DataFrame:
    """(id, key, own) for lines (line): own tells a line's segments from its probes for other lines' segments."""
    n, t, band, block, step, size, i = (F.col(c) for c in ("n", "t", "band", "block", "step", "size", "i"))
    df = lines.select("line", F.xxhash64("line").alias("id"), F.length("line").alias("n"))
    df = df.withColumn("high", once(_band(n, threshold)))
    high = F.col("high")
    below = _band(F.greatest(high - 1, F.lit(1)), threshold)
    reached = (below < high) & (n - _edits(below, threshold) < high)
    # four bytes a character, so that a place in a line is a place in its bytes
    df = df.select("id", "n", F.encode("line", "UTF-32").alias("wide"), F.explode(F.when(reached, F.array(high, below)).otherwise(F.array(high))).alias("band"))
    df = df.withColumn("t", once(_edits(band, threshold))).withColumn("block", once(F.floor(band / (t + 1)).cast("int")))
    df = df.withColumn("step", once(F.when(band >= LONG, F.floor(F.sqrt("block")).cast("int")))).withColumn("size", block - step + 1)
    df = df.withColumn("probes", once(F.coalesce(F.floor((n - size) / step).cast("int") + 1, F.lit(0))))
    df = df.select("*", F.explode(F.sequence(F.lit(1), t + 1 + F.ceil(F.col("probes") / PIECE).cast("int"))).alias("i"))
    before, behind, piece = i - 1, t + 1 - i, i - t - 2
    shift, stride = F.least(before, behind), F.col("stride")
    short = step.isNull()
    # the segment stands at the first `stride` places and at each stride-th one from there to the shift: two of them are as far apart as any shift up to it
    roots = F.array(*(F.lit(max(1, math.isqrt(k))) for k in range(LONG // SHARE)))
    df = df.withColumn("stride", once(F.when(short & (block - shift >= WIDE), F.coalesce(F.get(roots, shift), F.lit(1))).otherwise(1)))
    df = df.withColumn("jumps", once(F.floor((shift + stride - 1) / stride).cast("int")))
    jumps = F.col("jumps")
    begin = F.when(short & (before > behind), n - block * (behind + 1)).when(i <= t + 1, block * before).otherwise(piece * step * PIECE)
    last = F.when(short, stride + jumps - 1).when(i <= t + 1, step - 1).otherwise(F.least(F.col("probes") - piece * PIECE, F.lit(PIECE)) - 1)
    width = F.when(short, F.greatest(block - jumps * stride, F.lit(0))).otherwise(size)
    n_own = F.when(i > t + 1, 0).when(short, stride).otherwise(step)
    cut = df.select("id", "band", "wide", (4 * begin + 1).alias("begin"), (4 * width).alias("width"), F.when(short, 4 * stride).when(i <= t + 1, 4).otherwise(4 * step).alias("stride"),
        F.when(short, i).otherwise(0).alias("number"), n_own.alias("n_own"), short.alias("short"), F.explode(F.sequence(F.lit(0), last)).alias("off"))
    off, stride = F.col("off"), F.col("stride")
    at = F.when(~F.col("short"), off * stride).when(off < F.col("n_own"), 4 * off).otherwise((off - F.col("n_own") + 1) * stride)
    segment = F.substring("wide", F.col("begin") + at, F.col("width"))
    return cut.select("id", F.xxhash64("band", "number", segment).alias("key"), (2 * band + (F.col("off") < F.col("n_own")).cast("int")).alias("mark"))


def _counts(part: Column) -> Column:
    """How often part of a line has the characters of each class of _COUNTED, modulo 8 and four bits to a class."""
    classes = {ord(char): k for k, chars in enumerate(_COUNTED) for char in chars}
    ones = F.array(*(F.lit(1 << 4 * classes[c] if c in classes else 0).cast("long") for c in range(128)))
    one = lambda char: F.get(ones, F.ascii(char).bitwiseAND(F.lit(127)))
    return once(F.aggregate(F.split(part, ""), F.lit(0).cast("long"), lambda sums, char: (sums + one(char)).bitwiseAND(F.lit(_SEVENS))))


def _ringed(counts: Column) -> Column:
    """counts of four bits, modulo 8, as strings of four bits of which two differ in as many bits as the counts are apart, going round."""
    counts = counts.bitwiseAND(F.lit(_SEVENS))
    bit = lambda k: F.shiftrightunsigned(counts, k).bitwiseAND(F.lit(_ONES))
    four, two, one = bit(2), bit(1), bit(0)
    # from 4 to 7, from 3 to 6, from 2 to 5 and from 1 to 4
    above = (four, four.bitwiseXOR(two.bitwiseAND(one)), four.bitwiseXOR(two), four.bitwiseXOR(two.bitwiseOR(one)))
    return sum((F.shiftleft(part, 3 - k) for k, part in enumerate(above[1:], 1)), F.shiftleft(above[0], 3))


def _windows(lines: DataFrame) -> DataFrame:
    """lines (line, n, band, ...) without line, with the counts of a quarter and of three quarters of the band from both ends."""
    quarter = F.floor(F.col("band") / 4).cast("int")
    parts = {
        "p1": F.left("line", quarter),
        "p2": F.substring("line", quarter + 1, 2 * quarter),
        "p3": F.substring("line", F.col("n") - 3 * quarter + 1, 2 * quarter),
        "p4": F.right("line", quarter),
    }
    counted = lines.withColumns({name: _counts(part) for name, part in parts.items()})
    kept = [c for c in lines.columns if c != "line"]
    sums = {"front1": F.col("p1"), "front3": F.col("p1") + F.col("p2"), "back1": F.col("p4"), "back3": F.col("p4") + F.col("p3")}
    return counted.select(*kept, *(_ringed(c).alias(name) for name, c in sums.items()))


_COLS = ("n", "most", "front1", "front3", "back1", "back3")


def _may(a: str, b: str) -> Column:
    """Whether lengths and counts of two lines of one band leave room for the edits allowed.

    A quarter of the band is counted from the start of both lines and three quarters from their end, and
    the other way round; each time no more together than the band's shortest line has.  An edit lies in
    one of the two parts, if in any, and moves two counts there at most: one for what it takes or adds and
    one for what it shifts over the part's edge.  What two changes far apart take and add can make up for
    each other in counts of a whole line; a cut between them tells them apart.
    """
    t = F.least(F.col(f"{a}.most"), F.col(f"{b}.most"))
    apart = lambda c: F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")))
    return (F.abs(F.col(f"{a}.n") - F.col(f"{b}.n")) <= t) & (apart("front1") + apart("back3") <= 2 * t) & (apart("front3") + apart("back1") <= 2 * t)


def _sharing(lines: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The keys that several lines share (key, id, band, own), their lines (id, line, n, most), and their counts (id, band, ...)."""
    group = W.partitionBy("key")
    several = _keyed(lines, threshold).withColumn("low", F.min("id").over(group)).withColumn("high", F.max("id").over(group)).where("low != high")
    several = several.groupBy("key", "id").agg(F.max("mark").alias("mark"))
    near = written(several.select("key", "id", F.floor(F.col("mark") / 2).cast("int").alias("band"), (F.col("mark") % 2 == 1).alias("own")), "near-keys")
    ids = written(near.groupBy("id").agg(F.collect_set("band").alias("bands")), "near-ids")
    texts = has_bit(lines.select(F.xxhash64("line").alias("id"), "line"), "id", bit_table(ids, "id")).where("maybe")
    texts = texts.groupBy("id", "line").agg(F.lit(1).alias("one")).join(ids, "id")
    n = F.length("line")
    texts = texts.select("id", "line", n.alias("n"), _edits(_band(n, threshold), threshold).alias("most"), "bands")
    texts = written(texts, "near-texts")
    parts = texts.select("id", "n", "most", F.explode("bands").alias("band"), "line")
    return near, texts.drop("bands"), _windows(parts)


def _shared(x: Column, y: Column, part) -> Column:  # noqa: ANN001
    """How many bytes x and y share, found in steps from a power of two down to one; part(c, p, s): s bytes of c after the first p that are shared."""
    both = F.least(F.octet_length(x), F.octet_length(y))
    size = F.least(F.length(F.bin(both)), F.lit(21))
    steps = F.slice(F.array(*(F.lit(1 << k) for k in range(20, -1, -1))), 22 - size, size)
    return F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= both) & (part(x, p, s) == part(y, p, s)), p + s).otherwise(p))


def _inside(c: Column, place: Column) -> Column:
    """Whether the byte at place (from 0) of UTF-8 bytes continues a character."""
    return F.substring(c, place + 1, F.lit(1)).between(F.lit(b"\x80"), F.lit(b"\xbf"))


def _trimmed(pairs: DataFrame) -> DataFrame:
    """pairs with x and y from their first to their last difference, which leaves their distance as it is; cuts lie between characters."""
    x, y = F.col("_x"), F.col("_y")
    pairs = pairs.withColumns({"_x": F.col("x").cast("binary"), "_y": F.col("y").cast("binary")})
    pairs = pairs.withColumn("_p", once(_shared(x, y, lambda c, p, s: F.substring(c, p + 1, s))))
    p = F.col("_p")
    begin = F.when(~(_inside(x, p) | _inside(y, p)), p)
    for back in (1, 2):
        begin = begin.when(~_inside(x, p - back), p - back)
    pairs = pairs.withColumn("_p", once(begin.otherwise(p - 3)))
    pairs = pairs.withColumns({c: once(F.substring(c, p + 1, F.octet_length(c))) for c in ("_x", "_y")})
    pairs = pairs.withColumn("_p", once(_shared(x, y, lambda c, p, s: F.substring(c, F.octet_length(c) - p - s + 1, s))))
    end = F.octet_length(x) - p
    kept = F.when((p == 0) | ~_inside(x, end), p)
    for back in (1, 2):
        kept = kept.when(~_inside(x, end + back), p - back)
    pairs = pairs.withColumn("_p", once(kept.otherwise(p - 3)))
    pairs = pairs.withColumns({n: once(F.substring(c, F.lit(1), F.octet_length(c) - p).cast("string")) for n, c in (("x", x), ("y", y))})
    return pairs.drop("_x", "_y", "_p")


def _near(x: Column, y: Column, t: Column) -> Column:
    """Whether the distance of x and y is at most t.

    `levenshtein` goes through the whole shorter text for each character of the longer one, though it computes
    a band only.  So long texts are cut first, at each PART characters of x, where y has the next ANCHOR
    characters nearly at the same place.  The sum of the parts' distances is no less than the whole distance, so up
    to t it proves the pair near; else the whole texts decide.
    """
    far = 1 << 30  # what a distance over its threshold (-1) counts as
    distance = lambda a, b, most: F.pmod(F.call_function("levenshtein", a, b, most), F.lit(far))
    n = F.length(x)

    def cut(state: Column, place: Column) -> Column:
        i, j, total = (state.getField(c) for c in ("i", "j", "total"))
        straight, anchor = j + place - i, F.substring(x, place + 1, F.lit(ANCHOR))
        # lines repeat themselves, so what is nearest to the place without a shift comes first
        low, reach = F.greatest(j, straight - ANCHOR), 3 * ANCHOR
        at = F.when(F.substring(y, straight + 1, F.lit(ANCHOR)) == anchor, straight - low + 1).otherwise(F.instr(F.substring(y, low + 1, F.lit(reach)), anchor))
        more = lambda at: distance(F.substring(x, i + 1, place - i), F.substring(y, j + 1, low + at - 1 - j), t - total)
        new = lambda at: F.when(at > 0, F.struct(place.alias("i"), (low + at - 1).alias("j"), (total + more(at)).alias("total"))).otherwise(state)
        return F.when(total > t, state).otherwise(F.get(F.transform(F.array(at), new), F.lit(0)))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("total"))
    rest = lambda state, c, k: F.substring(c, state.getField(k) + 1, F.length(c))
    done = lambda state: F.when(state.getField("total") <= t, state.getField("total") + distance(rest(state, x, "i"), rest(state, y, "j"), t - state.getField("total")) <= t).otherwise(False)
    proven = F.aggregate(F.sequence(F.lit(PART), n - ANCHOR, F.lit(PART)), start, cut, done)
    return F.when((F.least(n, F.length(y)) >= LONG) & proven, True).otherwise(F.call_function("levenshtein", x, y, t) >= 0)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of line hashes that are near; pairs is a written table."""
    side = lambda i, s: texts.select(F.col("id").alias(i), F.col("line").alias(s), F.col("most").alias(f"{s}_most"))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    # a pair is little to read and much to compute, so the number of tasks follows the work, and the longest pairs lie apart
    one = pairs.join(texts.select(F.col("id").alias("a"), "n", "most"), "a")
    work = one.agg(F.coalesce(F.sum(F.col("n") * (1.0 + 2 * F.col("most"))), F.lit(0.0))).first()[0]
    dealt = both.select("a", "b", "x", "y", F.least("x_most", "y_most").alias("t")).repartition(1 + int(work) // WORK, "a", "b")
    # once, so that it is not moved before the pairs are dealt
    return _trimmed(dealt).where(once(_near(F.col("x"), F.col("y"), F.col("t")))).select("a", "b")


def _meeting(left: DataFrame, right: DataFrame, fits: Column) -> DataFrame:
    """(a, b) for rows l of left and r of right with one key, l or r an own one of its, and fits.

    Lines that share one frequent key mostly share many.  So each carries the least of its own and probed
    ones, and a pair is made at the least key that both carry, or at each one if they carry none in common.
    Keys with many pairs are dealt over several tasks.
    """
    work = left.groupBy("key").agg(F.count("*").alias("nl")).join(right.groupBy("key").agg(F.count("*").alias("nr")), "key").withColumn("work", F.col("nl") * F.col("nr"))
    hot = written(work.where(F.col("work") > OFTEN).select("key", F.ceil(F.sqrt(F.col("work") / TOGETHER)).cast("int").alias("parts")), "hot-keys")
    found = lambda l, r, on, fits: l.alias("l").join(r.alias("r"), [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on] + [fits]).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))  # noqa: E731,E741
    own = F.col("l.own") | F.col("r.own")
    if hot.isEmpty():
        return found(left, right, ["key"], own & fits).distinct()
    theirs = right.join(hot, "key").groupBy("id").agg(F.slice(F.sort_array(F.collect_set("key")), 1, CARRIED).alias("often"))
    theirs = written(theirs, "often-keys")
    part, every = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = left.join(hot, "key").join(theirs, "id").select("*", part.alias("pl"), every.alias("pr"))
    columns = right.join(hot, "key").join(theirs, "id").select("*", part.alias("pr"), every.alias("pl"))
    first = F.coalesce(F.array_min(F.array_intersect("l.often", "r.often")) == F.col("l.key"), own)
    cold = found(left.join(hot, "key", "left_anti"), right.join(hot, "key", "left_anti"), ["key"], own & fits)
    return cold.union(found(rows, columns, ["key", "pl", "pr"], fits & first)).distinct()


def edit_links(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """(a, b): hashes of different lines that are near, each pair both ways."""
    near, texts, counts = _sharing(_lines(docs, min_chars).select("line"), threshold)
    rows = written(near.join(counts, ["id", "band"]), "near-lines")
    fits = (F.col("l.id") < F.col("r.id")) & _may("l", "r")
    links = written(_verified(written(_meeting(rows, rows, fits), "line-pairs"), texts), "line-links")
    return links.union(links.select("b", "a"))


def late_lines(docs: DataFrame, firsts: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id): hashes of lines that have a near line with an earlier first place, for firsts (id, first) with one place or more of a hash."""
    near, texts, counts = _sharing(_lines(docs, min_chars).select("line"), threshold)
    begin = firsts.join(texts.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("first").alias("first"))
    rows = written(near.join(counts.join(begin, "id"), ["id", "band"]), "near-lines")
    earlier = F.col("r.first") < F.col("l.first")
    leader = rows.where("own").groupBy("key").agg(F.min(F.struct("first", "id", *_COLS)).alias("lead")).select("key", "lead.*")
    led = rows.alias("l").join(leader.alias("r"), [F.col("l.key") == F.col("r.key"), earlier, _may("l", "r")])
    tried = written(led.select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct(), "line-pairs")
    late = written(_verified(tried, texts).select(F.col("a").alias("id")).distinct(), "late-lines")
    left = rows.join(late, "id", "left_anti")
    pairs = _meeting(left, rows, earlier & _may("l", "r"))
    pairs = written(pairs.join(tried, ["a", "b"], "left_anti"), "line-pairs")
    some = F.array(*(F.min_by("b", F.xxhash64("b", F.lit(k))) for k in range(TRIES)))
    some = written(pairs.groupBy("a").agg(some.alias("b")).select("a", F.explode(F.array_distinct("b")).alias("b")), "line-pairs")
    more = written(_verified(some, texts).select(F.col("a").alias("id")).distinct(), "late-lines")
    rest = written(pairs.join(more, F.col("a") == F.col("id"), "left_anti").join(some, ["a", "b"], "left_anti"), "line-pairs")
    last = _verified(rest, texts).select(F.col("a").alias("id")).distinct()
    return late.union(more).union(last)


def repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """(d, th, gone array<int>): for each document the places, from 0, of the lines to remove."""
    place = F.col("d").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pos").cast("decimal(10,0)")
    places = _lines(docs, 1).select("d", "th", "pos", F.xxhash64("line").alias("id"), F.xxhash64("line", F.lit(1)).alias("check"))
    places = written(places, "line-places").withColumn("place", place)
    # of lines that share a 64-bit hash the check tells which is which; links need the earliest of a hash only
    firsts = written(places.groupBy("id", "check").agg(F.min("place").alias("first"), F.count("*").alias("n")), "first-lines")
    late = written(late_lines(docs, firsts.select("id", "first"), threshold, min_chars), "late-lines").withColumn("late", F.lit(True))
    suspects = written(firsts.join(late, "id", "left").where("late or n > 1").select("id", "check", "first", "late"), "suspects")
    gone = has_bit(places, "id", bit_table(suspects, "id")).where("maybe").join(suspects, ["id", "check"]).where(F.col("late") | (F.col("place") > F.col("first")))
    return gone.groupBy("d", "th").agg(F.collect_set("pos").alias("gone"))


def counted(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows (_row, kept, n_lines, n_removed): the rows of docs, their texts without repeated lines, and counts."""
    gone = written(repeated_lines(docs, threshold, min_chars), "gone-lines")
    keyed = packed(docs, text=F.col("text"), d=F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), th=F.xxhash64("text"))
    marked = has_bit(keyed, "d", bit_table(gone, "d"))
    hit = marked.where("maybe").join(gone, ["d", "th"], "left").withColumn("lines", once(F.split("text", "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    hit = hit.withColumn("stay", F.when(F.col("gone").isNotNull(), stay))
    kept = F.array_join(F.transform("stay", lambda i: F.get(F.col("lines"), i)), "\n")
    n = F.size("lines").cast("long")
    hit = hit.select("_row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept"), n.alias("n_lines"), F.coalesce(n - F.size("stay"), F.lit(0)).cast("long").alias("n_removed"))
    n_lines = F.coalesce(F.size(F.split("text", "\n")).cast("long"), F.lit(0))
    rest = marked.where("not maybe").select("_row", F.col("text").alias("kept"), n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    return hit.unionByName(rest)


def without_repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with shorter texts (and n_chars to fit); rows of whose text only white space is left go."""
    df = counted(docs, threshold, min_chars).where("n_removed = 0 or trim(BOTH ' \t\n\r' FROM kept) != ''")
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    old = {c: F.col("_row").getField(c) for c in docs.columns}
    if "n_chars" in old:
        new["n_chars"] = F.when(F.col("n_removed") > 0, new["n_chars"]).otherwise(old["n_chars"])
    return df.select(*((new[c] if c in new else old[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
