"""Bounded greedy chunking of texts, in array functions.

Packing is a fold over the pieces' lengths that gives the places to cut at; each chunk is then joined once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, strip


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is made once a row, however often body reads it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def cuts(lengths: Column, sep: int, cap: int) -> Column:
    """array<struct<begin, n>> from the lengths of pieces: runs that, joined by sep characters, have at most cap characters, or one piece.

    A run starts anew behind empty pieces at its front, which count for nothing.
    """
    none = F.array().cast("array<struct<begin:int,n:int>>")
    start = F.struct(none.alias("out"), F.lit(1).alias("begin"), F.lit(0).alias("n"), F.lit(0).alias("size"))

    def step(s, x):
        joined = s["size"] + sep + x
        empty, full = s["size"] == 0, (s["size"] > 0) & (joined > cap)
        return F.struct(
            F.when(full, F.concat(s["out"], F.array(F.struct(s["begin"].alias("begin"), s["n"].alias("n"))))).otherwise(s["out"]).alias("out"),
            F.when(full | empty, s["begin"] + s["n"]).otherwise(s["begin"]).alias("begin"),
            F.when(full | empty, F.lit(1)).otherwise(s["n"] + 1).alias("n"),
            F.when(full | empty, x).otherwise(joined).alias("size"),
        )

    return F.aggregate(lengths, start, step, lambda s: F.when(s["n"] > 0, F.concat(s["out"], F.array(F.struct(s["begin"].alias("begin"), s["n"].alias("n"))))).otherwise(s["out"]))


def pack(parts: Column, sep: str, cap: int) -> Column:
    """Joins neighbours with sep as long as the result has at most cap characters; the results are stripped, empty ones dropped."""
    joined = lambda p: F.transform(cuts(F.transform(p, F.length), len(sep), cap), lambda c: strip(F.array_join(F.slice(p, c["begin"], c["n"]), sep)))
    return let(parts, lambda p: F.filter(joined(p), lambda x: x != ""))


def paragraph_chunks(paragraph: Column, cap: int) -> Column:
    """A paragraph as it is, or its sentences packed; what is still too long is cut at cap."""

    def pieces(p: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.length(p) - 1) / cap).cast("int"))
        return F.when(F.length(p) <= cap, F.array(p)).otherwise(F.transform(places, lambda k: strip(F.substring(p, k * cap + 1, F.lit(cap)))))

    cut = F.flatten(F.transform(pack(F.split(paragraph, rf"(?<=[.!?]){WS}+"), " ", cap), pieces))
    return F.when(F.length(paragraph) <= cap, F.array(paragraph)).otherwise(F.filter(cut, lambda x: x != ""))


def section_chunks(section: Column, cap: int) -> Column:
    paragraphs = F.split(strip(section), rf"\n{WS}*\n")
    return pack(F.flatten(F.transform(F.transform(paragraphs, strip), lambda p: paragraph_chunks(p, cap))), "\n\n", cap)


def sections(text: Column, repeat: bool = False) -> Column:
    """The text before the first heading and each heading with what follows it.

    repeat gives every section but the last twice, as the engine that this format comes from does.
    """
    parts = F.split(F.regexp_replace(text, rf"(?md)^(#{{1,6}}{WS}+.*)$", "\x01$1"), "\x01")
    parts = F.filter(F.transform(parts, strip), lambda x: x != "")
    if not repeat:
        return parts
    headed = lambda p: F.filter(p, lambda x: x.rlike(rf"\A#{{1,6}}{WS}"))
    return let(parts, lambda p: F.concat(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), headed(p)))


def source_chunks(content: Column, target: int = 4000, cap: int = 6000, repeat: bool = False) -> Column:
    """Chunks of a source: whole if at most cap characters, else by headings, paragraphs, sentences."""

    def long(text: Column) -> Column:
        headed = F.flatten(F.transform(sections(text, repeat), lambda s: F.when(F.length(s) > cap, section_chunks(s, cap)).otherwise(F.array(s))))
        return pack(F.when(text.contains("#") & text.rlike(rf"(?md)^#{{1,6}}{WS}+.*$"), headed).otherwise(section_chunks(text, cap)), "\n\n", target)

    return let(strip(content), lambda text: F.when(F.length(text) <= cap, F.array(text)).otherwise(long(text)))
