"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Tokens are summed by cell (source, language, topic).  The cells' weights are raked: scaled in turn so
that each marginal meets its target, until all do.  A document is kept with probability
keep * weight / tokens of its cell, by a hash of its doc_id, so that the same documents are kept each
time.

No cell can give more than all of its tokens, so a weight is at most tokens / keep.  Raking respects
that: a marginal's factor is the one with which the sum of its cells' weights, each cut at its most, is
the target.  A value whose target is above all it has gives all, and the others of its marginal share
what is missing in proportion to their targets (:func:`within`); then keep of all tokens is kept and the
marginals are these feasible targets.

By default the targets are the marginals' own shares to the power TEMPER, which lowers the share of a
source that holds a third of all rows.  They are aims: where marginals contradict each other (a source
in one language only), raking stops when it gets no closer, and :func:`marginals` shows what is off.
Targets that a caller gives are met, or a ValueError says by how much they are not.

Only cells, not rows, are shuffled for the fit, and up to FOLDED of them are raked in one job; the join of rows with cells is left to Spark, which
broadcasts the cells only below its own size threshold.

Defined cases: null sources and languages are values of their own; a null or empty text has no
tokens, and a cell without tokens is kept at the rate; a value without a target, or with none above
zero, is not kept; repeated rows and repeated doc_ids share their fate; an empty table gives an empty
table; all columns of the input are kept, and columns with the names of helpers are safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import packed, words, written

#: Sweeps over the marginals until a fit has failed, how far off a share may be, and what is no longer getting closer.
TEMPER, KEEP, ROUNDS, TOLERANCE, SLOW = 0.7, 0.8, 200, 1e-4, 0.98
#: Sweeps between two written tables, and cells up to which one task rakes them, so that sweeps need no shuffles; the weights are the same.
SWEEPS, TOGETHER = 2, 100_000
#: Cells up to which all sweeps are one fold over arrays, in one job; beyond, each round of sweeps is a job with windows.
FOLDED = 1_000
DIMS = ("source", "lang", "topic")


def text_form(text: Column) -> Column:
    """A topic for tables without one: the form of the text."""
    n = F.length(F.coalesce(text, F.lit("")))
    lines = F.length(F.coalesce(text, F.lit(""))) - F.length(F.translate(F.coalesce(text, F.lit("")), "\n", ""))
    return F.when(n < 500, "note").when(lines * 200 > n, "list").when(n < 4000, "article").otherwise("book")


def tempered(cells: DataFrame, temper: float) -> dict[str, DataFrame]:
    """For each dimension (value, target): shares to the power temper, scaled to sum up to one."""
    out = {}
    for d in DIMS:
        shares = cells.groupBy(d).agg(F.pow(F.sum("tokens"), F.lit(temper)).alias("target"))
        # one row a value
        out[d] = shares.withColumn("target", F.try_divide("target", F.sum("target").over(W.partitionBy())))
    return out


def _filled(table: str, columns: list[str], by: str | None, goal: str) -> str:
    """SQL for the rows of a table (u, most) with u scaled, the same for all rows of ``by``, so that the sum of least(u, most) is the goal; where that is above all most together, so that u reaches most everywhere.

    With rows in the order of most / u, those before some row are full and the rest is not.  Each place
    gives the factor that the rest would need; it is the right one at the first place that it leaves not
    full, and too small behind it.
    """
    whole = f"(partition by {by})" if by else "()"
    before = f"({'partition by ' + by if by else ''} order by _r rows between unbounded preceding and 1 preceding)"
    placed = f"select *, case when u > 0 then most / u end as _r from {table}"
    left = f"({goal}) - coalesce(sum(case when u > 0 then most end) over {before}, 0D)"
    open_ = f"sum(u) over {whole} - coalesce(sum(u) over {before}, 0D)"
    needed = f"select *, {left} as _left, {open_} as _open from ({placed})"
    factors = f"select *, case when u > 0 and _open > 0 then _left / _open end as _f from ({needed})"
    factor = f"coalesce(max(case when _f <= _r then greatest(_f, 0D) end) over {whole}, max(_r) over {whole}, 0D)"
    return f"select {', '.join(columns)}, u * {factor} as u from ({factors})"


def within(cells: DataFrame, targets: dict[str, DataFrame], keep: float) -> dict[str, DataFrame]:
    """The targets (value, target) cut at what each value has, for a sample of keep of all tokens, and the others raised in proportion."""
    total = cells.agg(F.sum("tokens")).first()[0] or 1.0
    out = {}
    for d in DIMS:
        own = cells.groupBy(d).agg(F.sum("tokens").alias("_n"))
        df = targets[d].alias("t").join(own.alias("o"), F.col(f"t.{d}").eqNullSafe(F.col(f"o.{d}"))).select(f"t.{d}", F.col("target").alias("u"), (F.col("_n") / F.lit(keep * total)).alias("most"))
        out[d] = df.sparkSession.sql(_filled("{df}", [d, "most"], None, "1D"), df=df).select(d, F.least("u", "most").alias("target"))
    return out


def _folded(df: DataFrame, total: float, rounds: int, tolerance: float) -> DataFrame:
    """One row (c, w, most, gaps): the cells of df with their u when raking stops, for a few cells; the same sweeps and stop as in :func:`rake`.

    ``place`` has for each dimension the number of each cell's value, ``goal`` the values' targets.
    """
    keys = {d: F.to_json(F.struct(d)) for d in DIMS}  # null is a value of its own
    one = df.agg(F.sort_array(F.collect_list(F.struct(*(k.alias(f"key_{d}") for d, k in keys.items()), F.struct(*DIMS, "tokens").alias("c"), "u", "most", *(f"to_{d}" for d in DIMS)))).alias("x"))
    one = one.select("x", *(F.array_distinct(F.col(f"x.key_{d}")).alias(f"keys_{d}") for d in DIMS))
    place = F.array(*(F.expr(f"transform(x, e -> cast(array_position(keys_{d}, e.key_{d}) as int) - 1)") for d in DIMS))
    goal = F.array(*(F.expr(f"transform(keys_{d}, k -> filter(x, e -> e.key_{d} = k)[0].to_{d})") for d in DIMS))
    one = written(one.select(F.col("x.c").alias("c"), F.col("x.u").alias("u"), F.col("x.most").alias("most"), place.alias("place"), goal.alias("goal")), "cells")
    own = "filter(transform(w, (v, i) -> i), i -> place[d][i] = j)"
    # see _filled: the factor with which the cells of one value, each cut at its most, sum up to the goal
    factor = f"""transform(array(filter({own}, i -> w[i] > 0)), mine -> aggregate(
        array_sort(transform(mine, i -> named_struct('r', most[i] / w[i], 'u', w[i], 'm', most[i]))),
        named_struct('full', 0D, 'before', 0D, 'whole', aggregate(mine, 0D, (a, i) -> a + w[i]), 'f', cast(null as double), 'top', cast(null as double)),
        (a, e) -> named_struct('full', a.full + e.m, 'before', a.before + e.u, 'whole', a.whole,
            'f', if(a.whole - a.before > 0 and (g * {total!r}D - a.full) / (a.whole - a.before) <= e.r, greatest(a.f, (g * {total!r}D - a.full) / (a.whole - a.before), 0D), a.f), 'top', e.r),
        a -> coalesce(a.f, a.top, 0D)))[0]"""
    sweep = f"aggregate(array(transform(goal[d], (g, j) -> {factor})), w, (w0, fs) -> transform(w0, (v, i) -> v * fs[place[d][i]]))"
    sweeps = f"aggregate(sequence(0, {len(DIMS) * SWEEPS - 1}), s.w, (w, k) -> transform(array(k % {len(DIMS)}), d -> {sweep})[0])"
    gaps = f"transform(array(0, 1, 2), d -> coalesce(array_max(transform(goal[d], (g, j) -> abs(aggregate({own}, 0D, (a, i) -> a + least(w[i], most[i])) / {total or 1.0!r}D - g))), 0D))"
    ended = f"named_struct('w', n.w, 'gaps', n.gaps, 'off', array_max(n.gaps), 'stop', array_max(n.gaps) <= {tolerance!r}D or array_max(n.gaps) > {SLOW!r}D * s.off)"
    step = f"transform(transform(array({sweeps}), w -> named_struct('w', w, 'gaps', {gaps})), n -> {ended})[0]"
    start = "named_struct('w', u, 'gaps', array(0D, 0D, 0D), 'off', double('Infinity'), 'stop', false)"
    done = one.select("c", "most", F.expr(f"aggregate(sequence(1, {-(-rounds // SWEEPS)}), {start}, (s, r) -> if(s.stop, s, {step}))").alias("s"))
    return written(done.select("c", "most", "s.w", "s.gaps"), "cells")


def rake(cells: DataFrame, targets: dict[str, DataFrame], keep: float = 0.0, strict: bool = True, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (source, lang, topic, tokens) with weight: same total as tokens, marginals as in targets, at most tokens / keep each.

    If that can't be done, a ValueError if strict, else weights that come near it.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    df = cells
    for d in DIMS:
        t = targets[d].select(F.col(d).alias("_v"), F.col("target").alias(f"to_{d}"))
        df = df.join(t, F.col(d).eqNullSafe(F.col("_v")), "left").drop("_v").fillna(0.0, [f"to_{d}"])
    live = (F.col("tokens") > 0) & (F.least(*(f"to_{d}" for d in DIMS)) > 0)
    df = df.withColumns({"u": F.when(live, F.col("tokens")).otherwise(0.0), "most": F.col("tokens") / keep if keep else F.lit(total)})
    n, kept = df.count(), [c for c in df.columns if c != "u"]
    few, weight, off = n <= TOGETHER, F.least("u", "most"), float("inf")
    if n <= FOLDED and rounds > 0:
        one = _folded(df, total, rounds, tolerance)
        gaps = one.select("gaps").first()[0]
        off, rounds = max(gaps), 0
        df = one.select(F.inline(F.arrays_zip("c", "w", "most"))).select("c.*", F.col("w").alias("u"), "most")
    for _ in range(0, rounds, SWEEPS):
        # all sweeps of a round in one text, which is analysed once
        text = "{df}"
        for d in DIMS * SWEEPS:
            text = _filled(text if text == "{df}" else f"({text})", kept, d, f"to_{d} * {total!r}D")
        df = written(cells.sparkSession.sql(text, df=df.coalesce(1) if few else df), "cells")
        apart = [F.abs(F.sum(weight).over(W.partitionBy(d)) / F.lit(total or 1.0) - F.col(f"to_{d}")) for d in DIMS]
        gaps = [g or 0.0 for g in (df.coalesce(1) if few else df).select(*(a.alias(d) for a, d in zip(apart, DIMS))).agg(*(F.max(d) for d in DIMS)).first()]
        last, off = off, max(gaps)
        if off <= tolerance or off > SLOW * last:
            break
    if strict and off > tolerance:
        raise ValueError("targets can't be met: " + ", ".join(f"{d} is off by {g:.4f}" for d, g in zip(DIMS, gaps)))
    return df.select(*DIMS, "tokens", weight.alias("weight"))


def decided(docs: DataFrame, topic: Column | None = None, temper: float = TEMPER, keep: float = KEEP, seed: int = 17, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """Rows (_row, source, lang, topic, tokens, weight, probability, kept); weight is the cell's ratio of weight to tokens."""
    topic = text_form(F.col("text")) if topic is None else topic
    rows = packed(docs, doc_id=F.col("doc_id"), source=F.col("source"), lang=F.col("lang"), topic=topic, tokens=F.size(words(F.col("text"))).cast("double"))
    cells = written(rows.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")), "cells")
    raked = rake(cells, within(cells, tempered(cells, temper) if targets is None else targets, keep), keep, targets is not None)
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(1.0))
    cell = raked.select(*(F.col(d).alias(f"c_{d}") for d in DIMS), F.round(ratio, 6).alias("weight"))
    same = [F.col(d).eqNullSafe(F.col(f"c_{d}")) for d in DIMS]
    df = rows.join(cell, same[0] & same[1] & same[2], "left")
    probability = F.least(F.lit(1.0), F.col("weight") * keep)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return df.select("_row", *DIMS, "tokens", "weight", probability.alias("probability"), (draw < probability).alias("kept"))


def marginals(done: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """(dimension, value, target, expected) of rows of decided(): the share of tokens that is expected in the sample beside the target."""
    chance = F.col("tokens") * F.col("probability")
    total = done.agg(F.sum(chance)).first()[0] or 1.0
    out = None
    for d in DIMS:
        got = done.groupBy(d).agg((F.sum(chance) / F.lit(total)).alias("expected")).alias("g")
        one = targets[d].alias("t").join(got, F.col(f"t.{d}").eqNullSafe(F.col(f"g.{d}")), "left")
        one = one.select(F.lit(d).alias("dimension"), F.col(f"t.{d}").cast("string").alias("value"), "target", F.coalesce("expected", F.lit(0.0)).alias("expected"))
        out = one if out is None else out.unionByName(one)
    return out


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept, with docs' columns."""
    return decided(docs, **options).where("kept").select("_row.*")
