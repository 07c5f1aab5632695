"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a boolean column over features of one text.  On a bounded sample of rows the cascade
estimates what a rule costs and how many rows it rejects, and then asks the rules in the order of
rejections per cost; a row that one rule rejects is not looked at by the next.  The order never
changes the verdict, only the time.

Defined cases: a null text has no words (rejected as short); an empty table gives an empty table;
repeated rows and repeated doc_ids are judged row by row; other columns are kept, and a column of
the input with the name of a result column is replaced.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once, packed, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: At most so many rows of the input are read to estimate the rules' costs and rejections.
SAMPLE_ROWS = 200


@dataclass(frozen=True)
class Rule:
    """rejects: SQL over the columns of needs, which are names of features."""

    name: str
    rejects: str
    needs: tuple[str, ...]


BASE_RULES = (
    Rule("short", "n_words < 10", ("n_words",)),
    Rule("repeats", "100 * n_repeat_words > 20 * n_words", ("n_words", "n_repeat_words")),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", "100 * n_symbols > 5 * word_chars", ("n_symbols", "word_chars")),
    Rule("shouting", "100 * n_upper > 50 * word_chars", ("n_upper", "word_chars")),
    Rule("dup_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines", ("n_lines", "n_dup_lines")),
)


def _steps() -> dict[str, list[tuple[str, Column]]]:
    """For each feature the columns that it is made of, in order; _text is the text without null."""
    text = F.col("_text")
    long = lambda c: c.cast("long")
    at = lambda a, i: F.get(F.col(a), i)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    grams = F.transform(
        F.when(F.size("_hashes") >= WINDOW, F.slice("_hashes", F.lit(1), F.size("_hashes") - (WINDOW - 1))).otherwise(F.array().cast("array<bigint>")),
        lambda x, i: F.xxhash64(x, *(at("_hashes", i + k) for k in range(1, WINDOW))),
    )
    placed = F.when(
        F.size("_grams") > F.size(F.array_distinct("_grams")),
        F.array_sort(F.transform("_grams", lambda x, i: F.struct(x.alias("h"), i.alias("p")))),
    )
    twice = F.filter(
        "_placed", lambda e, j: (e["h"] == F.coalesce(at("_placed", j - 1)["h"], F.bitwise_not(e["h"]))) | (e["h"] == F.coalesce(at("_placed", j + 1)["h"], F.bitwise_not(e["h"])))
    )
    covered = F.aggregate(
        F.array_sort(F.transform("_twice", lambda e: e["p"])),
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"), p.alias("last")),
        lambda s: s["n"],
    )
    return {
        "n_words": [("_words", words(text)), ("n_words", long(F.size("_words")))],
        "word_chars": [("word_chars", long(F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))))],
        "n_symbols": [("n_symbols", long(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))))],
        "n_upper": [("n_upper", long(F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))))],
        "n_lines": [("_lines", lines), ("n_lines", long(F.size("_lines")))],
        "n_dup_lines": [("_lines", lines), ("n_dup_lines", long(F.size("_lines") - F.size(F.array_distinct("_lines"))))],
        "n_repeat_words": [
            ("_words", words(text)),
            ("_hashes", F.transform("_words", lambda w: F.xxhash64(w))),
            ("_grams", grams),
            ("_placed", placed),
            ("_twice", F.when(F.col("_placed").isNotNull(), twice)),
            ("n_repeat_words", long(F.when(F.col("_twice").isNull(), 0).otherwise(covered))),
        ],
    }


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")


def _with(df: DataFrame, features, made: set[str], guard: Column | None = None) -> DataFrame:
    """Adds the features that df hasn't yet; under a guard, rows that fail it get null instead."""
    steps = _steps()
    for f in features:
        for name, expr in steps[f]:
            if name not in made:
                made.add(name)
                df = df.withColumn(name, once(expr if guard is None else F.when(guard, expr)))
    return df


def _texts(df: DataFrame, text: str) -> DataFrame:
    return packed(df, _text=F.coalesce(F.col(text).cast("string"), F.lit("")))


def order_by_sample(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejected rows per second, largest first, as measured on at most sample_rows rows."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text).cast("string").alias("text")).limit(sample_rows).collect()
    if not rows:
        return list(rules)
    sample = spark.createDataFrame(rows, "text string").coalesce(1)
    def seconds(df: DataFrame) -> float:
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    # a run first to compile, and what a job takes by itself is no cost of a rule
    plain = _texts(sample, "text")
    seconds(plain)
    empty, rated = seconds(plain), []
    for rule in rules:
        asked = _with(plain, rule.needs, set()).select(F.expr(rule.rejects).alias("no"))
        rejected = asked.where("no").count()
        cost = max(seconds(asked) - empty, 1e-3)
        rated.append(((rejected + 0.5) / cost, rule))
    return [rule for _, rule in sorted(rated, key=lambda x: -x[0])]


def _cascade(docs: DataFrame, rules, text: str, report: tuple[str, ...]) -> DataFrame:
    rules = order_by_sample(docs, text=text) if rules is None else list(rules)
    made: set[str] = set()
    df = _with(_texts(docs, text), report, made).withColumn("rejected_by", F.lit(None).cast("string"))
    for rule in rules:
        going = F.col("rejected_by").isNull()
        df = _with(df, rule.needs, made, going)
        df = df.withColumn("rejected_by", F.when(going & F.expr(rule.rejects), rule.name).otherwise(F.col("rejected_by")))
    return df


def judge(docs: DataFrame, rules: list[Rule] | tuple[Rule, ...] | None = None, text: str = "text", report: tuple[str, ...] = (), report_all: bool = False) -> DataFrame:
    """docs with ``rejected_by``: the first rule of the cascade that rejects the text, null if none does.

    rules: in the order to ask them; by default RULES in the order that a sample suggests.  The features
    in report are made for every row and stay in the result (all of FEATURES with report_all); the others
    are made only until a rule rejects the row, and do not stay.
    """
    report = FEATURES if report_all else tuple(report)
    old = [F.col("_row").getField(c).alias(c) for c in docs.columns if c not in (*report, "rejected_by")]
    return _cascade(docs, rules, text, report).select(*old, *report, "rejected_by")


def kept(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that no rule rejects, with docs' columns."""
    return _cascade(docs, None, text, ()).where("rejected_by is null").select("_row.*")
