"""URL filters by a weighted vocabulary and host rules.

An Aho-Corasick automaton over all terms reads each lower-cased url once; a hit counts only between
characters that are no ASCII letters or digits.  One strict term rejects; soft terms reject when the
weights of the distinct ones reach SOFT_LIMIT.  Host rules come first: a rule fits its host and all
subdomains if the path starts with the rule's, and the longest wins.

Defined cases: a null url has an empty host and path, no hits, and is allowed; one without ``://`` has
an empty host and path, but the vocabulary reads it whole; each row is judged alone, so repeated rows and long urls need nothing special; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Verdict and rule, host before the first slash and path from it.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Terms of which one is enough.
STRICT = ("casino", "porn", "spam", "warez", "xxx", "viagra", "malware", "phishing", "escort", "webcamsex", "jackpot", "keygen", "cialis", "botnet")
#: Terms and weights; only several distinct ones reach SOFT_LIMIT.
SOFT = {
    "pills": 3, "bets": 3, "adult": 3, "torrent": 3, "slots": 3, "crack": 3, "bonus": 2, "cheap": 2, "loan": 2, "dating": 2, "win": 2, "ads": 2, "track": 2,
    "farm": 2, "clickbait": 2, "free": 1, "download": 1, "click": 1, "deal": 1, "promo": 1, "offer": 1, "prize": 1,
}
SOFT_LIMIT = 4


def split_url(pages: DataFrame) -> DataFrame:
    """pages (page_id, url) with host and path."""
    rest = F.when(F.col("url").contains("://"), F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    df = pages.select("page_id", "url", F.coalesce(rest, F.lit("")).alias("rest"))
    host = lower_ascii(F.regexp_extract("rest", r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract("rest", r"(?s)^[^/?#]*([^?#]*)", 1)
    return df.select("page_id", "url", host.alias("host"), path.alias("path"))


def with_rule(df: DataFrame, rules=RULES) -> DataFrame:
    """df with rule and rule_verdict of the longest rule that fits, else null."""
    best_rule, best_verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        host, slash, tail = rule.partition("/")
        fits = F.concat(F.lit("."), F.col("host")).endswith("." + host) & F.col("path").startswith(slash + tail)
        best_rule = F.when(fits, rule).otherwise(best_rule)
        best_verdict = F.when(fits, verdict).otherwise(best_verdict)
    return df.withColumn("rule", best_rule).withColumn("rule_verdict", best_verdict)


def vocabulary_counter(strict=STRICT, soft=SOFT):
    """A function for mapInArrow that adds n_strict and soft_weight to rows with a url."""
    strict, soft = tuple(strict), dict(soft)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in (*strict, *soft):
            automaton.add_word(term, (term, term in strict, soft.get(term, 0)))
        automaton.make_automaton()
        inside = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        for batch in batches:
            n_strict, weight = [], []
            for url in batch.column("lowered").to_pylist():
                hits = {}
                if url:
                    for end, (term, is_strict, w) in automaton.iter(url):
                        a, b = end - len(term), end + 1
                        if (a < 0 or url[a] not in inside) and (b >= len(url) or url[b] not in inside):
                            hits[term] = (is_strict, w)
                n_strict.append(sum(s for s, _ in hits.values()))
                weight.append(sum(w for _, w in hits.values()))
            cols = [batch.column(c) for c in ("page_id", "host", "path", "rule", "rule_verdict")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_strict, pa.int64()), pa.array(weight, pa.int64())], names=["page_id", "host", "path", "rule", "rule_verdict", "n_strict", "soft_weight"])

    return count


def filter_urls(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_strict, soft_weight) for every row of pages."""
    df = with_rule(split_url(pages), rules).select("page_id", "host", "path", "rule", "rule_verdict", lower_ascii(F.col("url")).alias("lowered"))
    page_id = df.schema["page_id"].dataType.simpleString()
    df = df.mapInArrow(vocabulary_counter(strict, soft), f"page_id {page_id}, host string, path string, rule string, rule_verdict string, n_strict long, soft_weight long")
    bad = (F.col("n_strict") > 0) | (F.col("soft_weight") >= soft_limit)
    verdict = F.coalesce("rule_verdict", F.when(bad, "block").otherwise("allow"))
    return df.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "n_strict", "soft_weight")
