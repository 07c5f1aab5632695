"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import align, bpe, chat, importance, license_scan, line_dedup, mixing, ngram_join, pii, quality, repeats, topk, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"), report=counts)
    base_failed = F.expr(" or ".join(f"({r.rejects})" for r in quality.BASE_RULES))
    return judged.select("doc_id", *counts, base_failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = chat.END + chat.START + "assistant ok"
    planted = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], turns.schema)
    done = chat.format_chats(chat.as_events(turns.unionByName(planted)))
    done = done.withColumn("said", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans")))
    each = F.array_join(F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("said").cast("long").alias("n_turns"),
        F.sha2(each.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mixing.decided(_table(spark, sf_dir, "documents"))
    return done.select(F.col("_row.doc_id").alias("doc_id"), *mixing.DIMS, F.col("tokens").cast("long").alias("n_tokens"), "weight", "probability", "kept")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.counted(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(F.col("_row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(_table(spark, sf_dir, "documents").select("doc_id", "text"), n=4, percent=85)


def op9_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.token_links(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = importance.resample_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return made.select("doc_id", "n_features", "weight", "score", "rank")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_topk, op2_quality, op3_chat, op4_repeats, op5_license, op6_mixing, op7_lines, op8_ngram, op9_url, op10_bpe, op11_align, op12_importance, op13_pii, pipeline)
    return {f.__name__: f for f in made}


def _op9_sql() -> str:
    hit = lambda t: f"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    low = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    strict = " or ".join(map(hit, url_filter.STRICT))
    soft = " + ".join(f"{w} * cast({hit(t)} as int)" for t, w in url_filter.SOFT.items())
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1]))
    fits = [(v, r, f"ends_with('.' || host, '.{r.partition('/')[0]}') and starts_with(path, '/{r.partition('/')[2]}')") for v, r in rules]
    rule = "case " + " ".join(f"when {f} then '{r}'" for _, r, f in fits) + " end"
    said = "case " + " ".join(f"when {f} then '{v}'" for v, _, f in fits) + f" when {strict} or {soft} >= {url_filter.SOFT_LIMIT} then 'block' else 'allow' end"
    return (
        f"with p as (select page_id, url, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages), "
        f"q as (select page_id, {low.format('regexp_extract(rest, ' + chr(39) + '^([^/?#]*)' + chr(39) + ', 1)')} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, "
        f"coalesce({low.format('url')}, '') as u from p) select page_id, host, path, {rule} as rule, {said} as verdict from q"
    )


def _op1_sql() -> str:
    return (
        "with e as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings where embedding is not null "
        "and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0), "
        "d as (select a.vec_id as query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) as bigint) as score from e a, e b where a.vec_id % 50 = 0 and a.vec_id != b.vec_id) "
        "select query_id, cast(rank as integer) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from d) where rank <= 5"
    )


def _op3_sql() -> str:
    says = chat.END + chat.START + "assistant ok"
    fixed = len(chat.START) + len(chat.END) + 2
    return (
        f"with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -1, 0, 'user', '{says}' union all select -1, 1, 'assistant', '{says}'), "
        "g as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as said, "
        "coalesce(string_agg(text, '' order by turn, text) filter (where role = 'assistant'), '') as loss, "
        f"sum(length(role) + length(regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g')) + {fixed}) as formatted_chars from t group by conv_id) "
        "select conv_id, n_turns, sha256(said) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, cast(formatted_chars as bigint) as formatted_chars from g"
    )


def _op2_sql() -> str:
    rejects = " or ".join(f"({r.rejects})" for r in quality.RULES)
    base = " or ".join(f"({r.rejects})" for r in quality.BASE_RULES)
    return (
        "with d as (select doc_id, coalesce(text, '') as text from documents), "
        "w as (select doc_id, text, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') as ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) as ls from d), "
        "g as (select doc_id, i, array_to_string(ws[i : i + 4], ' ') as gram from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w)), "
        "r as (select doc_id, count(distinct j) as n from (select doc_id, unnest(range(i, i + 5)) as j from (select *, count(*) over (partition by doc_id, gram) as c from g) where c > 1) group by 1), "
        "f as (select doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, "
        "len(ls) - len(list_distinct(ls)) as n_dup_lines, len(ls) as n_lines, coalesce(r.n, 0) as n_repeat_words, length(text) - length(regexp_replace(text, '\\p{Lu}', '', 'g')) as n_upper from w left join r using (doc_id)) "
        f"select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) as base_failed, not ({rejects}) as kept from f"
    )


def _op12_sql() -> str:
    words = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    m, step = importance.BUCKETS, "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    return (
        f"with w as (select doc_id, {words.format('text')} as ws from documents), b as (select {words.format('text')} as ws from benchmark), "
        f"crc as (select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: {step}, n)) as tab), "
        "f as (select word, sum(s) as s, sum(t) as t from (select unnest(ws) as word, 1 as s, 0 as t from w union all select unnest(ws), 0, 1 from b) group by 1), "
        "x as (select word, s as n_s, t as n_t, list_transform(range(0, strlen(word)), lambda i: instr('0123456789ABCDEF', substr(hex(word), 2 * i + 1, 1)) * 16 - 17 + instr('0123456789ABCDEF', substr(hex(word), 2 * i + 2, 1))) as bytes from f), "
        f"h as (select word, n_s as s, n_t as t, xor(list_reduce(bytes, lambda c, v: xor(c >> 8, crc.tab[cast(xor(c, v) & 255 as int) + 1]), 4294967295), 4294967295) % {m} as bucket from x, crc), "
        "n as (select cast(sum(s) as double) as s_all, cast(sum(t) as double) as t_all from h), "
        f"g as (select bucket, cast(floor(1000 * ln((sum(h.t) + 1) * (s_all + {m}) / ((sum(h.s) + 1) * (t_all + {m})))) as bigint) as gain from h, n group by bucket, s_all, t_all), "
        "d as (select doc_id, count(*) as n, sum(gain) as total from (select doc_id, unnest(ws) as word from w) join h using (word) join g using (bucket) group by 1), "
        f"e as (select doc_id, coalesce(n, 0) as n_features, cast(coalesce(floor(total / n), 0) as bigint) as weight, cast('0x' || substr(sha256('{importance.SEED}:' || doc_id), 1, 8) as bigint) as h from w left join d using (doc_id)), "
        "k as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0))) as bigint) as score from e), "
        f"r as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as fit from k where n_features >= {importance.MIN_WORDS}) "
        f"select doc_id, n_features, weight, score, rank from k left join (select doc_id, rank from r where rank <= {importance.SHARE} * fit // 100) using (doc_id)"
    )


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; the tests hold the others against brute force."""
    return {"op1_topk": _op1_sql(), "op2_quality": _op2_sql(), "op3_chat": _op3_sql(), "op9_url": _op9_sql(), "op12_importance": _op12_sql()}
