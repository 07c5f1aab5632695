"""Chat formatting from event logs, in DataFrame functions only.

A log has rows (conv_id, seq, turn, kind, role, text).  Kinds: ``message`` starts a message,
``delta`` adds to the message before it in its turn, ``edit`` and ``regenerate`` replace their turn
and drop what came before in that turn and in later turns.  Rows are partitioned by conversation,
sorted by sequence and folded into final messages, which are then rendered.

The template writes ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and texts each ``<``,
any backslashes and ``|`` get one backslash more (``<|`` becomes ``<\\|``), so that no text can
write a control string; reading removes it again.  In roles, line ends are written as ``%0A`` and
``%`` as ``%25``.

Defined cases: null text and null role are empty; rows with the same turn and sequence are ordered
by kind, role and text, and repeated rows stay repeated; a delta without a message before it starts one;
a null conv_id is a conversation of its own; an empty log gives an empty table; other columns are
ignored.  One conversation is one output row, so it must fit in a row, as everywhere in Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import once

START, END = "<|im_start|>", "<|im_end|>"
#: What ends each turn; escaped texts hold no ``<|``.
_CLOSE = END + "\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unrole(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def as_events(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a log of whole messages."""
    return turns.select("conv_id", F.col("turn").alias("seq"), "turn", F.lit("message").alias("kind"), "role", "text")


def final_messages(events: DataFrame) -> DataFrame:
    """(conv_id, n, role, text): the messages that stand at the end of the log, n from 1."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    log = events.select("conv_id", "seq", "turn", F.coalesce("kind", F.lit("message")).alias("kind"), blank("role").alias("role"), blank("text").alias("text"))
    conv = W.partitionBy("conv_id")
    told = ["seq", "turn", "kind", "role", "text"]
    later = conv.orderBy(*(F.col(c).desc_nulls_last() for c in told)).rowsBetween(W.unboundedPreceding, -1)
    cut = F.min(F.when(F.col("kind").isin("edit", "regenerate"), F.col("turn"))).over(later)
    log = log.withColumn("cut", cut).where("cut is null or turn is null or turn < cut").drop("cut")
    inside = conv.orderBy("turn", "seq", "kind", "role", "text")
    starts = (F.col("kind") != "delta") | ~F.lag("turn").over(inside).eqNullSafe(F.col("turn")) | (F.row_number().over(inside) == 1)
    log = log.withColumn("starts", starts)
    log = log.withColumn("n", F.sum(F.col("starts").cast("long")).over(inside.rowsBetween(W.unboundedPreceding, 0))).withColumn("at", F.row_number().over(inside))
    parts = F.array_sort(F.collect_list(F.struct("at", "role", "text")))
    return log.groupBy("conv_id", "n").agg(parts.alias("parts")).select("conv_id", "n", F.col("parts")[0]["role"].alias("role"), F.array_join(F.col("parts.text"), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): spans (start from 0, length) of the escaped assistant texts."""
    head = F.concat(F.lit(START), _role(F.col("role")), F.lit("\n"))
    rows = messages.withColumn("head", head).withColumn("body", escape(F.col("text"))).withColumn("turn_text", F.concat("head", "body", F.lit(_CLOSE)))
    before = W.partitionBy("conv_id").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("turn_text")).over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.col("role") == "assistant", F.struct(F.col("start"), F.length("body").cast("long").alias("length")))
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "turn_text", span.alias("span")))).alias("turns"))
    return rows.select("conv_id", once(F.array_join(F.col("turns.turn_text"), "")).alias("formatted"), F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss_spans"))


def format_chats(events: DataFrame) -> DataFrame:
    return render(final_messages(events))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: what a formatted conversation says, control strings undone."""
    turns = F.split(formatted, r"<\|im_start\|>")
    bare = F.transform(F.filter(turns, lambda t, i: i > 0), lambda t: F.substring(t, F.lit(1), F.length(t) - len(_CLOSE)))
    return F.transform(
        bare,
        lambda t: F.struct(_unrole(F.substring_index(t, "\n", 1)).alias("role"), unescape(F.substring(t, F.locate("\n", t) + 1, F.length(t))).alias("text")),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, control strings undone."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
