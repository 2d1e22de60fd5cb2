"""Chat formatting from event logs (operator 3), in built-in column functions only.

A log row is ``conv_id, seq, message, kind, role, text``.  Events of a message are folded in the
order of ``seq``: a ``delta`` appends its text, an ``edit`` replaces what the message says so far by its text, a
``regenerate`` discards it.  Messages are rendered in the order of ``message``::

    <|im_start|>role
    text<|im_end|>

Inside texts and roles ``<``, any backslashes and ``|`` get one more backslash, so no control string can come
from a text, and taking one away restores it; a role's line ends and percent signs are percent-encoded.  The loss mask lists
the spans (from 1, in code points) of the texts whose role is in ``loss_roles``.

A message's events meet in one row, and so do a conversation's messages: they are one output text.
Defined cases: null texts and roles are empty; a null ``conv_id`` is one conversation of its own; events that
tie in ``seq`` are ordered by kind, text and role; an unknown kind is an error; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def fold(events: DataFrame) -> DataFrame:
    """``conv_id, message, role, text``: the final messages of the logs."""
    known = F.col("kind").isin("delta", "edit", "regenerate")
    kind = F.when(known, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown event kind "), F.coalesce("kind", F.lit("null")))))
    step = F.struct("seq", kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"))
    rows = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(step)).alias("log"))
    resets = F.filter(F.transform("log", lambda e, i: F.when(e["kind"] != "delta", i + 1)), lambda i: i.isNotNull())
    rows = rows.withColumn("from", F.coalesce(F.array_max(resets), F.lit(1)))
    live = F.slice("log", F.col("from"), F.size("log") - F.col("from") + 1)
    text = F.array_join(F.transform(live, lambda e: F.when(e["kind"] != "regenerate", e["text"]).otherwise("")), "")
    roles = F.filter("log", lambda e: e["role"] != "")
    role = F.when(F.size(roles) > 0, F.get(roles, F.lit(0))["role"]).otherwise("")
    return rows.select("conv_id", "message", role.alias("role"), text.alias("text"))


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id, formatted, loss_spans``: each conversation's text and its loss mask."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    rows = messages.select("conv_id", "message", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.length("piece")).over(before) - F.length("piece") + F.length("head") + 1
    rows = rows.withColumn("span", F.struct(start.cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    piece = F.struct("message", "piece", F.when(F.col("role").isin(*loss_roles), F.col("span")).alias("span"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("p", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted text as an array of ``role, text``."""
    parts = F.split(formatted, r"<\|im_end\|>\n", -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    bare = lambda p: F.substr(p, F.lit(len(START) + 1))
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape_role(F.substring_index(bare(p), "\n", 1)).alias("role"),
            unescape(F.regexp_replace(bare(p), r"^[^\n]*\n", "")).alias("text"),
        ),
    )


def masked(formatted: Column, spans: Column) -> Column:
    """All text under a loss mask, unescaped."""
    cut = lambda s: unescape(F.substr(formatted, s["start"].cast("int"), s["length"].cast("int")))
    return F.array_join(F.transform(spans, cut), "")


def turns_as_events(turns: DataFrame) -> DataFrame:
    """A log with one delta for each row of ``conv_id, turn, role, text``; rows that tie are turns of their own."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("message", F.row_number().over(order))
    return rows.select("conv_id", F.col("message").alias("seq"), "message", F.lit("delta").alias("kind"), "role", "text")
