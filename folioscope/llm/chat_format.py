"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of a formatted conversation (role and body hold no control string)::

    conversation := turn*
    turn         := "<s>[INST] " role " [/INST]" body "</s>"

A control string inside a role or text is escaped by one backslash after its first character, and
one that already holds backslashes there gets one more, so unescaping is exact for any text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
#: First character, backslashes, rest of each control string: <s> </s> [INST] [/INST].
_CONTROL = r"(?:(<)(\\*)(/?s>)|(\[)(\\*)(/?INST\]))"
_ESCAPED = r"(?:(<)\\(\\*)(/?s>)|(\[)\\(\\*)(/?INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1$4\\$2$5$3$6")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"$1$4$2$5$3$6")


def render_turn(role: Column, body: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), body, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """The turns array<struct<role,text>> that the grammar reads from a formatted conversation."""
    parts = F.split(formatted, CLOSE, -1)
    held = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    head = r"(?s)^<s>\[INST\] (.*?) \[/INST\](.*)$"
    return F.transform(
        held,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_extract(p, head, 2)).alias("text")
        ),
    )


def format_conversations(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant"
) -> DataFrame:
    """One row per conversation: conv, formatted string, escaped boolean, loss_spans array<struct<start,end>>.

    Turns are ordered by turn, then role and text, so repeated or tied rows keep a defined order and are all kept.
    Null role or text: empty. Null turn: first. A null conversation id is a conversation of its own. No rows: no
    conversations. Other columns are ignored. A conversation is first rendered as it is; where the deterministic
    parser does not read the source turns back, its conflicting content is escaped and it is rendered and read again;
    text that does not come back then either is an error. Spans are code points of `formatted`, end exclusive, of the
    bodies of loss_role turns.
    """
    turns = (
        rows.select(F.col(conv).alias("conv"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
        .groupBy("conv")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
    )
    plain = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    tried = turns.select("conv", plain.alias("turns"), F.array_join(F.transform("turns", lambda t: render_turn(t["role"], t["text"])), "").alias("plain"))
    held = F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    read = tried.select("conv", "turns", (parse(F.col("plain")) != F.col("turns")).alias("escaped"))
    safe = read.select("conv", "turns", "escaped", F.when(F.col("escaped"), held).otherwise(F.col("turns")).alias("bodies"))
    # A body starts after what stands before it: sums over the lengths of the turns before.
    ends = F.aggregate(
        "bodies",
        F.array(F.lit(0)),
        lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(t["role"]) + F.length(t["text"]) + F.lit(len(OPEN + MIDDLE + CLOSE)))),
    )
    placed = safe.select("conv", "turns", "bodies", "escaped", ends.alias("ends"))
    spans = F.filter(
        F.transform(
            F.arrays_zip("bodies", F.slice("ends", F.lit(2), F.greatest(F.size("ends") - 1, F.lit(0))).alias("e")),
            lambda z: F.struct(
                (z["e"] - F.lit(len(CLOSE)) - F.length(z["bodies"]["text"])).alias("start"),
                (z["e"] - F.lit(len(CLOSE))).alias("end"),
                z["bodies"]["role"].alias("role"),
            ),
        ),
        lambda s: s["role"] == F.lit(loss_role),
    )
    shown = placed.select("conv", "turns", "escaped", F.array_join(F.transform("bodies", lambda t: render_turn(t["role"], t["text"])), "").alias("formatted"), spans.alias("spans"))
    lost = F.col("escaped") & (parse(F.col("formatted")) != F.col("turns"))
    return shown.select(
        F.col("conv").alias(conv),
        F.when(lost, F.raise_error(F.lit("a conversation does not come back from its formatted text"))).otherwise(F.col("formatted")).alias("formatted"),
        "escaped",
        F.transform("spans", lambda s: F.struct(s["start"], s["end"])).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The formatted rows with turns array<struct<role,text>> parsed and loss_texts cut from the spans, unescaped."""
    return formatted.select(
        "*",
        parse(F.col("formatted")).alias("turns"),
        F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))).alias("loss_texts"),
    )
