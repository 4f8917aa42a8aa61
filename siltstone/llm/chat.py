"""Chat formatting by event-sourced reconstruction (native: DataFrame functions only).

A log of events (conversation, seq, kind, message, role, text) is partitioned by conversation, sorted by
sequence and folded into final messages, which are rendered with a template:

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n        for each message, in the order of their first events

Kinds of events: `message` and `edit` set a message's text, `delta` appends to it, `regenerate` empties it,
`delete` removes the message (a later `message`, `edit` or `delta` brings it back). So a message's text is
that of its last reset and of the deltas after it, which needs no loop.

Escaping is reversible: in texts a backslash is doubled, then `<|` becomes `<\\|`, so no text holds a control
string. In roles `%`, newline and `<` become `%25`, `%0A` and `%3C`. The loss mask is a list of (start, length)
spans of code points over the formatted string, one per assistant message.

Defined results: null text or role is empty; a null conversation id is a conversation of its own; equal
sequence numbers are ordered by message, role and text, null sequence last; repeated rows are repeated
messages; events of a null or unknown kind are ignored, and so are `regenerate` and `delete` with a null message,
which address none; a conversation whose messages are all deleted formats to the empty string; no rows give no rows.
One conversation is one value of the result, so its final messages meet in one row, however long they are; its events
are first folded per message. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
_RESETS = ("message", "edit", "regenerate", "delete")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    for raw, code in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(raw), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for raw, code in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(raw))
    return role


def turns_as_events(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table of finished turns as an event log with one `message` event per row."""
    return turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("seq"),
        F.lit("message").alias("kind"),
        F.lit(None).cast("string").alias("message"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )


def fold(events: DataFrame) -> DataFrame:
    """Events to conv_id, messages: an array of (role, text) in order.

    An event with a null `message` is the only one of a message of its own: `own` tells it from others, and has no
    say in the order. One exchange by conversation serves both groupings.
    """
    clean = (
        events.select("conv_id", "seq", F.lower("kind").alias("kind"), "message", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .where(F.col("kind").isin("delta", *_RESETS) & (F.col("message").isNotNull() | F.col("kind").isin("message", "edit", "delta")))
        .withColumn("own", F.when(F.col("message").isNull(), F.monotonically_increasing_id()))
        .repartition("conv_id")
    )
    rank = F.struct(F.col("seq").isNull().alias("late"), F.col("seq").alias("seq"))
    # Order among a message's events: sequence, then resets before deltas, then text.
    event = F.struct(rank.alias("at"), F.when(F.col("kind") == "delta", 1).otherwise(0).alias("delta"), "kind", "role", "text")
    grouped = clean.groupBy("conv_id", "message", "own").agg(F.array_sort(F.collect_list(event)).alias("log"))
    last = F.aggregate(
        F.sequence(F.lit(1), F.size("log")), F.lit(1), lambda at, i: F.when(F.element_at("log", i)["kind"].isin(*_RESETS), i).otherwise(at)
    )
    live = F.slice("log", "last", F.size("log") - F.col("last") + 1)
    # A deletion holds unless something was written after it.
    folded = (
        grouped.withColumn("last", last)
        .withColumn("live", live)
        .select(
            "conv_id",
            ((F.element_at("live", 1)["kind"] != "delete") | (F.size("live") > 1)).alias("kept"),
            F.struct(
                F.element_at("log", 1)["at"].alias("at"),
                "message",
                F.try_element_at(F.filter(F.transform("log", lambda e: e["role"]), lambda r: r != ""), F.lit(-1)).alias("role"),
                F.array_join(F.transform("live", lambda e: F.when(e["kind"].isin("delete", "regenerate"), "").otherwise(e["text"])), "").alias("text"),
            ).alias("m"),
        )
        .withColumn("m", F.struct(F.col("m.at").alias("at"), F.col("m.message").alias("message"), F.coalesce("m.role", F.lit("")).alias("role"), F.col("m.text").alias("text")))
    )
    ordered = F.array_sort(F.collect_list(F.when(F.col("kept"), F.col("m"))))
    return folded.groupBy("conv_id").agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))


def render(folded: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans: the template over the messages, and the spans that training learns from."""
    parts = F.transform(
        "messages",
        lambda m: F.struct(
            F.concat(F.lit(START), escape_role(m["role"]), F.lit("\n")).alias("head"),
            escape(m["text"]).alias("body"),
            (m["role"] == trained_role).alias("trained"),
        ),
    )
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + len(END)).alias("at"),
            F.when(p["trained"], F.array_append(acc["spans"], F.struct((acc["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))))
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )
    return folded.withColumn("parts", parts).select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        spans["spans"].alias("loss_spans"),
    )


def format_events(events: DataFrame) -> DataFrame:
    return render(fold(events))


def parse(formatted: DataFrame) -> DataFrame:
    """Reads formatted conversations back: conv_id, messages (role, text), loss_texts (one per span, unescaped)."""
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda b: b != "")
    split_at = lambda b: F.instr(b, "\n")
    return formatted.select(
        "*",
        F.transform(
            blocks,
            lambda b: F.struct(
                unescape_role(F.substring(b, F.lit(len(START) + 1), split_at(b) - F.lit(len(START) + 1))).alias("role"),
                unescape(F.substring(b, split_at(b) + 1, F.length(b))).alias("text"),
            ),
        ).alias("messages"),
        F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["length"]))).alias("loss_texts"),
    )
