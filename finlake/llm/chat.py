"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted by turn, and adjacent
turns of one role are merged into a block, a slice of the sorted array::

    <|start|>role<|message|>text<|turn|>text<|end|>

``<|turn|>`` stands between the merged texts of a block, so the turns can be
read back.  Inside roles and texts every control string gets a backslash after its
first character (``<\\|end|>``, ``[\\INST]``), also where it already has some, and
reading back takes one away: the escape is reversible for every text, and no
escaped text holds a control string.  Besides the template's own ``<|`` the strings of
another common template count as control strings: <s> </s> [INST] [/INST].
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

START, MESSAGE, TURN, END = "<|start|>", "<|message|>", "<|turn|>", "<|end|>"
_CONTROL = r"(\||/?s>|/?INST\])"
_STEP = 256


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])\\(\\*)" + _CONTROL, "$1$2$3")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv id, formatted, loss_spans (array of start
    and end in code points of `formatted`, end exclusive: one span for each
    text of `loss_role`, in order).

    NULL roles and texts count as empty strings, a NULL turn sorts first, a NULL
    conversation id is a conversation.  Turns with the same number are sorted by
    role, then text; repeated rows are kept.  Other columns are left out.  No rows
    give no conversations.
    """
    t = turns.select(
        F.col(conv_col).alias("conv"),
        F.struct(F.col(turn_col).alias("turn"),
                 F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                 F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    grouped = t.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    # blocks start where the role changes
    starts = grouped.withColumn("starts", F.expr(
        "filter(sequence(0, size(ts) - 1), i -> i = 0 or ts[i].role != get(ts, i - 1).role)"))
    blocks = starts.select("conv", F.expr(
        "transform(starts, (s, k) -> struct(ts[s].role as role, transform(slice(ts, s + 1, "
        "coalesce(get(starts, k + 1), size(ts)) - s), t -> t.text) as texts))").alias("blocks"))
    escaped = blocks.select("conv", F.transform("blocks", lambda b: F.struct(
        escape(b["role"]).alias("role"), (b["role"] == loss_role).alias("loss"),
        F.transform(b["texts"], escape).alias("texts"))).alias("blocks"))
    # the pieces of the output in order: with their lengths they give the spans
    pieces = escaped.select("conv", F.flatten(F.transform("blocks", lambda b: F.concat(
        F.array(F.struct(F.concat(F.lit(START), b["role"], F.lit(MESSAGE)).alias("s"), F.lit(False).alias("loss"))),
        F.flatten(F.transform(b["texts"], lambda x, i: F.when(
            i == 0, F.array(F.struct(x.alias("s"), b["loss"].alias("loss")))).otherwise(
            F.array(F.struct(F.lit(TURN).alias("s"), F.lit(False).alias("loss")),
                    F.struct(x.alias("s"), b["loss"].alias("loss")))))),
        F.array(F.struct(F.lit(END).alias("s"), F.lit(False).alias("loss")))))).alias("pieces"))
    # running sums of the lengths, by steps: an array that grows is copied each time
    running = "(a, n) -> concat(a, array(element_at(a, -1) + n))"
    summed = pieces.withColumn("lens", F.expr("transform(pieces, p -> length(p.s))")).withColumn("before", F.expr(
        f"aggregate(transform(sequence(1, size(lens), {_STEP}), s -> aggregate(slice(lens, s, {_STEP}), 0, (a, n) -> a + n)), "
        f"array(0), {running})"))
    at = F.expr(f"flatten(transform(before, (b, k) -> slice(aggregate(slice(lens, k * {_STEP} + 1, {_STEP}), array(b), {running}), "
                f"1, {_STEP})))")
    spans = F.expr("transform(filter(zip_with(zip_with(pieces, lens, (p, n) -> struct(p.loss as loss, n as n)), "
                   "slice(at, 1, size(lens)), (p, a) -> struct(p.loss as loss, a as start, a + p.n as end)), x -> x.loss), "
                   "x -> struct(x.start as start, x.end as end))")
    return (summed.withColumn("at", at)
            .select(F.col("conv").alias(conv_col), F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"),
                    spans.alias("loss_spans")))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), texts as
    they were before escaping."""
    def block(b: Column) -> Column:
        part = F.split(F.substr(b, F.lit(len(START) + 1)), r"<\|message\|>", 2)
        role = unescape(F.get(part, F.lit(0)))
        return F.transform(F.split(F.get(part, F.lit(1)), r"<\|turn\|>", -1),
                           lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    blocks = F.split(formatted, r"<\|end\|>", -1)
    return F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), block))


def _let(value: Column, f) -> Column:
    """f(value), value worked out once also where f uses it for each item of an array."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between.  Spans are read
    by steps, each from the part that holds them: code points are counted from a string's start."""
    def part(text: Column, spans: Column) -> Column:
        start, end = F.get(spans, F.lit(0))["start"], F.element_at(spans, -1)["end"]
        return _let(F.struct(F.substr(text, start + 1, end - start).alias("text"), start.alias("start")), lambda p: F.array_join(
            F.transform(spans, lambda s: unescape(F.substr(p["text"], s["start"] - p["start"] + 1, s["end"] - s["start"]))), ""))

    return _let(F.struct(formatted.alias("text"), loss_spans.alias("spans")), lambda x: F.when(
        F.size(x["spans"]) == 0, "").otherwise(F.array_join(F.transform(
            F.sequence(F.lit(1), F.size(x["spans"]), F.lit(_STEP)),
            lambda i: _let(F.slice(x["spans"], i, _STEP), lambda s: part(x["text"], s))), "")))
