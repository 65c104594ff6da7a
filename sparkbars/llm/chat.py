"""Chat formatting by prefix-target expansion: every assistant turn becomes an
example of its own, all preceding turns its context and only that reply under
the loss mask.

A turn is written ``### {role}: {text}</turn>\\n``. Inside texts and roles a
backslash is doubled and one is put into every control string (``<\\/turn>``,
``##\\# ``; ``:\\ `` in roles), so no control string can occur in them; removing
each backslash that is in front of a character undoes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template.
HEAD, SEP, END = "### ", ": ", "</turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))
    out = F.replace(out, F.lit("### "), F.lit("##\\# "))
    return F.replace(out, F.lit(SEP), F.lit(":\\ ")) if role else out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expand(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> one row per example: ``conv_id, example,
    text, loss_start, loss_end`` (code points; the mask is half-open).

    Turns go by ``turn`` (nulls last), ties by role and text; null roles and
    texts count as empty; repeated rows are repeated turns. Turns behind the
    last assistant turn (all, if there is none) close the conversation as one
    example more, whose mask is empty, so that the output holds every turn.
    Rows with a null conv_id are one conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = turns.select("conv_id", F.col("turn").isNull().alias("no_turn"), F.col("turn").cast("long").alias("turn"),
                        role.alias("role"), text.alias("text"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("no_turn", "turn", "role", "text"))).alias("turns"))
    head = F.transform("turns", lambda t: F.concat(F.lit(HEAD), escape(t["role"], role=True), F.lit(SEP)))
    body = F.transform("turns", lambda t: escape(t["text"]))
    convs = convs.select("conv_id", "turns", head.alias("head"), body.alias("body"))
    whole = F.zip_with("head", "body", lambda h, b: F.concat(h, b, F.lit(END)))
    replies = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1)), lambda i: i.isNotNull())
    convs = convs.select("conv_id", "head", "body", whole.alias("whole"), F.size("turns").alias("n"), replies.alias("replies"))
    tail = F.when(F.coalesce(F.try_element_at("replies", F.lit(-1)), F.lit(0)) < F.col("n"), F.array(-F.col("n"))).otherwise(
        F.array().cast("array<int>"))
    at = convs.select("*", F.posexplode(F.concat("replies", tail)).alias("example", "at"))
    context = F.array_join(F.slice("whole", F.lit(1), F.abs("at") - F.when(F.col("at") > 0, 1).otherwise(0)), "")
    head_at, body_at = (F.when(F.col("at") > 0, F.element_at(c, F.greatest(F.col("at"), F.lit(1)))).otherwise("") for c in ("head", "body"))
    prompt = at.select("conv_id", "example", F.concat(context, head_at).alias("prompt"), body_at.alias("reply"),
                       F.when(F.col("at") > 0, F.lit(END)).otherwise("").alias("end"))
    start = F.length("prompt").cast("long")
    return prompt.select("conv_id", "example", F.concat("prompt", "reply", "end").alias("text"), start.alias("loss_start"),
                         (start + F.length("reply")).alias("loss_end"))


def read_back(examples: DataFrame) -> DataFrame:
    """The conversations out of written examples: one row per ``conv_id`` with
    ``turns`` (role and text of each turn, unescaped), ``loss`` (what the masks
    cover, unescaped, in order) and ``formatted_chars`` (code points of all its
    examples)."""
    masked = F.expr("substring(text, cast(loss_start + 1 as int), cast(loss_end - loss_start as int))")
    per = examples.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("example", unescape(masked).alias("loss")))).alias("parts"),
        F.max_by("text", "example").alias("last"), F.sum(F.length("text")).cast("long").alias("formatted_chars"))
    pieces = F.filter(F.split("last", F.lit("</turn>\\n")), lambda p: p != "")
    body = F.transform(pieces, lambda p: F.substring(p, F.lit(len(HEAD) + 1), F.length(p)))
    turns = F.transform(body, lambda b: F.struct(
        unescape(F.substring_index(b, SEP, 1)).alias("role"),
        unescape(F.substring(b, F.length(F.substring_index(b, SEP, 1)) + len(SEP) + 1, F.length(b))).alias("text")))
    return per.select("conv_id", turns.alias("turns"), F.array_join(F.transform("parts", lambda p: p["loss"]), "").alias("loss"),
                      "formatted_chars")
