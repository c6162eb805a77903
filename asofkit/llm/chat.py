"""Operator 7: chat formatting by prefix-target expansion, DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are context and only that reply is trainable. Turns
after the last reply (or of a conversation without one) form one more example without a target, so the output holds the whole
conversation. A turn is written as `### role: text </turn>` and a line break. Backslash, `#`, `<` and (in roles) `:` inside
texts are escaped, so that no text can hold a control string; `unescaped` takes that back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, COLON, CLOSE = "### ", ": ", " </turn>\n"
# Backslash first when escaping and last when taking it back: each escape is a backslash and one letter.
_ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escaped(value: Column, role: bool = False) -> Column:
    for plain, code in _ESCAPES if role else _ESCAPES[:3]:
        value = F.replace(value, F.lit(plain), F.lit(code))
    return value


def unescaped(value: Column) -> Column:
    for plain, code in reversed(_ESCAPES):
        value = F.replace(value, F.lit(code), F.lit(plain))
    return value


def expand_targets(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per example: conv_id, example (0, 1, ...), formatted, loss_start, loss_end (code points, NULL without a target).

    `turns` has conv_id, turn, role, text. Turns go by number, ties by role and text; a repeated row is a turn of its own. A
    NULL text or role is empty, a NULL turn comes first, NULL ids form one conversation. Other columns are not read. The
    context of an example is copied into it, as the format asks: the output of a conversation of t turns grows as t squared,
    and one conversation is held by one task.
    """
    blank = F.lit("")
    rows = turns.select(F.col(key).cast("long").alias("conv_id"), F.struct(
        F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = F.transform("turns", lambda t: F.concat(F.lit(OPEN), escaped(t["role"], role=True), F.lit(COLON)))
    body = F.transform("turns", lambda t: escaped(t["text"]))
    chats = chats.select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), head.alias("head"), body.alias("body"))
    chats = chats.withColumn("n", F.size("roles")).withColumn(
        "ends", F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.element_at("roles", i) == "assistant"))
    tail = F.when(F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)) < F.col("n"), F.array("n")).otherwise(F.array().cast("array<int>"))
    chats = chats.withColumn("all_ends", F.concat("ends", tail))
    one = chats.select("conv_id", "roles", "head", "body", F.posexplode("all_ends").alias("example", "last"))
    lines = F.transform(F.sequence(F.lit(1), F.col("last")), lambda i: F.concat(F.element_at("head", i), F.element_at("body", i), F.lit(CLOSE)))
    one = one.select("conv_id", "example", F.array_join(lines, "").alias("formatted"), F.element_at("body", F.col("last")).alias("reply"),
                     (F.element_at("roles", F.col("last")) == "assistant").alias("trained"))
    end = F.char_length("formatted") - F.char_length(F.lit(CLOSE))
    return one.select("conv_id", "example", "formatted", F.when(F.col("trained"), end - F.char_length("reply")).cast("long").alias("loss_start"),
                      F.when(F.col("trained"), end).cast("long").alias("loss_end"))


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from one example."""
    parts = F.split(formatted, "</turn>\n", -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(part: Column) -> Column:
        size = F.char_length(part)
        colon = F.locate(COLON, part)
        role = F.substring(part, F.lit(len(OPEN) + 1), colon - F.lit(len(OPEN) + 1))
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(part, colon + 2, size - colon - 2)).alias("text"))

    return F.transform(parts, turn)


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    return unescaped(F.substring(formatted, (start + 1).cast("int"), (end - start).cast("int")))


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    loss = F.coalesce(loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")), F.lit(""))
    rows = examples.select("conv_id", F.struct("example", F.col("formatted"), loss.alias("loss")).alias("e"))
    chats = rows.groupBy("conv_id").agg(F.max("e").alias("last"), F.sort_array(F.collect_list(F.struct("e.example", "e.loss"))).alias("losses"),
                                        F.sum(F.char_length("e.formatted")).alias("formatted_chars"))
    chats = chats.select("conv_id", parse_turns(F.col("last.formatted")).alias("turns"),
                         F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
                        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                        F.col("formatted_chars").cast("long").alias("formatted_chars"))
