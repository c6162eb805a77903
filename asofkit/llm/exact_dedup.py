"""Operator 4: exact dedup by two-pass Bloom filtering, DataFrame functions only.

Pass one hashes every normalised text to a cell of a bit array with BITS_PER_ROW bits a row and keeps the cells that more than
one row has set; a cell is all that a row sends, and equal cells of a task are one. Pass two tests every row against those bits:
a row whose cell nobody else has set is the only one of its text and passes straight through. Only the rest shuffle by their
digest, as (id, digest) without texts. The bits are broadcast while their counted words stay below the broadcast bound; beyond
it rows and bits meet by the number of the word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ascii_lower, broadcast_if_small, free_name, materialise, row_key, text_name

BITS_PER_ROW = 256  # one row in so many shares its cell with another text by chance; only repeated cells take room


def normalised(text: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text), F.lit("")))


def repeat_filter(cells: DataFrame) -> DataFrame:
    """(word, mask): the cells of column `cell` that at least two rows have set, packed into 64-bit words."""
    repeated = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return repeated.groupBy(F.expr("cell div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(cell % 64 as int))")).alias("mask"))


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", bits_per_row: int = BITS_PER_ROW) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; NULL counts as empty. The row with the largest id stays; a
    NULL id is smaller than any other. Rows that repeat an id with an equal text are all counted in group_size and marked
    alike (keep_id is an id; `first_rows` keeps one row of them). An empty table gives an empty result; columns other than
    the two named are not read.
    """
    bits = 1 << max(12, math.ceil(math.log2(max(1, docs.count()) * bits_per_row)))
    rows = materialise(docs.select(row_key(key).alias("__id"), F.sha2(normalised(text).cast("binary"), 256).alias("__sha")))
    cell = F.pmod(F.xxhash64("__sha"), F.lit(bits))
    found = broadcast_if_small(materialise(repeat_filter(rows.select(cell.alias("cell")))))
    tested = rows.join(found, F.shiftright(cell, 6) == F.col("word"), "left")
    hit = F.coalesce(F.expr("shiftright(mask, cast(pmod(xxhash64(__sha), 64) as int)) & 1") == 1, F.lit(False))
    maybe, single = tested.where(hit).select("__id", "__sha"), tested.where(~hit).select("__id", "__sha")
    groups = materialise(maybe.groupBy(F.col("__sha").alias("__g")).agg(F.max("__id").alias("__keep"), F.count(F.lit(1)).alias("__n")))
    # Read back from storage, both sides of this join are plain exchanges, so AQE can split a hot digest.
    out = maybe.join(groups, F.col("__sha") == F.col("__g")).drop("__g")
    out = out.unionByName(single.select("*", F.col("__id").alias("__keep"), F.lit(1).cast("long").alias("__n")))
    null_id = lambda c: F.when(F.col(c) == -(2**63), F.lit(None)).otherwise(F.col(c))
    return out.select(null_id("__id").alias("doc_id"), null_id("__keep").alias("keep_id"), F.col("__n").alias("group_size"),
                      (F.col("__id") == F.col("__keep")).alias("kept"), F.col("__sha").alias("text_sha256"))


def first_rows(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of `docs` per normalised text, all columns: that with the largest id; of rows that repeat the id, any one with the
    least hash of its own spelling. NULL texts equal empty ones, a NULL id is the smallest.

    Dropped ids are few against the rows, and only they are joined. Texts move only for rows that repeat an id with an equal text.
    """
    groups = materialise(exact_groups(docs, text, key))
    gone, name, turn = (free_name(docs, x) for x in ("gone", "name", "turn"))
    named = lambda rows: broadcast_if_small(materialise(rows.select(row_key().alias(gone), F.xxhash64("text_sha256").alias(name)).distinct()))
    own = F.xxhash64(F.sha2(normalised(text).cast("binary"), 256))
    same = (row_key(key) == F.col(gone)) & (own == F.col(name))
    out = docs.join(named(groups.where(~F.col("kept"))), same, "left_anti")
    again = groups.where("kept and group_size > 1").groupBy("doc_id", "text_sha256").count().where("count > 1")
    if again.isEmpty():
        return out
    again = named(again)
    # Every task keeps one row of a group before they meet.
    first = Window.partitionBy(row_key(key), own).orderBy(text_name(text))
    one = out.join(again, same, "left_semi").withColumn(turn, F.row_number().over(first)).where(F.col(turn) == 1).drop(turn)
    return out.join(again, same, "left_anti").unionByName(one)
