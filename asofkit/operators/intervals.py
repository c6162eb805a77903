"""Joins of points with a large table of intervals, by an index of aligned bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F



def _whole(low: Column, high: Column, levels: int) -> list[tuple[int, Column, Column]]:
    """(level, condition, number) of the aligned bins of sizes 1, 2, 4 .. 2^(levels - 1) that cover the whole numbers low..high exactly, at
    most two per level.

    At a level the bins that lie inside run from l to r - 1; the first is taken when l is odd and the last when r is odd: their other halves lie outside.
    """
    out = []
    for k in range(levels):
        first, end = F.shiftright(low + F.lit((1 << k) - 1), k), F.shiftright(high + 1, k)
        out.append((k, (first < end) & (first % 2 != 0), first))
        out.append((k, (first < end) & (end % 2 != 0), end - 1))
    return out


def join_intervals(points: DataFrame, intervals: DataFrame, *, at: str, low: str, high: str, by: Sequence[str] = (), salts: int = 1) -> DataFrame:
    """Every point beside every interval of the same `by` group that holds it: low <= at <= high, in whole numbers.

    A NULL bound is open, a NULL point or group meets nothing, low > high holds nothing; rows that repeat are joined as often as
    they come. Each interval is written as a few aligned bins and each point asks for the one bin per size that it lies in, so this
    is an equi-join: no side is broadcast and no pair outside the result is formed. `salts` deals the points of a full bin to so many
    tasks, with the intervals (the bins, not the rows of the result) repeated for each.
    """
    span = intervals.agg(F.min(low), F.max(high)).first()
    edge = points.agg(F.min(at), F.max(at)).first()
    known = [int(x) for x in (*span, *edge) if x is not None]
    least, most = (min(known), max(known)) if known else (0, 0)  # open ends need only reach the last point
    base = F.lit(least).cast("long")
    a = F.coalesce(F.col(low).cast("long"), base) - base
    b = F.coalesce(F.col(high).cast("long"), F.lit(most).cast("long")) - base
    levels = max(1, (most - least + 1).bit_length())
    cover = _whole(a, b, levels)
    masks = [F.bit_or(F.when(takes, 1).otherwise(0)).alias(f"__t{i}") for i, (_, takes, _) in enumerate(cover)]
    found = intervals.agg(*masks).first()  # levels that any interval uses: one pass, nothing is written out for it
    used = {k for i, (k, _, _) in enumerate(cover) if found[i]}
    cell = lambda k, n: F.struct(F.lit(k).cast("int").alias("__level"), n.cast("bigint").alias("__bin"))
    none = F.array().cast("array<struct<__level:int,__bin:bigint>>")
    own = F.array_compact(F.array(*[F.when(takes, cell(k, n)) for k, takes, n in cover if k in used])) if used else none
    bins = intervals.select("*", F.inline(own))
    place = F.col(at).cast("long") - base
    asks = F.array(*[cell(k, F.shiftright(place, k)) for k in sorted(used)]) if used else none
    left = points.where(F.col(at).isNotNull()).select("*", F.inline(asks))
    if salts > 1:
        bins = bins.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        left = left.withColumn("__salt", F.pmod(F.xxhash64(*points.columns), F.lit(salts)).cast("int"))
    keys = [*by, "__level", "__bin", *["__salt"] * (salts > 1)]
    # a table on file looks smaller than its bins are, so the planner may not choose to send them to every task
    return left.join(bins.hint("merge"), keys).drop("__level", "__bin", "__salt")
