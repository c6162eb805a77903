"""Exact grouped quantiles without holding a group in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise

# value chunks per factor of two, and linear cells inside one chunk
_PER_OCTAVE = 32
_CELLS = 4096
# ranks of more probabilities than this are a table that is joined: an expression for each would be too large to be compiled
_MANY = 16


def value_chunk(value: Column, per_octave: int = _PER_OCTAVE) -> Column:
    """Order-preserving integer of a double: sign and scaled binary logarithm."""
    size = F.floor(F.log2(F.abs(value)) * per_octave) + 1100 * per_octave
    end = 4096 * per_octave  # beyond every finite value
    return F.when(value == float("inf"), F.lit(end)).when(value == float("-inf"), F.lit(-end)).when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0))


def bounded_quantiles(df: DataFrame, *, by: Sequence[str], value: str, probs: Sequence[float], out: str = "quantiles") -> DataFrame:
    """Built-in exact percentile; for tables whose groups are known to be small
    (per-year or per-segment metric rows)."""
    return df.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(p) for p in probs])).alias(out))


def exact_quantiles(
    df: DataFrame, *, by: Sequence[str], value: str, probs: Sequence[float], out: str = "quantiles", per_octave: int = _PER_OCTAVE,
    fine: Sequence[str] | None = None, expand: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles of every group, as an array in the order of `probs`.

    Pass one counts rows per (group, value chunk), which combines map-side. The counts tell
    which chunks hold the wanted ranks; pass two reads only the rows of those chunks, reduces
    them to distinct values and ranks them in linear cells, with the counts below carried.
    The result is exact, and no task ranks more than one cell of one chunk of a group.

    When a row counts in several groups, `fine` names the columns that decide which, and
    `expand` turns one row into one per group (adding `by`). Counts are then taken once per
    fine group and expanded, and a row is only repeated for the groups whose wanted chunk it lies in.
    The wanted chunks are written first: the planner sees how few they are and does not shuffle all
    rows by them.
    """
    v = F.col("__v")
    own = list(fine) if fine is not None else list(by)
    rows = df.select(*own, F.col(value).cast("double").alias("__v")).where(v.isNotNull() & ~F.isnan(v))
    rows = rows.withColumn("__c", value_chunk(v, per_octave))
    hist = rows.groupBy(*own, "__c").agg(F.count("*").alias("__h"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    groups = None
    if expand is not None:
        hist = materialise(hist)
        groups = expand(hist.select(*own).distinct().withColumns({f"__o_{c}": F.col(c) for c in own})).select(*[f"__o_{c}" for c in own], *by)
        hist = expand(hist).groupBy(*by, "__c").agg(F.sum("__h").alias("__h"), F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
    line = Window.partitionBy(*by).orderBy("__c").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumns({"__end": F.sum("__h").over(line), "__n": F.sum("__h").over(Window.partitionBy(*by))})
    many = len(probs) > _MANY
    if many:
        ranks = materialise(_wanted_ranks(materialise(hist), by, probs))
        kept = ranks.drop("__p", "__upper", "__rank").distinct()
    else:
        holds = F.lit(False)
        for p in probs:
            rank = F.lit(float(p)) * (F.col("__n") - 1)
            for r in (F.floor(rank), F.ceil(rank)):
                holds = holds | ((r < F.col("__end")) & (r >= F.col("__end") - F.col("__h")))
        kept = hist.where(holds).select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__c").alias("__kc"), "__lo", "__hi",
                                        (F.col("__end") - F.col("__h")).alias("__from"), "__n")
    same_group = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in by]
    condition = F.col("__c") == F.col("__kc")
    if expand is None:
        for c in same_group:
            condition = condition & c
        near = rows.join(materialise(kept), condition)
    else:  # the wanted chunks per fine group, with the groups that want them
        kept = materialise(groups.join(kept, reduce(Column.__and__, same_group, F.lit(True))).drop(*[f"__k_{c}" for c in by]))
        for c in own:
            condition = condition & F.col(f"__r_{c}").eqNullSafe(F.col(f"__o_{c}"))
        near = rows.withColumnsRenamed({c: f"__r_{c}" for c in own}).join(kept, condition)
    spread = F.when(F.col("__hi") > F.col("__lo"), F.floor((v - F.col("__lo")) * _CELLS / (F.col("__hi") - F.col("__lo"))))
    cell = F.coalesce(spread, F.lit(0))
    keys = [*by, "__c", "__from", "__n"]
    values = near.groupBy(*keys, cell.alias("__s"), "__v").agg(F.count("*").alias("__w"))
    if expand is not None:
        values = materialise(values)  # read twice below; rows would be repeated for their groups twice
    total = values.groupBy(*keys, "__s").agg(F.sum("__w").alias("__sw"))
    below = Window.partitionBy(*by, "__c").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    carry = total.select(*[F.col(c).alias(f"__b_{c}") for c in by], F.col("__c").alias("__bc"), F.col("__s").alias("__bs"),
                         F.coalesce(F.sum("__sw").over(below), F.lit(0)).alias("__below"))
    same = (F.col("__c") == F.col("__bc")) & (F.col("__s") == F.col("__bs"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__b_{c}"))
    inside = Window.partitionBy(*by, "__c", "__s").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.join(carry, same).withColumn("__to", F.col("__from") + F.col("__below") + F.sum("__w").over(inside))
    return _find_ranks(ranked, ranks, by, probs, out) if many else _read_ranks(ranked, by, probs, out)


def _wanted_ranks(hist: DataFrame, by: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Every wanted rank of every group with the value chunk that holds it, from the chunks with their running counts; two rows a probability."""
    ends = F.array(*[F.struct(F.lit(i).alias("__p"), F.lit(k).alias("__upper"), F.lit(float(p)).alias("__prob")) for i, p in enumerate(probs) for k in (0, 1)])
    wanted = hist.groupBy(*[F.col(c).alias(f"__w_{c}") for c in by]).agg(F.max("__n").alias("__m")).select("*", F.inline(ends))
    rank = F.col("__prob") * (F.col("__m") - 1)
    wanted = wanted.withColumn("__rank", F.when(F.col("__upper") == 0, F.floor(rank)).otherwise(F.ceil(rank)))
    inside = (F.col("__rank") < F.col("__end")) & (F.col("__rank") >= F.col("__end") - F.col("__h"))
    for c in by:
        inside = inside & F.col(c).eqNullSafe(F.col(f"__w_{c}"))
    return hist.join(F.broadcast(wanted), inside).select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__c").alias("__kc"), "__lo", "__hi",
                                                         (F.col("__end") - F.col("__h")).alias("__from"), "__n", "__p", "__upper", "__rank")


def _find_ranks(ranked: DataFrame, ranks: DataFrame, by: Sequence[str], probs: Sequence[float], out: str) -> DataFrame:
    """What _read_ranks gives, for many probabilities: rows (value __v, __w rows, running count __to) meet the wanted ranks of their chunk."""
    ranks = ranks.select(*[f"__k_{c}" for c in by], "__kc", "__p", "__upper", "__rank")
    inside = (F.col("__c") == F.col("__kc")) & (F.col("__rank") < F.col("__to")) & (F.col("__rank") >= F.col("__to") - F.col("__w"))
    for c in by:
        inside = inside & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    one = ranked.join(ranks, inside).groupBy(*by, "__p").agg(
        F.max("__n").alias("__n"), *[F.min(F.when(F.col("__upper") == k, F.col("__v"))).alias(name) for k, name in enumerate(("__l", "__h"))])
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("__p") + 1)
    rank, lo, hi = prob * (F.col("__n") - 1), F.col("__l"), F.col("__h")
    value = F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (rank - F.floor(rank)))
    held = F.array_sort(F.collect_list(F.struct("__p", value.alias("value"))))
    return one.groupBy(*by).agg(F.transform(held, lambda x: x["value"]).alias(out))


def _read_ranks(ranked: DataFrame, by: Sequence[str], probs: Sequence[float], out: str) -> DataFrame:
    """Interpolate from rows (value __v, running count __to, group size __n)."""
    aggs = []
    for i, p in enumerate(probs):
        rank = F.lit(float(p)) * (F.col("__n") - 1)
        aggs.append(F.min(F.when(F.col("__to") > F.floor(rank), F.col("__v"))).alias(f"__l{i}"))
        aggs.append(F.min(F.when(F.col("__to") > F.ceil(rank), F.col("__v"))).alias(f"__h{i}"))
    ends = ranked.groupBy(*by).agg(F.max("__n").alias("__n"), *aggs)
    values = []
    for i, p in enumerate(probs):
        rank = F.lit(float(p)) * (F.col("__n") - 1)
        lo, hi = F.col(f"__l{i}"), F.col(f"__h{i}")
        values.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (rank - F.floor(rank))))
    return ends.select(*by, F.array(*values).alias(out))


def weighted_quantiles(
    df: DataFrame, *, by: Sequence[str], value: str, weight: str, probs: Sequence[float], chunk: Column, out: str = "quantiles",
) -> DataFrame:
    """Quantiles of values that each stand for `weight` equal rows.

    Running weights are taken inside value chunks and the totals of lower chunks are carried,
    so no task ranks a whole group. `chunk` must not decrease with the value.
    """
    cell = df.groupBy(*by, chunk.alias("__k"), F.col(value).cast("double").alias("__v")).agg(F.sum(weight).alias("__w"))
    total = cell.groupBy(*by, "__k").agg(F.sum("__w").alias("__kw"))
    below = Window.partitionBy(*by).orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    carry = total.select(*by, "__k", F.coalesce(F.sum("__kw").over(below), F.lit(0)).alias("__from"),
                         F.sum("__kw").over(Window.partitionBy(*by)).alias("__n"))
    line = Window.partitionBy(*by, "__k").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cell.join(carry, [*by, "__k"]).withColumn("__to", F.col("__from") + F.sum("__w").over(line))
    return _read_ranks(ranked, by, probs, out)
