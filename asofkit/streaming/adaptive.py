"""Adaptive recent-history forecast as a stream: the last n safe results per group as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

_ROW = "t long, kind string, segment string, event_key long, d long, value double"
_HELD = ("pt", "pk", "rt", "rk", "rd", "rv")
_STATE = "pt array<long>, pk array<long>, rt array<long>, rk array<long>, rd array<long>, rv array<double>"
_ORDER = ["t", "d", "event_key", "value"]


def _newest(n: int):
    """Per task only the n latest results of a segment and time: no other can be among the last n. Other rows pass as they are."""
    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values(_ORDER).groupby(["segment", "t"], sort=False).tail(n)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, new, size = [], [], 0
        for b in batches:
            result = (b["kind"] == "result") & b["value"].notna()
            yield b[~result]
            new.append(b[result])
            size += int(result.sum())
            if size > max(50_000, 2 * sum(len(h) for h in held)):
                held, new, size = [reduce(pd.concat([*held, *new]))], [], 0
        if held or new:
            yield reduce(pd.concat([*held, *new]))

    return step


def adaptive_stream(stream: DataFrame, *, n: int = 8, late_by: str = "0 seconds", shards: int = 16) -> DataFrame:
    """Answer probes against results in time order.

    Input columns: at (timestamp: cutoff of a probe, safe time of a result), kind ('probe' or
    'result'), segment, event_key, day (event day), value. Rows wait in state until the
    watermark has passed them, so a probe sees exactly the results with safe time <= its
    cutoff whatever the arrival order; older arrivals are dropped by the watermark. State
    holds the last n results and the rows still waiting.

    The probes of a segment are dealt to `shards` states, each of which gets the segment's results; of these a task
    forwards the n latest per segment and time, so they stay few when the input lies in time order.
    """
    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        segment = key[0]
        held = dict(zip(_HELD, state.get if state.exists else [[] for _ in _HELD], strict=True))
        new = list(batches)
        of = lambda b, kind, c, t: b.loc[(b["kind"] == kind) & ((kind == "probe") | b["value"].notna()), c].to_numpy(dtype=t)
        both = lambda name, kind, c, t=np.int64: np.concatenate([np.array(held[name], dtype=t), *[of(b, kind, c, t) for b in new]])
        pt, pk = both("pt", "probe", "t"), both("pk", "probe", "event_key")
        results = pd.DataFrame({"t": both("rt", "result", "t"), "d": both("rd", "result", "d"), "event_key": both("rk", "result", "event_key"),
                                "value": both("rv", "result", "value", np.float64)})
        mark = state.getCurrentWatermarkMs() * 1000
        go = pt < mark
        order = np.argsort(pt[go], kind="stable")
        rt, rk = pt[go][order], pk[go][order]
        ready = results[results["t"] < mark].sort_values(_ORDER)
        times, keys, values = ready["t"].to_numpy(), [int(k) for k in ready["event_key"]], [float(v) for v in ready["value"]]
        lk, lv, at = [], [], 0
        mean, used = np.full(len(rt), np.nan), np.zeros(len(rt), dtype=np.int32)
        edges = np.flatnonzero(np.r_[True, rt[1:] != rt[:-1], True]) if len(rt) else np.array([0])
        for a, b in zip(edges[:-1], edges[1:], strict=True):  # probes of one time see one list
            end = int(np.searchsorted(times, rt[a], side="right"))
            lk, lv, at = [*lk, *keys[at:end]][-n:], [*lv, *values[at:end]][-n:], end
            mean[a:b], used[a:b] = (sum(lv) / len(lv) if lv else np.nan), len(lv)
            for i in np.flatnonzero(np.isin(rk[a:b], lk)) if lk else ():  # a probe's own result does not count
                rest = [v for k, v in zip(lk, lv, strict=True) if k != rk[a + i]]
                mean[a + i], used[a + i] = (sum(rest) / len(rest) if rest else np.nan), len(rest)
        wait = results[results["t"] >= mark]
        keep = pd.concat([ready.tail(n), wait])  # the last n and the rows still waiting
        state.update((pt[~go].tolist(), pk[~go].tolist(), *[keep[c].tolist() for c in ("t", "event_key", "d", "value")]))
        due = [int(x.min()) for x in (pt[~go], wait["t"]) if len(x)]
        if due:
            state.setTimeoutTimestamp(max(min(due) // 1000, state.getCurrentWatermarkMs() + 1))
        if len(rt):
            mean = pd.Series(mean, dtype=object).where(used > 0, None)
            yield pd.DataFrame({"event_key": rk, "segment": segment, "t": rt, "trailing_mean": mean, "n_used": used})

    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))  # noqa: E731  no local times in Python
    rows = stream.select(micros("at").alias("t"), "kind", "segment", F.col("event_key").cast("long").alias("event_key"), micros("day").alias("d"),
                         F.col("value").cast("double").alias("value")).mapInPandas(_newest(n), _ROW)
    all_of_them = (F.col("kind") == "result") & F.col("value").isNotNull()
    own = F.array(F.pmod(F.xxhash64("event_key"), F.lit(shards)).cast("int"))
    dealt = rows.withColumns({"at": F.timestamp_micros("t"), "shard": F.explode(F.when(all_of_them, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(own))})
    out = dealt.withWatermark("at", late_by).groupBy("segment", "shard").applyInPandasWithState(
        step, "event_key long, segment string, t long, trailing_mean double, n_used int", _STATE, "append", "EventTimeTimeout")
    return out.select("event_key", "segment", F.timestamp_micros("t").alias("at"), "trailing_mean", "n_used")
