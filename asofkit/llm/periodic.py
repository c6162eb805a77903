"""Operator 12: periodic runs of words, found through string synchronising sets.

At scale t = 4, 8, 16 .. a word position i is kept when the least hash of the t-word stretches that start in [i, i + t] sits at
i or at i + t. Whether a position is kept depends on the 2t words from it alone, so a run of period q in [t, 2t) keeps the same
positions in every period, at least one per t words; two neighbouring kept positions with equal contexts q apart propose the
period q, and comparing words both ways from there gives the run. Stretches with a period of at most t/4 take no part, since
their hashes repeat: they lie in runs that a smaller scale has found. Periods 1 to 3 have no smaller scale and are read off
the neighbours that agree. Everything happens beside the scan of a text; nothing shuffles.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SPACE, bytes_of, hash_words, mix, slices, word_bounds

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
SMALL = (1, 2, 3)      # periods below the smallest scale
PLAIN = 1 << 63        # hash of a stretch that takes no part lies above all others
_ODD = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
          "collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed string")
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")]
                   + [(n, pa.string()) for n in ("runs_sha256", "collapsed_sha256")]
                   + [("runs", pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))), ("collapsed", pa.string())])


def repeated_tail(key: int | None, n: int) -> np.ndarray | None:
    """Where each of a text's n words is taken from when its key asks for a periodic tail, else None.

    h = crc32 of the decimal key; with h % 10 = 0 the words from a = (h // 10) % n repeat with period 1 + (n - a) // (3 + (h // 10) % 8).
    """
    if key is None or not n:
        return None
    h = zlib.crc32(str(key).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def _least_ahead(x: np.ndarray, size: int) -> np.ndarray:
    """Least of the `size` values from every place on, by running minima inside blocks of that size."""
    n = len(x)
    padded = np.full(-(-(n + size) // size) * size, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, size)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[size - 1:n + size - 1])


def _agreeing(w: np.ndarray, lo: int, hi: int, i: int, q: int) -> tuple[int, int]:
    """The longest [s, e) around [i, i + q] inside [lo, hi) whose words agree with those q further."""
    end, step = i, 64
    while end + q < hi:
        top = min(end + step, hi - q)
        bad = np.flatnonzero(w[end:top] != w[end + q:top + q])
        if len(bad):
            end += int(bad[0])
            break
        end, step = top, step * 2
    start, step = i, 64
    while start > lo:
        low = max(start - step, lo)
        bad = np.flatnonzero(w[low:start] != w[low + q:start + q])
        if len(bad):
            start = low + int(bad[-1]) + 1
            break
        start, step = low, step * 2
    return start, end + q


def _small_runs(w: np.ndarray, owner: np.ndarray, q: int) -> np.ndarray:
    """Rows (start, end, q) of all stretches with smallest period q <= 3 that are at least 4 q long."""
    if len(w) <= q:
        return np.empty((0, 3), np.int64)
    flag = np.zeros(len(w) - q + 2, np.int8)
    flag[1:-1] = (w[q:] == w[:-q]) & (owner[q:] == owner[:-q])
    step = np.diff(flag)
    s, e = np.flatnonzero(step == 1), np.flatnonzero(step == -1) + q
    keep = e - s >= LEAST_EXPONENT * q
    s, e = s[keep], e[keep]
    if q > 1:  # a smaller period of so long a stretch divides q, so it is 1 and all words are equal
        same = w[s] == w[s + 1] if q == 2 else (w[s] == w[s + 1]) & (w[s] == w[s + 2])
        s, e = s[~same], e[~same]
    return np.column_stack([s, e, np.full(len(s), q)]).astype(np.int64)


def _covered(n: int, runs: np.ndarray, t: int) -> np.ndarray:
    """Places where t words with a period of at most t/4 start."""
    some = runs[(runs[:, 2] * LEAST_EXPONENT <= t) & (runs[:, 1] - runs[:, 0] >= t)]
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, some[:, 0], 1)
    np.add.at(mark, some[:, 1] - t + 1, -1)
    return np.cumsum(mark[:-1]) > 0


def find_runs(w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs of at least four periods; `w` holds the words' hashes, `at` the bounds of the texts.

    Runs never cross a text; the places are those in `w`. By start, then period.
    """
    size = np.diff(at)
    owner = np.repeat(np.arange(len(size)), size)
    runs = [_small_runs(w, owner, q) for q in SMALL]
    t = SMALL[-1] + 1
    place, end = np.arange(len(w)), at[1:][owner] if len(owner) else owner
    name = w  # hash of the t words from each place, garbage where the text ends before
    for k in (1, 2):
        name = _doubled(name, k)
    while True:
        long = size >= LEAST_EXPONENT * t
        if not long.any():
            break
        if not long[owner].all():  # texts too short for this scale leave
            stay = long[owner]
            place, end, name, owner = place[stay], end[stay], name[stay], owner[stay]
        n = len(place)
        # Runs found so far, in the numbering of the texts that are left.
        known = np.concatenate(runs)
        known = known[long[np.searchsorted(at, known[:, 0], side="right") - 1]]
        shift = np.searchsorted(place, known[:, 0])
        local = np.column_stack([shift, shift + known[:, 1] - known[:, 0], known[:, 2]])
        wide = _doubled(name, t)
        label = np.where(_covered(n, local, t), np.uint64(PLAIN), name >> np.uint64(1))
        least = _least_ahead(label, t + 1)
        other = np.full(n, np.uint64(PLAIN))
        other[:n - t] = label[t:]
        kept = np.flatnonzero((least < PLAIN) & ((least == label) | (least == other)) & (place + 2 * t <= end))
        order = np.lexsort((kept, wide[kept]))
        i, context = kept[order], wide[kept[order]]
        gap = np.diff(i)
        near = np.flatnonzero((context[1:] == context[:-1]) & (gap >= t) & (gap < 2 * t) & (owner[i[1:]] == owner[i[:-1]]))
        proposed = np.column_stack([gap[near], place[i[near]]])
        found, done = [], (0, -1, -1)
        for q, p in proposed[np.lexsort((proposed[:, 1], proposed[:, 0]))].tolist():
            if q == done[0] and done[1] <= p and p + q < done[2]:
                continue  # inside the stretch just compared
            k = int(np.searchsorted(at, p, side="right")) - 1
            s, e = _agreeing(w, int(at[k]), int(at[k + 1]), p, q)
            done = (q, s, e)
            if e - s >= LEAST_EXPONENT * q:
                found.append((s, e, q))
        if found:
            runs.append(np.array(found, np.int64))
        name, t = wide, 2 * t
    out = np.concatenate(runs)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _doubled(name: np.ndarray, t: int) -> np.ndarray:
    """Hashes of 2t words from those of t words; the last t places hold garbage."""
    further = np.zeros_like(name)
    if len(name) > t:
        further[:-t] = name[t:]
    return mix(name * _ODD + mix(further ^ np.uint64(t)))


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        texts, keys = part.column("text"), part.column("doc_id").to_pylist()
        data, bounds = bytes_of(texts)
        starts, ends = word_bounds(data, SPACE)
        w = hash_words(data, starts, ends)
        at = np.searchsorted(starts, bounds)
        tails = {}
        for k, key in enumerate(keys):
            place = repeated_tail(key, int(at[k + 1] - at[k]))
            if place is not None:
                tails[k] = place
                w[at[k]:at[k + 1]] = w[at[k]:at[k + 1]][place]
        runs = find_runs(w, at)
        runs = runs[runs[:, 1] - runs[:, 0] >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * runs[:, 2])]
        mine = np.searchsorted(runs[:, 0], at)
        rows = []
        for k, raw in enumerate(texts.cast(pa.binary()).fill_null(b"").to_pylist()):
            words = raw.split()
            if k in tails:
                words = [words[j] for j in tails[k].tolist()]
            own = runs[mine[k]:mine[k + 1]] - np.array([at[k], at[k], 0])
            found = [(s, e - s, q) for s, e, q in own.tolist()]
            if found:
                gone = np.zeros(len(words) + 1, np.int32)
                np.add.at(gone, own[:, 0] + own[:, 2], 1)
                np.add.at(gone, own[:, 1], -1)
                words = [words[j] for j in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
            best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
            collapsed = b" ".join(words)
            told = "".join("%d,%d,%d\n" % r for r in found).encode()
            rows.append((keys[k], len(found), *(best or (None, None, None)), best and best[1] * 1000 // best[2], _sha(told), _sha(collapsed),
                         [{"start": s, "length": n, "period": q} for s, n, q in found], collapsed.decode("utf-8", "replace")))
        columns = list(zip(*rows)) or [()] * len(_ARROW)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: doc_id, n_runs, the longest run (start, length, period, exponent_milli), digests, `runs` and `collapsed`.

    A run is a stretch of words with smallest period q, at least max(6, 4 q) long, that no neighbouring word prolongs. `collapsed`
    keeps the first q words of every run. A NULL or empty text has no words and no run (four NULLs; the digests are those of
    empty strings). A NULL id is passed on and its text is taken as it is; rows that repeat an id are judged one by one; other
    columns are not read. Words are compared by a 64-bit hash inside one text. A text is read whole, in memory that grows with
    its length, once per scale.
    """
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_scan, SCHEMA)


def run_digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
