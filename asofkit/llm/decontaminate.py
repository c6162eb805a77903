"""Operator 8: benchmark decontamination with an FM-index per training shard.

A shard is a run of documents. Its words become symbols: words of the test vocabulary keep a number, all others part the text,
and stretches shorter than the shortest test phrase are left out, as no phrase fits in. Over the rest a suffix array gives the
Burrows-Wheeler transform, held as a wavelet matrix. All phrases are searched backwards at once by rank queries, occurrences
are located by walking to sampled suffix positions, and the spans they cover are merged per document.

Test phrases go to every task in blocks of bounded size; more blocks mean more passes over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bytes_of, hash_words, row_key, slices, text_name, word_bounds

PHRASE = 13            # words of a window; an item of fewer words is one window
SHARD_BYTES = 4 << 20
SAMPLE = 8             # every so many positions of the text keep their suffix position
BLOCK_BYTES = 8 << 20  # most test text sent to the tasks at once
RATIO = 20             # contaminated: RATIO * hit words >= words

_B = np.arange(256)
SEPARATOR = ~(((_B >= 48) & (_B <= 57)) | ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122)) | (_B >= 128))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

SCHEMA = "id long, h long, n_words long, items array<string>, spans array<struct<start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts and the first word of each text (n + 1)."""
    data, at = bytes_of(texts)
    data = _LOWER[data]
    starts, ends = word_bounds(data, SEPARATOR)
    return hash_words(data, starts, ends), np.searchsorted(starts, at)


@dataclass(frozen=True)
class Phrases:
    vocabulary: np.ndarray            # sorted word hashes; a word's symbol is its place + 1
    windows: dict[int, np.ndarray]    # length -> distinct windows of that length, as symbols
    items: dict[int, list[set[str]]]  # length -> names of the items of each window


def build_phrases(names: list[str], texts: list[str | None]) -> Phrases:
    words, first = _words(pa.array(texts, pa.string()))
    vocabulary, symbol = np.unique(words, return_inverse=True)
    symbol = (symbol + 1).astype(np.int64)
    held: dict[int, dict[tuple, set[str]]] = {}
    for k, name in enumerate(names):
        own = symbol[first[k]:first[k + 1]]
        size = min(len(own), PHRASE)
        for s in range(len(own) - size + 1 if size else 0):
            held.setdefault(size, {}).setdefault(tuple(own[s:s + size].tolist()), set()).add(name)
    return Phrases(vocabulary, {n: np.array(list(w), np.int64) for n, w in held.items()}, {n: list(w.values()) for n, w in held.items()})


class WaveletMatrix:
    """Rank queries over a sequence of small numbers, one bit vector with prefix counts per bit."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            bit = ((values >> b) & 1).astype(bool)
            self.levels.append((b, np.concatenate([[0], np.cumsum(bit)]), int((~bit).sum())))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before the position `ends`."""
        lo, hi = np.zeros_like(ends), ends
        for b, ones, zeros in self.levels:
            up = ((symbols >> b) & 1).astype(bool)
            lo, hi = np.where(up, zeros + ones[lo], lo - ones[lo]), np.where(up, zeros + ones[hi], hi - ones[hi])
        return hi - lo


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling. Zeros part the text: each counts as a symbol of its own, by position."""
    n, gaps, span = len(text), text == 0, 1
    rank = np.where(gaps, np.cumsum(gaps) - 1, text + gaps.sum())
    while True:
        follow = np.zeros(n, np.int64)
        follow[:n - span] = rank[span:] + 1
        key = rank * (int(rank.max()) + 2) + follow
        order = np.argsort(key, kind="stable")
        here = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(here[1:] != here[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        span *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int):
        order = suffix_array(text)
        self.last = text[order - 1]  # the text ends with a zero, which stands before its first symbol as well
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.tree = WaveletMatrix(self.last, max(1, int(symbols).bit_length()))
        opening = np.concatenate([[0], text[:-1]]) == 0
        kept = (order % SAMPLE == 0) | opening[order]
        self.sampled = np.where(kept, order, -1)

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of the suffixes that begin with each window, by backward search."""
        lo, hi = self.before[windows[:, -1]], self.before[windows[:, -1] + 1]
        live = np.flatnonzero(hi > lo)
        for k in range(windows.shape[1] - 2, -1, -1):
            c = windows[live, k]
            lo[live], hi[live] = self.before[c] + self.tree.rank(c, lo[live]), self.before[c] + self.tree.rank(c, hi[live])
            live = live[hi[live] > lo[live]]
        hi = np.maximum(hi, lo)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back until a sampled one. Sampling covers every stretch's first symbol."""
        out, walk, steps, at = np.empty(len(rows), np.int64), np.arange(len(rows)), 0, rows
        while len(walk):
            known = self.sampled[at]
            done = known >= 0
            out[walk[done]] = known[done] + steps
            walk, at = walk[~done], at[~done]
            c = self.last[at]
            at, steps = self.before[c] + self.tree.rank(c, at), steps + 1
        return out


def shard_hits(texts: pa.Array, phrases: Phrases) -> tuple[np.ndarray, list[list[str]], list[list[tuple[int, int]]]]:
    """(words per text, names of the items found per text, merged spans of hit words per text) of one shard."""
    words, first = _words(texts)
    rows = len(first) - 1
    items: list[set[str]] = [set() for _ in range(rows)]
    edge = np.zeros(len(words) + 1, np.int64)
    if phrases.windows and len(words):
        place = np.minimum(np.searchsorted(phrases.vocabulary, words), len(phrases.vocabulary) - 1)
        symbol = np.where(phrases.vocabulary[place] == words, place + 1, 0)
        # Stretches of known words inside one text, long enough for the shortest phrase.
        inside = symbol > 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[first[:-1][first[:-1] < len(words)]] |= inside[first[:-1][first[:-1] < len(words)]]
        stretch = np.cumsum(begins) - 1
        size = np.bincount(stretch[inside], minlength=int(begins.sum()))
        keep = np.flatnonzero(inside)
        keep = keep[size[stretch[keep]] >= min(phrases.windows)]
        if len(keep):
            number = stretch[keep]
            gap = np.concatenate([[0], np.cumsum(np.diff(number) > 0)])
            text = np.zeros(len(keep) + int(gap[-1]) + 1, np.int64)
            where = np.zeros(len(text), np.int64)
            text[np.arange(len(keep)) + gap], where[np.arange(len(keep)) + gap] = symbol[keep], keep
            index = FMIndex(text, len(phrases.vocabulary))
            for n, windows in phrases.windows.items():
                lo, hi = index.search(windows)
                times = hi - lo
                window = np.repeat(np.arange(len(windows)), times)
                found = np.repeat(lo, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                at = where[index.locate(found)]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + n, -1)
                owner = np.searchsorted(first, at, side="right") - 1
                for o, w in np.unique(np.column_stack([owner, window]), axis=0).tolist():
                    items[o] |= phrases.items[n][w]
    hit = np.cumsum(edge[:-1]) > 0
    change = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
    for b, e in zip(begin.tolist(), end.tolist()):
        o = int(np.searchsorted(first, b, side="right")) - 1
        while b < e:  # hits of neighbouring texts can touch
            stop = min(e, int(first[o + 1]))
            if stop > b:
                spans[o].append((b - int(first[o]), stop - int(first[o])))
            b, o = stop, o + 1
    return np.diff(first), [sorted(x) for x in items], spans


def _scan(rows: DataFrame, phrases: Phrases) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(phrases)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SHARD_BYTES):
            sizes, items, spans = shard_hits(part.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("h"), pa.array(sizes), pa.array(items, pa.list_(pa.string())),
                 pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], _SPANS)], ["id", "h", "n_words", "items", "spans"])

    return rows.mapInArrow(scan, SCHEMA)


def _merged(spans):
    """Sorted, disjoint spans of an array of spans that may overlap."""
    def add(done, s):
        last = F.element_at(done, -1)
        touching = (F.size(done) > 0) & (s["start"] <= last["end"])
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(touching, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(s)))
    return F.aggregate(F.array_sort(spans), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"), add)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", *, named: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_hit, items (names of the items found, sorted as strings), spans (hit words).

    Words are runs of digits, letters and anything beyond ASCII, lower-cased A-Z. A window is 13 words of an item; an item of
    fewer, but not none, is one window. NULL texts have no words; a NULL item id is named "null", items of equal id are one.
    An empty benchmark hits nothing. Other columns are not read. Repeated rows are judged row by row; `named` adds
    text_name, the hash of the text.
    """
    rows = docs.select(row_key(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("id", "text", text_name().alias("h"))
    tests = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), F.col("text")).where("text is not null")
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    found = None
    for b in range(blocks):
        block = tests.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == b).collect()
        part = _scan(rows, build_phrases([r[0] for r in block], [r[1] for r in block]))
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        found = found.groupBy("id", "h").agg(
            F.max("n_words").alias("n_words"), _merged(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), (F.count(F.lit(1)) / blocks).cast("int").alias("times"))
        found = found.withColumn("_", F.explode(F.sequence(F.lit(1), "times")))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(F.when(F.col("id") != -(2**63), F.col("id")).alias("doc_id"), *[F.col("h").alias("text_name")] * named, "n_words", hit.alias("n_hit"), "items", "spans")


def with_verdict(found: DataFrame) -> DataFrame:
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (RATIO * F.col("n_hit") >= F.col("n_words")))


def contamination_digest(found: DataFrame) -> DataFrame:
    return with_verdict(found).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
