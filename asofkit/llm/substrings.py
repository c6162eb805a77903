"""Operator 10: substring dedup by recompression.

Every text is parsed in rounds: long runs of one word become a run symbol, then twice every symbol takes a side from its name
and adjacent (left, right) symbols merge into a pair symbol. Names are hashes of the content, so all tasks give equal content
the same name without exchanging any, and equal passages get equal symbols except near their ends. Each window of 20 words
picks the symbol with the least name in its middle as anchor, named by the 12 words around it: equal windows pick equal
anchors. Spark then finds the anchor names that more than one text has; only windows with such an anchor are compared, by a
96-bit hash of all their words, and the smallest document that has a window keeps it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import SPACE, bytes_of, hash_words, materialise, mix, ngram_hash, row_key, slices, word_bounds

WINDOW = 20
RUN = 4      # equal words in a row that make a run symbol
MARGIN = 6   # words at either end of a window whose parse may depend on what stands outside; 3 for runs, 1 + 2 for the pair rounds
ROUNDS = 2   # a symbol then has at most 4 words, so the middle 8 words of a window hold at least one whole symbol
CONTEXT = 2 * MARGIN
_TOP = np.uint64(2**64 - 1)


class Parsed:
    """Words of a slice of texts, side by side, with the anchor of every window."""

    def __init__(self, texts: pa.Array):
        data, at = bytes_of(texts)
        starts, ends = word_bounds(data, SPACE)
        self.words = hash_words(data, starts, ends)
        self.first = np.searchsorted(starts, at)  # first word of every text, and the number of words
        self.sizes = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self._windows()

    def _windows(self) -> None:
        n = len(self.words)
        left = np.repeat(self.first[1:], self.sizes) - np.arange(n)  # words from here to the end of the text
        self.start = np.flatnonzero(left >= WINDOW)
        same = np.zeros(n, bool)
        same[1:] = (self.words[1:] == self.words[:-1]) & (self.owner[1:] == self.owner[:-1])
        run_of = np.cumsum(~same) - 1
        long_run = (np.bincount(run_of) >= RUN)[run_of] if n else same
        fourth = same.copy()
        for k in range(1, RUN - 1):
            fourth[k:] &= same[:n - k]
        fourth[:RUN - 1] = False
        upto = np.concatenate([[0], np.cumsum(fourth)])
        self.in_run = upto[self.start + WINDOW] > upto[self.start + RUN - 1]
        p, q, name = self._symbols(np.flatnonzero(~long_run))
        self.key, self.spot = np.zeros(len(self.start), np.uint64), np.full(len(self.start), -1)
        plain = np.flatnonzero(~self.in_run)
        if not len(plain):
            return
        s = self.start[plain]
        lo, hi = np.searchsorted(p, s + MARGIN), np.searchsorted(q, s + WINDOW - MARGIN, side="right") - 1
        best, least = lo.copy(), name[lo]
        for k in range(1, int((hi - lo).max()) + 1):
            here = np.minimum(lo + k, hi)
            better = name[here] < least
            best, least = np.where(better, here, best), np.where(better, name[here], least)
        around = ngram_hash(self.words, CONTEXT, salt=3)
        self.key[plain], self.spot[plain] = mix(around[p[best] - MARGIN] ^ least), p[best]

    def _symbols(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, end and name of the symbols after the pair rounds. Run symbols part their neighbours and are left out."""
        q, name, owner = p + 1, self.words[p], self.owner[p]
        for r in range(ROUNDS):
            is_left = (mix(name + np.uint64(101 + r)) & np.uint64(1)).astype(bool)
            joins = np.zeros(len(p), bool)
            joins[:-1] = is_left[:-1] & ~is_left[1:] & (q[:-1] == p[1:]) & (owner[:-1] == owner[1:])
            at = np.flatnonzero(joins)
            name = name.copy()
            name[at] = mix(name[at] * np.uint64(0x9E3779B97F4A7C15) + mix(name[at + 1] + np.uint64(11 + r)))
            q = q.copy()
            q[at] = q[at + 1]
            keep = np.ones(len(p), bool)
            keep[at + 1] = False
            p, q, name, owner = p[keep], q[keep], name[keep], owner[keep]
        return p, q, name

    def tagged(self, owner: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Hashes that differ from text to text of the slice, to look values up text by text."""
        return mix(values ^ mix(owner.astype(np.uint64) + np.uint64(5)))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, key) of the anchors, each key once per text."""
        at = np.flatnonzero(~self.in_run)
        owner, key = self.owner[self.start[at]], self.key[at]
        _, once = np.unique(self.tagged(owner, key), return_index=True)
        return owner[once], key[once]

    def candidates(self, alone: pa.ListArray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows that another one may equal: (first word, hash, second hash, whether the first such in its text)."""
        owner = self.owner[self.start]
        tag = self.tagged(owner, self.key)
        # A key that comes back in its own text at another place counts as shared.
        _, fresh = np.unique(self.spot, return_index=True)
        spots, times = np.unique(tag[fresh[~self.in_run[fresh]]], return_counts=True)
        single = np.intersect1d(spots[times == 1], self._listed(alone))
        may = live[owner] & (self.in_run | ~np.isin(tag, single))
        s = self.start[may]
        h1, h2 = ngram_hash(self.words, WINDOW, salt=1), ngram_hash(self.words, WINDOW, salt=2)
        h1, h2 = (h1[s], h2[s]) if len(s) else (np.empty(0, np.uint64),) * 2
        _, at = np.unique(self.tagged(self.owner[s], h1), return_index=True)
        first = np.zeros(len(s), bool)
        first[at] = True
        return s, h1, h2, first

    def _listed(self, lists: pa.ListArray) -> np.ndarray:
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return self.tagged(np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy().view(np.uint64))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        live = part.filter(pc.invert(part.column("copy")))
        owner, key = Parsed(live.column("text")).anchors()
        yield pa.RecordBatch.from_arrays([live.column("id").take(pa.array(owner)), _signed(key)], ["id", "key"])


def _candidates(part: pa.RecordBatch) -> tuple[Parsed, tuple]:
    parsed = Parsed(part.column("text"))
    return parsed, parsed.candidates(part.column("alone"), ~part.column("copy").to_numpy(zero_copy_only=False))


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        parsed, (s, h1, h2, first) = _candidates(part)
        ids = part.column("id").take(pa.array(parsed.owner[s[first]]))
        yield pa.RecordBatch.from_arrays([ids, _signed(h1[first]), pa.array((h2[first] >> np.uint64(32)).astype(np.uint32).view(np.int32))], ["id", "h1", "h2"])


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        parsed, (s, h1, _, first) = _candidates(part)
        own = parsed._listed(part.column("own"))
        gone = s[~first | ~np.isin(parsed.tagged(parsed.owner[s], h1), own)]
        edge = np.zeros(len(parsed.words) + 1, np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + WINDOW, -1)
        keep = np.cumsum(edge[:-1]) == 0
        copy = part.column("copy").to_numpy(zero_copy_only=False)
        keep[np.repeat(copy & (parsed.sizes >= WINDOW), parsed.sizes)] = False
        removed = parsed.sizes - np.bincount(parsed.owner[keep], minlength=len(parsed.sizes))
        texts = []
        for k, raw in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
            words = (raw or b"").split()
            texts.append(b" ".join(compress(words, keep[parsed.first[k]:parsed.first[k + 1]].tolist()) if removed[k] else words))
        yield pa.RecordBatch.from_arrays(
            [part.column("id"), pa.array(parsed.sizes), pa.array(removed), pa.array(texts, pa.binary()).cast(pa.string())],
            ["id", "n_words", "n_removed", "kept"])


def _kept_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _kept_rows(batches):
        digest = [hashlib.sha256(x).hexdigest() for x in part.column("kept").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(digest, pa.string())], ["id", "n_words", "n_removed", "kept_sha256"])


def _with_copies(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(id, text, copy): copy marks rows whose whole text a smaller id has. Dealt by id; all later steps use that exchange."""
    rows = docs.select(row_key(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = rows.select("id", F.md5(F.col("text").cast("binary")).alias("name"))
    # Read back from storage, both sides of the next join are plain exchanges, so AQE can split a hot text.
    heads = materialise(named.groupBy("name").agg(F.min("id").alias("head"), F.max("id").alias("tail")).where("head <> tail"))
    later = named.join(heads, "name").where("id <> head").groupBy("id").agg(F.collect_set("name").alias("names"))
    marked = rows.join(later, "id", "left")
    copy = F.when(F.col("names").isNotNull(), F.array_contains("names", F.md5(F.col("text").cast("binary")))).otherwise(F.lit(False))
    return marked.select("id", "text", copy.alias("copy"))


def _run(docs: DataFrame, text: str, key: str, last, columns: str) -> DataFrame:
    rows = _with_copies(docs, text, key)
    names = rows.mapInArrow(_anchor_rows, "id long, key long")
    alone = names.groupBy("key").agg(F.min("id").alias("id"), F.max("id").alias("most")).where("id = most")
    alone = alone.groupBy("id").agg(F.collect_list("key").alias("alone"))
    known = rows.join(alone, "id", "left")
    windows = known.mapInArrow(_window_rows, "id long, h1 long, h2 int")
    own = windows.groupBy("h1", "h2").agg(F.min("id").alias("id")).groupBy("id").agg(F.collect_list("h1").alias("own"))
    out = known.join(own, "id", "left").mapInArrow(last, f"id long, n_words long, n_removed long, {columns}")
    return out.withColumn("doc_id", F.when(F.col("id") != -(2**63), F.col("id"))).drop("id")


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept (the words that stay, joined by one blank).

    A word goes when a window of 20 words covers it whose words also start earlier: in a smaller id, or before in the same
    text. Windows are judged on the input. Words are runs of anything but ASCII white space. NULL texts have no words. A NULL
    id is smaller than any other. Rows that share an id are one document given twice: neither comes before the other. Other
    columns are not read. A text is held whole by one task; nothing else is.
    """
    return _run(docs, text, key, _kept_rows, "kept string").select("doc_id", "n_words", "n_removed", "kept")


def repeat_digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`remove_repeats` with the SHA-256 of the kept words in their place."""
    return _run(docs, text, key, _kept_digests, "kept_sha256 string").select("doc_id", "n_words", "n_removed", "kept_sha256")
