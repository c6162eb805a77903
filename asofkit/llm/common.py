"""Helpers shared by the training-data operators: table access, bounded Arrow slices, vectorised word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialise, scratch_dir

__all__ = ["materialise", "in_few_files", "broadcast_if_small", "table", "slices", "bytes_of", "word_bounds", "hash_words", "mix", "ngram_hash", "SPACE", "fresh_path",
           "ascii_lower", "row_key", "text_name", "free_name"]

SLICE_BYTES = 2 << 20
MAX_BROADCAST_ROWS = 1 << 21  # 32 MB as two longs a row, 48 MB as three
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Byte classes: True marks a separator.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_few_files(df: DataFrame, rows: int, per_file: int = 50_000) -> DataFrame:
    """A written table of about `rows` rows, in as many files as they fill; for small tables of iterative work."""
    return materialise(df.coalesce(rows // per_file + 1))


def broadcast_if_small(rows: DataFrame) -> DataFrame:
    """A written table of a few numbers per row, with a broadcast hint while its counted rows stay below MAX_BROADCAST_ROWS."""
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST_ROWS else rows


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new folder below the shared folder of the cluster."""
    return f"{scratch_dir(spark)}/{what}/{uuid.uuid4().hex}"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and leaves every other character alone, unlike lower(), which maps all of Unicode.

    A text of ASCII bytes only takes lower(), which has a fast path; both give the same for it.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_key(name: str = "doc_id") -> Column:
    """The id as a join key: NULL becomes the smallest long, so that NULL ids meet each other and come first."""
    return F.coalesce(F.col(name).cast("long"), F.lit(-(2**63)).cast("long"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def text_name(name: str = "text") -> Column:
    """Hash of a text, NULL as empty; with the id it names a row where ids are NULL or repeated."""
    return F.xxhash64(F.coalesce(F.col(name), F.lit("")))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows with about `limit` bytes of text, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, lo = np.cumsum(size.astype(np.int64) + 64), 0
        while lo < batch.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array with a blank after each, and the bounds of the texts (n + 1). NULL is empty."""
    parts = column.cast(pa.binary()).fill_null(b"").to_pylist()
    data = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    return data, np.concatenate([[0], np.cumsum(sizes)])


def word_bounds(data: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word; the array must end with a separator."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[1:] = ~separator[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _weights(n: int, salt: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt)) * _ODD) | np.uint64(1)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0, block: int = 1 << 19) -> np.ndarray:
    """A 64-bit hash per word: bytes times a weight that depends on the place in the word, summed and mixed.

    Works through the words in blocks of about `block` bytes, so that memory does not follow the text.
    """
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    weights = _weights(int((ends - starts).max()), salt)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + block, side="right")))
        first, size = starts[lo:hi], ends[lo:hi] - starts[lo:hi]
        where = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(where, size)
        chars = data[np.repeat(first, size) + place].astype(np.uint64) + np.uint64(1)
        out[lo:hi] = np.add.reduceat(chars * weights[place], where)
        lo = hi
    return mix(out)


def ngram_hash(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of every n consecutive word hashes (empty when there are fewer)."""
    size = len(words) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    weights, out = _weights(n, salt + 7919), np.zeros(size, np.uint64)
    for k in range(n):
        out += mix(words[k:k + size] ^ weights[k]) * weights[k] if n <= 4 else words[k:k + size] * weights[k]
    return mix(out)
