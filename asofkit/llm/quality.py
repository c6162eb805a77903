"""Operator 6: quality classifier by regularised quadratic discriminant analysis.

Every text becomes a short vector of transformed statistics (sizes as logarithms, shares as square roots). Spark sums the
class means and centred cross products of the labelled rows; the driver shrinks two small covariances towards their
diagonal and the pooled covariance and factors them. A score is the difference of the two Gaussian log densities, from
Mahalanobis distances through the cached Cholesky factors, with the class shares as priors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, bytes_of, hash_words, materialise, row_key, slices, text_name, word_bounds

FEATURES = ("log_words", "upper", "symbols", "digits", "log_word_size", "word_spread", "bare_symbols", "distinct",
            "stops", "commas", "wide", "lines")
SHRINK_POOLED = 0.1    # share of the pooled covariance in each class covariance
SHRINK_DIAGONAL = 0.05  # share of its own diagonal
FLOOR = 1e-4           # least variance of a feature
THRESHOLD = 0.7

_B = np.arange(256)
_UPPER = (_B >= 65) & (_B <= 90)
_LETTER = _UPPER | ((_B >= 97) & (_B <= 122)) | (_B >= 128)
_DIGIT = (_B >= 48) & (_B <= 57)
_STOP, _COMMA, _WIDE, _LINE = np.isin(_B, [46, 63]), _B == 44, _B >= 192, _B == 10
_SYMBOL = ~(_LETTER | _DIGIT | SPACE | _STOP | _COMMA)
_ALNUM = (_LETTER | _DIGIT).astype(np.uint8)

SCHEMA = "doc_id long, text_name long, x array<double>"


def _distinct_share(owner: np.ndarray, hashes: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    first = np.ones(len(o), bool)
    first[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    return np.bincount(o[first], minlength=n) / np.maximum(total, 1)


def features(texts: pa.Array) -> np.ndarray:
    """One row of statistics per text; an empty or NULL text gives zeros."""
    data, at = bytes_of(texts)
    n, size = len(at) - 1, np.maximum(np.diff(at) - 1, 1)
    count = lambda kind: np.add.reduceat(kind[data], at[:-1], dtype=np.int64) if n else np.empty(0, np.int64)
    upper, letters, digits, symbols = count(_UPPER), count(_LETTER), count(_DIGIT), count(_SYMBOL)
    starts, ends = word_bounds(data, SPACE)
    owner, length = np.searchsorted(at, starts, side="right") - 1, ends - starts
    words = np.bincount(owner, minlength=n)
    some = np.maximum(words, 1)
    mean = np.bincount(owner, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(owner, length.astype(float) ** 2, n) / some - mean ** 2, 0))
    bare = np.add.reduceat(_ALNUM[data], starts, dtype=np.int64) == 0 if len(starts) else np.empty(0, bool)
    line_break = _LINE.copy()
    line_break[32] = False
    # The blank after a text ends its last line as well.
    cut = data.copy()
    cut[at[1:] - 1] = 10
    lines = np.bincount(np.searchsorted(at, word_bounds(cut, line_break)[0], side="right") - 1, minlength=n)
    distinct_words = _distinct_share(owner, hash_words(data, starts, ends), n, words)
    root = lambda part, whole: np.sqrt(part / np.maximum(whole, 1))
    return np.column_stack([
        np.log1p(words), root(upper, letters), root(symbols, size), root(digits, size), np.log1p(mean), np.log1p(spread),
        root(np.bincount(owner, bare, n), some), np.where(words > 0, distinct_words ** 2, 0),
        root(count(_STOP), some), root(count(_COMMA), some), root(count(_WIDE), size), root(lines, some)])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        x = features(part.column("text"))
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_name"), values], ["doc_id", "text_name", "x"])


def text_statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), text_name(text).alias("text_name"), F.col(text).alias("text")).mapInArrow(_measure, SCHEMA)


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2


@dataclass(frozen=True)
class Discriminant:
    means: np.ndarray      # 2 x k
    inverses: np.ndarray   # 2 x k x k: inverted Cholesky factors
    offsets: np.ndarray    # log prior less log determinant, per class

    def score(self, x: np.ndarray) -> np.ndarray:
        value = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.inverses[c].T
            value.append(self.offsets[c] - 0.5 * np.einsum("ij,ij->i", z, z))
        return 1 / (1 + np.exp(np.clip(value[0] - value[1], -50, 50)))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """Learns from the rows of `stats` with a 0/1 label that are not held out. Sums are taken by Spark over all of them.

    A class without rows takes the mean and covariance of the other; without any labels every score is 0.5.
    """
    k = len(FEATURES)
    known = labels.select(row_key().alias("__id"), F.col(label).cast("int").alias("__y")).where(f"`{label}` in (0, 1) and doc_id is not null")
    rows = materialise(stats.where(~held_out()).join(known, row_key() == F.col("__id")).select("__y", "x"))
    x = [F.col("x")[i] for i in range(k)]
    first = {r[0]: r[1:] for r in rows.groupBy("__y").agg(F.count(F.lit(1)), *[F.avg(c) for c in x]).collect()}
    if not first:
        return Discriminant(np.zeros((2, k)), np.zeros((2, k, k)), np.zeros(2))
    n = np.array([first.get(c, [0])[0] for c in (0, 1)], float)
    means = np.array([first[c][1:] if c in first else first[1 - c][1:] for c in (0, 1)])
    centre = lambda i: x[i] - F.when(F.col("__y") == 0, float(means[0][i])).otherwise(float(means[1][i]))
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    second = {r[0]: r[1:] for r in rows.groupBy("__y").agg(*[F.avg(centre(i) * centre(j)) for i, j in pairs]).collect()}
    cov = np.zeros((2, k, k))
    for c, values in second.items():
        for (i, j), v in zip(pairs, values):
            cov[c, i, j] = cov[c, j, i] = v
    for c in (0, 1):
        if not n[c]:
            cov[c] = cov[1 - c]
    pooled = (cov * np.maximum(n, 1)[:, None, None]).sum(0) / np.maximum(n, 1).sum()
    inverses, offsets = [], []
    for c in (0, 1):
        s = (1 - SHRINK_POOLED - SHRINK_DIAGONAL) * cov[c] + SHRINK_POOLED * pooled + SHRINK_DIAGONAL * np.diag(np.diag(cov[c])) + FLOOR * np.eye(k)
        factor = np.linalg.cholesky(s)
        inverses.append(np.linalg.inv(factor))
        offsets.append(np.log(max(n[c], 1) / max(n.sum(), 1)) - np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(inverses), np.array(offsets))


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", *, named: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= 0.7).

    NULL texts count as empty; an empty text gets the score of its zero vector. Ids, languages, sources and labels are no
    inputs of a score. `named` adds text_name, the hash of the text. Rows of `labels` without a 0/1 label or id are ignored, repeated ones count each time.
    """
    stats = materialise(text_statistics(docs, text, key))
    model = fit(stats, labels)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_name"), pa.array(model.score(x))], ["doc_id", "text_name", "score"])

    scored = stats.mapInArrow(rate, "doc_id long, text_name long, score double")
    return scored.select("doc_id", *["text_name"] * named, held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
