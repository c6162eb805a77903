"""Operator 13: language identification by error-correcting output codes.

Each language gets a codeword; one binary classifier a bit (logistic regression on byte n-grams of the lower-cased letters)
says which side of the bit a text is on. Decoding adds the logistic loss of every bit, weighted by how well that bit's
classifier told the language's own training rows apart, and takes the language with the least sum. A text whose two best
languages lie close together is flagged as ambiguous.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import bytes_of, mix, slices

BUCKETS = 1 << 13
ORDERS = (1, 2, 3)       # bytes in an n-gram
MAX_TRAIN = 2000         # bound of the sample that the classifiers learn from, all languages together
LEAST_SHARE = 20         # rows asked for per language, however many there are
EXHAUSTIVE = 6           # up to so many languages every split of them is a bit
BITS_PER_DOUBLING = 10   # above: random bits per doubling of the languages
PENALTY, STEPS = 1e-4, 80
AMBIGUOUS = 0.2          # least lead of the best language in mean weighted loss
UNKNOWN = "und"

_B = np.arange(256)
_LETTER = ((_B >= 97) & (_B <= 122)) | (_B >= 128)
_LOW = np.where(_LETTER, _B, 32).astype(np.uint8)
_ASCII_LETTER = ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122))
_SALTS = np.arange(max(ORDERS) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_ROWS = 256              # texts whose counts are held as one dense block


def ngram_shares(texts: pa.Array) -> np.ndarray:
    """One row per text: square roots of the shares of its hashed n-grams, so that every row has length 1 (0 without letters).

    Letters are lower-cased, every other ASCII character ends a word; n-grams may hold the blank before or after a word.
    """
    data, at = bytes_of(pc.utf8_lower(texts))
    low = _LOW[data]
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)  # one blank between words
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))[keep]
    low = low[keep].astype(np.uint64)
    out = np.zeros((len(at) - 1) * BUCKETS, np.float32)
    code, n = np.zeros(len(low), np.uint64), len(low)
    for k in ORDERS:
        last = n - k + 1
        if last <= 0:
            break
        code = code[:last] * np.uint64(256) + low[k - 1:]
        inside = owner[:last] == owner[k - 1:]
        if k == 1:
            inside &= low != 32
        bucket = (mix(code[inside] + _SALTS[k]) % np.uint64(BUCKETS)).astype(np.int64)
        out += np.bincount(owner[:last][inside] * BUCKETS + bucket, minlength=len(out)).astype(np.float32)
    out = out.reshape(-1, BUCKETS)
    out /= np.maximum(out.sum(1, keepdims=True), 1)
    return np.sqrt(out, out=out)


def has_letter(texts: pa.Array) -> np.ndarray:
    """True for texts with at least one letter of any script."""
    data, at = bytes_of(texts)
    ascii_letters = np.add.reduceat(_ASCII_LETTER[data], at[:-1], dtype=np.int64) if len(at) > 1 else np.empty(0, np.int64)
    out = ascii_letters > 0
    wide = np.add.reduceat(data >= 128, at[:-1], dtype=np.int64) if len(at) > 1 else out
    for k in np.flatnonzero(~out & (wide > 0)).tolist():
        out[k] = any(c.isalpha() for c in texts[k].as_py())
    return out


def codewords(n: int) -> np.ndarray:
    """A matrix of -1 and 1, one row per language. All splits for few languages, else the random code that keeps rows furthest apart."""
    if n <= 1:
        return np.zeros((n, 0), np.int8)
    if n <= EXHAUSTIVE:
        bits = np.arange(1, 1 << (n - 1))  # the last language is on the 0 side, so no split comes twice
        return np.where((bits[None, :] >> np.arange(n)[:, None]) & 1, 1, -1).astype(np.int8)
    width, best, most = BITS_PER_DOUBLING * math.ceil(math.log2(n)), None, -1
    for seed in range(50):
        code = np.where(np.random.default_rng(seed).random((n, width)) < 0.5, -1, 1).astype(np.int8)
        agree = code.astype(np.int32) @ code.T
        apart = int((width - (agree - np.eye(n, dtype=np.int32) * 2 * width).max()) // 2)
        if apart > most and (np.abs(code.sum(0)) < n).all():
            best, most = code, apart
    return best


def _loss(margin: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -margin)


@dataclass(frozen=True)
class Codebook:
    languages: tuple[str, ...]
    code: np.ndarray      # languages x bits
    weights: np.ndarray   # buckets x bits
    offsets: np.ndarray   # bits
    trust: np.ndarray     # languages x bits, rows add up to 1

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the best language, its probability among all of them, and whether the second best is close."""
        margin = x @ self.weights + self.offsets
        loss = np.stack([(_loss(margin * c) * t).sum(1) for c, t in zip(self.code, self.trust)], axis=1)
        best = loss.argmin(1)
        lead = loss - loss.min(1, keepdims=True)
        odds = np.exp(-lead * self.code.shape[1])
        second = np.sort(lead, axis=1)[:, 1] if loss.shape[1] > 1 else np.full(len(x), np.inf)
        return best, 1 / odds.sum(1), second < AMBIGUOUS


def learn(x: np.ndarray, y: np.ndarray, languages: tuple[str, ...]) -> Codebook:
    """All bits at once by accelerated gradient steps; every language weighs the same whatever its rows."""
    code = codewords(len(languages))
    bits = code.shape[1]
    share = (1 / (np.bincount(y, minlength=len(languages))[y] * len(languages))).astype(np.float32)
    target = (code[y] + 1).astype(np.float32) / 2
    # Rows have length 1, so 1/4 (and 1/4 for the offset) bounds the curvature.
    w, b = np.zeros((x.shape[1], bits), np.float32), np.zeros(bits, np.float32)
    pw, pb, rate, penalty = w, b, np.float32(1 / (0.5 + PENALTY)), np.float32(PENALTY)
    for k in range(STEPS if bits else 0):
        push = np.float32(k / (k + 3))
        vw, vb = w + push * (w - pw), b + push * (b - pb)
        off = (1 / (1 + np.exp(-(x @ vw + vb))) - target) * share[:, None]
        pw, pb = w, b
        w, b = vw - rate * (x.T @ off + penalty * vw), vb - rate * off.sum(0)
    # Trust of a bit for a language: share of the language's rows on the right side, with one wrong row more than there are.
    right = ((x @ w + b) * code[y] > 0).astype(float)
    trust = np.array([(right[y == k].sum(0)) / ((y == k).sum() + 1) for k in range(len(languages))])
    trust = trust / np.maximum(trust.sum(1, keepdims=True), 1e-12)
    return Codebook(languages, code, w, b, trust)


def held_out(key: str = "doc_id") -> Column:
    """Every fifth document by the crc32 of its id; a NULL id is held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_sample(docs: DataFrame, text: str, key: str, lang: str, most: int) -> DataFrame:
    """(lang, text): at most `most` rows that are not held out, about equally many per language, chosen by a hash of id and text."""
    rows = docs.where(~held_out(key)).where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("place"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return rows.select("lang", "text").limit(0)
    quota = max(LEAST_SHARE, most // len(sizes))
    limits = docs.sparkSession.createDataFrame([(k, float(min(1.0, quota / n))) for k, n in sorted(sizes.items())], "of string, part double")
    wanted = rows.join(F.broadcast(limits), F.col("lang") == F.col("of"))  # one row per language
    wanted = wanted.where((F.col("place") / float(2**64) + 0.5) < F.col("part")).select("lang", "text", "place")
    return wanted.orderBy("place").limit(max(most, LEAST_SHARE * len(sizes))).select("lang", "text")


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", most: int = MAX_TRAIN) -> Codebook:
    """Learns from a sample of at most `most` rows (20 a language if that is more); n-grams are counted by Spark over whole texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            for lo in range(0, part.num_rows, _ROWS):
                some = part.slice(lo, _ROWS)
                x = ngram_shares(some.column("text"))
                yield pa.RecordBatch.from_arrays([some.column("lang"), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], ["lang", "x"])

    got = training_sample(docs, text, key, lang, most).mapInArrow(count, "lang string, x binary").toArrow()
    names = np.array(got.column("lang").to_pylist(), dtype=object)
    languages = tuple(sorted(set(names.tolist())))
    if not languages:
        return Codebook((), codewords(0), np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros((0, 0)))
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(-1, BUCKETS).astype(np.float32)
    order = np.lexsort((x.sum(1), names.astype(str)))  # the order in which rows arrive does not matter
    return learn(x[order], np.searchsorted(np.array(languages), names[order].astype(str)), languages)


def language_scores(docs: DataFrame, model: Codebook, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, lang_pred, score (0 to 1), ambiguous.

    A NULL text, one without a letter, and every text when nothing was learned, give `und`, score 0 and not ambiguous. With one
    learned language every other text gets it with score 1. NULL and repeated ids are passed on; of the other columns none is
    read. Texts are read whole.
    """
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            for lo in range(0, part.num_rows, _ROWS):
                some = part.slice(lo, _ROWS)
                texts = some.column("text").fill_null("")
                known = has_letter(texts)
                names, score, close = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts), bool)
                if model.languages and known.any():
                    best, p, near = model.decode(ngram_shares(texts))
                    names[known], score[known], close[known] = np.array(model.languages, object)[best][known], p[known], near[known]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(close)],
                                                 ["doc_id", "lang_pred", "score", "ambiguous"])

    rated = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        rate, "doc_id long, lang_pred string, score double, ambiguous boolean")
    return rated.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def identify_languages(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", most: int = MAX_TRAIN) -> DataFrame:
    """`language_scores` of all rows by a model learned from the rows that are not held out."""
    return language_scores(docs, fit(docs, text, key, lang, most), text, key)
