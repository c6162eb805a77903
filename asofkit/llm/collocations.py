"""Operator 11: phrase collocations by the stripes pattern.

Every word is a prefix that keys a two-level associative counter: the words that follow it and, below each of them, the words
that follow the pair (0 where the piece ends). Tasks build such stripes for their slice and send them as packets; stripes of a
word are merged elementwise. A merged stripe gives the extensions (counts of three words), the totals of its pairs and, per
pair, the count of its most frequent extension, which decides whether the longer phrase subsumes the pair.

Words that make up at least 1/HOT_SHARE of all words (so at most HOT_SHARE of them) have their stripe spread over all parts by
the next word, and a pair of two such words by the word after it; totals of those pairs are added up at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bytes_of, hash_words, materialise, mix, slices, word_bounds

LEAST_COUNT = 10
SUBSUMED = 50          # percent of a phrase's occurrences that lie inside one longer phrase
TOP = 2000
SCALE = 1_000_000
HOT_SHARE = 2000
UNKNOWN = "und"
PARTS_PER_PARTITION = 4
WORD_SLICE, SLICE = 8 << 20, 4 << 20  # bytes of text whose words, and whose stripes, are merged before they leave a task

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_HIGH = np.uint64(0xFFFFFFFF00000000)

WORDS = "lang string, word string, id long, n long"
PACKET = "part int, first array<long>, pairs array<int>, second array<long>, width array<int>, third array<long>, n array<int>"
GRAMS = "w1 long, w2 long, w3 long, f long, extension long"


def words_of(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Lower-cased bytes, first byte and end of every word, its row, the number of its piece and its id (of language and spelling)."""
    data, at = bytes_of(part.column("text"))
    data = _LOW[data]
    starts, ends = word_bounds(data, _GAP)
    doc = np.repeat(np.arange(part.num_rows), np.diff(np.searchsorted(starts, at)))
    piece = np.searchsorted(np.flatnonzero(_BREAK[data]), starts) + doc  # breaks before the word, and one more per text
    names, place = np.unique(part.column("lang").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    raw, bounds = bytes_of(pa.array(names.tolist(), pa.string()))
    tongue = hash_words(raw, bounds[:-1], bounds[1:], salt=11)[place]
    return data, starts, ends, doc, piece, mix(hash_words(data, starts, ends) ^ tongue[doc])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, limit=WORD_SLICE):
        data, starts, ends, doc, _, ids = words_of(part)
        names, at, n = np.unique(ids, return_index=True, return_counts=True)
        raw, spans = data.tobytes(), zip(starts[at].tolist(), ends[at].tolist())
        yield pa.RecordBatch.from_arrays([
            part.column("lang").take(pa.array(doc[at])), pa.array([raw[s:e] for s, e in spans], pa.binary()).cast(pa.string(), safe=False),
            pa.array(names.view(np.int64)), pa.array(n)], ["lang", "word", "id", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, id, f): the words with at least LEAST_COUNT occurrences, and per language one row without a word for all others."""
    counts = docs.mapInArrow(_count_words, WORDS).groupBy("lang", "word", "id").agg(F.sum("n").alias("f"))
    often = F.col("f") >= LEAST_COUNT
    return counts.groupBy("lang", F.when(often, F.col("word")).alias("word"), F.when(often, F.col("id")).alias("id")).agg(F.sum("f").alias("f"))


def merge(w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal (w1, w2, w3) merged elementwise, each pair of first words in one stretch; n is added up."""
    if not len(w1):
        return w1, w2, w3, n
    key = (w1 & _HIGH) | (w2 >> np.uint64(32))
    order = np.lexsort((w3, key))
    a, b, c, k = w1[order], w2[order], w3[order], key[order]
    pair = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    if (pair & (k[1:] == k[:-1])).any():  # two pairs with equal upper halves
        order = np.lexsort((w3, w2, w1))
        a, b, c = w1[order], w2[order], w3[order]
        pair = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    new = np.concatenate([[0], np.flatnonzero(pair | (c[1:] != c[:-1])) + 1])
    return a[new], b[new], c[new], np.add.reduceat(n[order], new)


def _is_hot(hot: np.ndarray, w: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(w), bool)
    return hot[np.minimum(np.searchsorted(hot, w), len(hot) - 1)] == w


def _part(w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    one = _is_hot(hot, w1)
    two = one & _is_hot(hot, w2)
    way = w1.copy()
    way[one] = mix(w1[one] ^ mix(w2[one]))
    way[two] = mix(way[two] ^ mix(w3[two] + np.uint64(1)))
    return ((mix(way) >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def _lists(bounds: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def packets(w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, n: np.ndarray, hot: np.ndarray, parts: int) -> pa.RecordBatch:
    """One row per part: the stripes of its first words, below each its pairs, below each pair the next words and their counts."""
    part = _part(w1, w2, w3, hot, parts)
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    part, w1, w2, w3, n = part[order], w1[order], w2[order], w3[order], n[order]
    starts = lambda differs: np.concatenate([[0], np.flatnonzero(differs) + 1])
    box = part[1:] != part[:-1]
    word = box | (w1[1:] != w1[:-1])
    pair = word | (w2[1:] != w2[:-1])
    rows, words, pairs = starts(box), starts(word), starts(pair)
    per_word = np.diff(np.append(np.searchsorted(pairs, words), len(pairs)))
    per_pair = np.diff(np.append(pairs, len(w1)))
    in_rows = lambda at: np.append(np.searchsorted(at, rows), len(at))
    by_word, by_pair, by_third = in_rows(words), in_rows(pairs), np.append(rows, len(w1))
    return pa.RecordBatch.from_arrays([
        pa.array(part[rows].astype(np.int32)), _lists(by_word, w1[words].view(np.int64)), _lists(by_word, per_word.astype(np.int32)),
        _lists(by_pair, w2[pairs].view(np.int64)), _lists(by_pair, per_pair.astype(np.int32)),
        _lists(by_third, w3.view(np.int64)), _lists(by_third, n.astype(np.int32))],
        ["part", "first", "pairs", "second", "width", "third", "n"])


def unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    flat = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False)
    width, pairs = flat("width"), flat("pairs")
    return (np.repeat(np.repeat(flat("first").view(np.uint64), pairs), width), np.repeat(flat("second").view(np.uint64), width),
            flat("third").view(np.uint64), flat("n").astype(np.int64))


def stripes(docs: DataFrame, hot: np.ndarray, parts: int) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE):
            *_, piece, w = words_of(part)
            if len(w) < 2:
                continue
            on = piece[1:] == piece[:-1]
            third = np.zeros(len(w) - 1, np.uint64)
            third[:-1] = np.where(on[1:], w[2:], 0)
            a, b, c = w[:-1][on], w[1:][on], third[on]
            del w, piece, third, on
            if len(a):
                a, b, c, n = merge(a, b, c, np.ones(len(a), np.int64))
                yield packets(a, b, c, n, hot, parts)

    return docs.mapInArrow(build, PACKET)


def merge_stripes(sent: DataFrame, hot: np.ndarray) -> DataFrame:
    """GRAMS: extensions with LEAST_COUNT occurrences; pair totals (w3 = 0) that reach it or may do so with other parts."""
    def emit(w1, w2, w3, n) -> pa.RecordBatch:
        w1, w2, w3, n = merge(w1, w2, w3, n)
        pair = np.concatenate([[0], np.flatnonzero((w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])) + 1])
        longer = (w3 != 0) & (n >= LEAST_COUNT)
        total, most = np.add.reduceat(n, pair), np.maximum.reduceat(np.where(longer, n, 0), pair)
        a, b = w1[pair], w2[pair]
        stays = (total >= LEAST_COUNT) | (_is_hot(hot, a) & _is_hot(hot, b))
        none = np.zeros(int(longer.sum()), np.int64)
        join = lambda x, y: pa.array(np.concatenate([x.astype(np.uint64), y.astype(np.uint64)]).view(np.int64))
        return pa.RecordBatch.from_arrays([join(a[stays], w1[longer]), join(b[stays], w2[longer]), join(np.zeros(int(stays.sum())), w3[longer]),
                                           join(total[stays], n[longer]), join(most[stays], none)], ["w1", "w2", "w3", "f", "extension"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            names = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)] if len(names) else []
            for lo, hi in zip(cuts, cuts[1:]):
                if names[lo] != part and held:
                    yield emit(*[np.concatenate(x) for x in zip(*held)])
                    held = []
                part = names[lo]
                held.append(unpack(batch.slice(lo, hi - lo)))
        if held:
            yield emit(*[np.concatenate(x) for x in zip(*held)])

    # All packets of a part come one after the other, so a task holds one part at a time.
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(fold, GRAMS)


def _score(a: Column, left: Column, right: Column) -> Column:
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * wide(a) * wide(a), wide(left) * wide(right))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP, parts: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `top` phrases of two or three words per language.

    A-Z are lower-cased, pieces end at . , ; : ! ? and line ends, words at blanks and tabs. A phrase has a >= 10 occurrences
    inside pieces, overlaps included. Of its cuts the one with the least score floor(10^6 a^2 / (l r)) counts, ties to the shorter
    first part. A phrase goes when a longer one with at least half of its occurrences contains it. Order: score, a (both
    descending), phrase. NULL texts are empty, NULL languages are `und`; repeated rows count each time; other columns are not
    read; an empty table gives an empty result. Words are told apart by 64-bit ids: equal ids of two words that occur often stop the job.
    `parts` (four times the shuffle partitions if not given) is the number of parts that stripes are dealt to; a task holds one at a time.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counted = materialise(word_counts(rows))
    total = counted.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    frequent = counted.where("id is not null")
    hot = np.sort(np.array([r["id"] for r in frequent.where(F.col("f") * HOT_SHARE >= F.lit(total)).select("id").collect()], np.int64).view(np.uint64))
    if parts is None:
        parts = PARTS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    grams = merge_stripes(stripes(rows, hot, parts), hot)
    grams = materialise(grams.groupBy("w1", "w2", "w3").agg(F.sum("f").alias("f"), F.max("extension").alias("extension")).where(F.col("f") >= LEAST_COUNT))

    own = frequent.withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("id")))
    own = own.where(F.when(F.col("same") == 1, True).otherwise(F.raise_error(F.lit("two frequent words share an id")).cast("boolean"))).drop("same")
    words = materialise(own.join(counted.groupBy("lang").agg(F.sum("f").alias("n")), "lang"))
    pairs, triples = grams.where("w3 = 0"), grams.where("w3 <> 0")
    word = lambda k, also=(): words.select(F.col("id").alias(f"w{k}"), F.col("f").alias(f"f{k}"), F.col("word").alias(f"s{k}"), *also)
    pair = lambda i, j: pairs.select(F.col("w1").alias(f"w{i}"), F.col("w2").alias(f"w{j}"), F.col("f").alias(f"f{i}{j}"))
    before = triples.groupBy(F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.max("f").alias("before"))
    longest = F.greatest("extension", F.coalesce("before", F.lit(0)))
    two = pairs.join(before, ["w1", "w2"], "left").where(~(longest * 100 >= F.col("f") * SUBSUMED))
    two = two.join(word(1, ("lang", "n")), "w1").join(word(2), "w2")
    two = two.select("lang", "n", F.concat_ws(" ", "s1", "s2").alias("phrase"), F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"),
                     _score(F.col("f"), F.col("f1"), F.col("f2")).alias("score"))
    three = triples.join(pair(1, 2), ["w1", "w2"]).join(pair(2, 3), ["w2", "w3"]).join(word(1, ("lang", "n")), "w1").join(word(2), "w2").join(word(3), "w3")
    late, early = _score(F.col("f"), F.col("f12"), F.col("f3")), _score(F.col("f"), F.col("f1"), F.col("f23"))
    three = three.select("lang", "n", F.concat_ws(" ", "s1", "s2", "s3").alias("phrase"), F.col("f").alias("a"),
                         F.when(early <= late, F.col("f1")).otherwise(F.col("f12")).alias("l"),
                         F.when(early <= late, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least(early, late).alias("score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # Spark keeps only the first `top` rows of a language in every task before they meet.
    ranked = two.unionByName(three).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
