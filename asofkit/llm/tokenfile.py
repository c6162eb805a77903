"""Operator 2: token ids in files of fixed-width packed blocks.

A dataset is a folder of Parquet parts in ascending order of doc_id; each row holds one shard of the token file format:

    magic 4 bytes, bits per id, tokens per block, number of documents, tokens and blocks, ids of the documents,
    first token of every document, byte offset of every block, packed blocks

All header numbers are little-endian 64-bit. A block packs up to BLOCK_TOKENS ids at the least bits that hold the vocabulary;
its offset is known, so any range of tokens is read by unpacking the blocks that it touches, with numpy, without a loop over
ids. Parts are written by Spark's committer: a task that is lost is run again and leaves no half file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import row_key, slices

MAGIC = b"TKB1"
BLOCK_TOKENS = 4096
SHARD_TOKENS = 1 << 21   # a shard is closed when it has so many
MEMO_WORDS = 1_000_000   # words whose ids a worker remembers (some 40 MB); emptied when full
SLICE_BYTES = 8 << 20     # text encoded at once: few, large lookups
LEARN_WORDS = 20_000     # new words that go to the tokenizer at once
_HEAD = struct.Struct("<4sqqqqq")


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids at `bits` bits each, least bit first, padded to whole bytes."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids[:, None].astype(np.uint32) >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=count * bits).reshape(count, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def write_shard(docs: np.ndarray, sizes: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
    blocks = [pack(ids[k:k + BLOCK_TOKENS], bits) for k in range(0, len(ids), BLOCK_TOKENS)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<i8")
    head = _HEAD.pack(MAGIC, bits, BLOCK_TOKENS, len(docs), len(ids), len(blocks))
    return b"".join([head, docs.astype("<i8").tobytes(), starts.tobytes(), offsets.tobytes(), *blocks])


class Shard:
    """Reader of one shard; `tokens` gives any range, `document` any document."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block, n, self.size, blocks = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = _HEAD.size
        self.docs = np.frombuffer(data, "<i8", n, at)
        self.starts = np.frombuffer(data, "<i8", n + 1, at + 8 * n)
        self.offsets = np.frombuffer(data, "<i8", blocks + 1, at + 8 * (2 * n + 1))
        self.data, self.base = memoryview(data), at + 8 * (2 * n + blocks + 2)

    def tokens(self, start: int, end: int) -> np.ndarray:
        if end <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        parts = [unpack(self.data[self.base + int(self.offsets[b]):self.base + int(self.offsets[b + 1])], self.bits,
                        min(self.block, self.size - b * self.block)) for b in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block:end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))


class WordEncoder:
    """Ids of whole texts by a tokenizer that lower-cases, drops white space and never looks across it.

    Distinct words of a batch are encoded once and looked up after that; the ids of a text are those of its words. New words go
    to the tokenizer in long strings, parted by blanks; the place of an id in the string tells its word. Words go by their lower
    case, but those whose lower case holds an added token by their own spelling, as added tokens match that alone.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.words, self.flat, self.ends = pa.array([], pa.string()), np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Encodes new words and returns their places in the memo."""
        odd = np.zeros(len(words), bool)  # words with an added token inside go alone
        for token in self.special:
            odd |= pc.match_substring(words, token).to_numpy(zero_copy_only=False)
        plain, own = words.filter(pa.array(~odd)), words.filter(pa.array(odd))
        flats, sizes = [self.flat], [np.diff(self.ends)]
        for k in range(0, len(plain), LEARN_WORDS):
            part = plain.slice(k, LEARN_WORDS)
            got = self.tokenizer.encode(" ".join(part.to_pylist()), add_special_tokens=False)
            length = pc.utf8_length(part).to_numpy().astype(np.int64) + 1
            place = np.fromiter((start for start, _ in got.offsets), np.int64, len(got.ids))
            owner = np.searchsorted(np.cumsum(length) - length, place, side="right") - 1
            flats.append(np.array(got.ids, np.uint32))
            sizes.append(np.bincount(owner, minlength=len(part)))
        for word in own.to_pylist():
            flats.append(np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32))
            sizes.append(np.array([len(flats[-1])]))
        order = np.argsort(odd, kind="stable")
        places = np.empty(len(words), np.int64)
        places[order] = len(self.words) + np.arange(len(words))
        self.words = pa.concat_arrays([self.words, plain, own])
        self.flat, self.ends = np.concatenate(flats), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return places

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ids per text)."""
        texts = pc.fill_null(texts, "")
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        parts = pc.dictionary_encode(words.flatten())
        odd = np.zeros(len(parts.dictionary), bool)
        for token in self.special:
            odd |= pc.match_substring(parts.dictionary, token.lower()).to_numpy(zero_copy_only=False)
        if odd.any():
            own = pa.array(odd[parts.indices.to_numpy()])
            spelled = pc.ascii_split_whitespace(texts).flatten()
            parts = pc.dictionary_encode(pc.if_else(own, spelled, words.flatten()))
        if len(self.words) > MEMO_WORDS:
            self._forget()
        found = pc.index_in(parts.dictionary, value_set=self.words)
        known = found.fill_null(-1).to_numpy().astype(np.int64)
        if found.null_count:
            known[known < 0] = self._learn(parts.dictionary.filter(pc.is_null(found)))
        code = known[parts.indices.to_numpy()]
        count = np.diff(self.ends)[code]
        ends = np.cumsum(count)
        place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count - self.ends[code], count)
        bounds = np.concatenate([[0], ends])[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return self.flat[place], np.diff(bounds)


@lru_cache(maxsize=1)
def encoder_at(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, vocabulary: int, text: str = "text", key: str = "doc_id") -> None:
    """Encodes every whole text, appends `end_id` to each and writes the shards below `path`, in ascending order of ids.

    NULL texts are empty (the end id alone). A NULL id is written as the smallest long; rows of equal id go by their text.
    Parts are cut by range of (id, hash of the text), so equal ids can spread over parts. Columns `part` and `seq` order the
    shards.
    """
    spark, bits = docs.sparkSession, bits_for(vocabulary)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(row_key(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(parts, F.col("id"), F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, encoder = TaskContext.get().partitionId(), 0, encoder_at(tokenizer)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def shard() -> pa.RecordBatch:
            docs_, sizes, ids = (np.concatenate(x) for x in zip(*held))
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([seq]), pa.array([docs_[0]]), pa.array([len(ids)]), pa.array([write_shard(docs_, sizes, ids, bits)], pa.binary())],
                ["part", "seq", "first_id", "tokens", "shard"])

        for piece in slices(batches, limit=SLICE_BYTES):
            ids, sizes = encoder.encode(piece.column("text"))
            out = np.insert(ids, np.cumsum(sizes), end_id)  # after the last id of each text
            held.append((piece.column("id").to_numpy(), sizes + 1, out))
            if sum(len(x[2]) for x in held) >= SHARD_TOKENS:
                yield shard()
                held, seq = [], seq + 1
        if held:
            yield shard()

    rows.mapInArrow(encode, "part long, seq long, first_id long, tokens long, shard binary").write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a token dataset: doc_id, start, n_tokens, ids_crc32, ids.

    `start` counts the ids of all documents before it. Only one total per part meets on the driver: as many rows as the
    write had tasks.
    """
    shards = spark.read.parquet(path)
    totals = sorted(shards.groupBy("part").agg(F.min("first_id"), F.sum("tokens")).collect(), key=lambda r: r[0])
    upto = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = shards.select("part", "seq", F.coalesce(F.sum("tokens").over(upto), F.lit(0)).alias("inside"))
    base = np.concatenate([[0], np.cumsum([r[2] for r in totals])])
    at = spark.createDataFrame([(r[0], int(b)) for r, b in zip(totals, base)], "part long, base long")
    placed = shards.join(before, ["part", "seq"]).join(F.broadcast(at), "part").select((F.col("base") + F.col("inside")).alias("base"), "shard")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base_, data in zip(batch.column("base").to_pylist(), batch.column("shard").to_pylist()):
                shard = Shard(data)
                ids = shard.tokens(0, shard.size)
                sizes = np.diff(shard.starts)
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(shard.starts[:-1].tolist(), shard.starts[1:].tolist())]
                lists = pa.ListArray.from_arrays(pa.array(shard.starts.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(shard.docs), pa.array(shard.starts[:-1] + base_), pa.array(sizes), pa.array(crc, pa.int64()), lists],
                                                 ["id", "start", "n_tokens", "ids_crc32", "ids"])

    rows = placed.mapInArrow(decode, "id long, start long, n_tokens long, ids_crc32 long, ids array<int>")
    return rows.select(F.when(F.col("id") != -(2**63), F.col("id")).alias("doc_id"), "start", "n_tokens", "ids_crc32", "ids")
