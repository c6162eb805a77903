"""Operator 1: SentencePiece encoding and decoding by a max-plus scan.

A text is cut into pieces of the model so that the sum of their scores is largest (the unigram rule). In the max-plus algebra a
stretch of text is a matrix: entry state s (the first piece that starts here begins s characters in) to exit state e (the last
one reaches e characters beyond). Matrices of neighbouring stretches combine associatively. Giant documents are cut into
chunks anywhere; tasks turn chunks into matrices, a scan over the small matrices of a document gives each chunk its best
scores on entry, then its exit state, and every chunk is traced back on its own, wherever it runs.

No piece has a word mark after another character, so every path passes the point before a new word: there the matrix has rank
one. Between such points words are independent, and a task remembers the pieces of the words it has seen.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import materialise, row_key, slices

MARK = "▁"          # fixed value: stands for a blank
GIANT_CHARS = 1 << 15    # texts beyond this are cut into chunks
CHUNK_CHARS = 1 << 13
FAN = 64  # neighbouring chunks that one row of the scan holds
MEMO_WORDS = 500_000     # words whose pieces a worker remembers (some 20 MB); emptied when full
SLICE_BYTES = 4 << 20    # text encoded at once: few, large lookups
UNIT = 1024              # scores are held as whole numbers of this part, so that sums do not depend on their order
UNKNOWN_PENALTY = 10.0   # fixed value: an unknown character scores this less than the worst piece
NEVER = -(1 << 60)
_NORMAL, _USER, _BYTE = 1, 4, 6  # fixed values: piece types of the model file


def _fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(field, wire type, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, wire, varint()
            continue
        size = varint() if wire == 2 else 4 if wire == 5 else 8
        yield tag >> 3, wire, data[at:at + size]
        at += size


class Model:
    """Pieces and scores of a SentencePiece model file, read as a unigram model."""

    def __init__(self, path: str):
        pieces: list[tuple[str, float, int]] = []
        with open(path, "rb") as f:
            for field, _, value in _fields(f.read()):
                if field == 1:
                    own = {k: v for k, _, v in _fields(value)}
                    score = float(np.frombuffer(own[2], "<f4")[0]) if 2 in own else 0.0
                    pieces.append((own.get(1, b"").decode(), score, own.get(3, _NORMAL)))
        normal = [s for _, s, t in pieces if t == _NORMAL]
        best, worst = max(normal), min(normal)
        self.surfaces = [p for p, _, _ in pieces]
        self.bytes = {int(p[3:5], 16): k for k, (p, _, t) in enumerate(pieces) if t == _BYTE}
        self.byte_of = {k: b for b, k in self.bytes.items()}
        # User-defined pieces score by their size in bytes, as the library does.
        self.score = {p: (round((len(p.encode()) * best - 0.1 if t == _USER else s) * UNIT), k)
                      for k, (p, s, t) in enumerate(pieces) if t in (_NORMAL, _USER)}
        self.unknown = round((worst - UNKNOWN_PENALTY) * UNIT)
        self.longest = max(map(len, self.score))
        self.table: dict[str, tuple] = {p[:n]: () for p in self.score for n in range(1, len(p))}
        self.table.update(self.score)
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece holds a word mark after another character: texts can not be cut before words")
        self.lone_break = not any("\n" in p for p in self.score)  # then a line break always stands alone

    def starting(self, text: str, at: int) -> list[tuple[int, int, int]]:
        """(length, score, id) of the pieces that start at a position, shortest first; id -1 for an unknown character."""
        found = []
        for n in range(1, min(self.longest, len(text) - at) + 1):
            hit = self.table.get(text[at:at + n])
            if hit is None:
                break
            if hit:
                found.append((n, *hit))
        return found if found and found[0][0] == 1 else [(1, self.unknown, -1), *found]

    def forward(self, text: str, own: int, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best score up to every position, in as many lanes as `entry` has columns, from pieces that start before `own`.

        `entry` holds the scores of the first positions; ties keep what reached a position from the earliest start.
        """
        score = np.full((max(len(text), own + self.longest) + 1, entry.shape[1]), NEVER, np.int64)
        score[:len(entry)] = entry
        back = np.full(score.shape, -1, np.int32)
        for at in range(own):
            here = score[at]
            if (here <= NEVER).all():
                continue
            for n, value, _ in self.starting(text, at):
                new = np.where(here > NEVER, here + value, NEVER)
                better = new > score[at + n]
                score[at + n][better] = new[better]
                back[at + n][better] = at
        return score, back

    def segment(self, text: str) -> tuple[list[int], int]:
        """Ids of a whole short text, and its score: `forward` in one lane, without arrays."""
        n, table, longest = len(text), self.table, self.longest
        score, start, piece = [0] + [NEVER] * n, [0] * (n + 1), [-1] * (n + 1)
        for at in range(n):
            base, single = score[at], False
            for end in range(at + 1, min(n, at + longest) + 1):
                hit = table.get(text[at:end])
                if hit is None:
                    break
                if hit:
                    single = single or end == at + 1
                    if base + hit[0] > score[end]:
                        score[end], start[end], piece[end] = base + hit[0], at, hit[1]
            if not single and base + self.unknown > score[at + 1]:
                score[at + 1], start[at + 1], piece[at + 1] = base + self.unknown, at, -1
        ids, at = [], n
        while at:
            own = [piece[at]] if piece[at] >= 0 else self.ids(text, start[at], at, -1)
            ids.extend(reversed(own))
            at = start[at]
        return ids[::-1], score[n]

    def ids(self, text: str, start: int, end: int, piece: int) -> list[int]:
        return [piece] if piece >= 0 else [self.bytes.get(b, 0) for b in text[start:end].encode()]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes of unknown characters are joined again, marks become blanks, the first blank goes."""
        raw = b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else self.surfaces[i].encode() for i in ids)
        return raw.decode("utf-8", "replace").replace(MARK, " ")[1:]


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


@lru_cache(maxsize=2)
def model_at(path: str) -> Model:
    return Model(path)


class WordMemo:
    """Ids of texts word by word. Each distinct word is encoded once; a batch is looked up with array operations.

    Texts come as bytes, with blanks for marks and the first mark in front. A word is a run of blanks and what follows it.
    """

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.words, self.flat, self.ends = pa.array([], pa.binary()), np.empty(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, words: pa.Array) -> None:
        found = [self.model.segment(w.decode("utf-8", "replace").replace(" ", MARK))[0] for w in words.to_pylist()]
        self.words = pa.concat_arrays([self.words, words])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in found])]).astype(np.int64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, bounds of the texts in them)."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        blank = data == 32
        opens = blank.copy()
        opens[1:] &= ~blank[:-1]
        if self.model.lone_break:
            line = data == 10
            opens |= line
            opens[1:] |= line[:-1]
        opens[at[:-1][at[:-1] < len(data)]] = True
        first = np.flatnonzero(opens)
        offsets = np.append(first, len(data)).astype(np.int32)
        words = pc.dictionary_encode(pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)]))
        if len(self.words) > MEMO_WORDS:
            self._forget()
        found = pc.index_in(words.dictionary, value_set=self.words)
        known = found.fill_null(-1).to_numpy().astype(np.int64)
        if found.null_count:
            known[known < 0] = len(self.words) + np.arange(found.null_count)
            self._learn(words.dictionary.filter(pc.is_null(found)))
        code = known[words.indices.to_numpy()]
        count = np.diff(self.ends)[code]
        ends = np.cumsum(count)
        place = np.arange(int(ends[-1])) - np.repeat(ends - count - self.ends[code], count)
        return self.flat[place], np.concatenate([[0], ends])[np.searchsorted(first, at)]


@lru_cache(maxsize=1)
def memo_at(path: str) -> WordMemo:
    return WordMemo(model_at(path))


def blank_bytes(text: str | None) -> bytes:
    return (" " + text.replace(MARK, " ")).encode() if text else b""


class Chunk:
    """A stretch of a giant text: `own` characters and as many after them as a piece can reach.

    With the start of a new word inside, every path passes there: the matrix is the sum of the way in and the way out, and what
    lies between the first and the last such cut adds the same to all paths. It is left out of the scores.
    """

    def __init__(self, model: Model, text: str, own: int):
        self.model, self.text, self.own = model, text, own
        marks = [m.start() for m in re.finditer(f"(?<=[^{MARK}]){MARK}", text[:own])]
        self.cut = (marks[0], marks[-1]) if marks else None

    def reach(self, entry: np.ndarray) -> tuple:
        """Exit scores per lane (states x lanes) for the entry scores, with what a trace needs."""
        size = self.model.longest
        if self.cut is None:
            score, back = self.model.forward(self.text, self.own, entry)
            return score[self.own:self.own + size], (score, back), None
        first, last = self.cut
        head = self.model.forward(self.text[:first], first, entry[:first + 1])
        tail = self.model.forward(self.text[last:], self.own - last, np.zeros((1, 1), np.int64))
        exits = tail[0][self.own - last:self.own - last + size, 0][:, None]
        return np.where((exits > NEVER) & (head[0][first] > NEVER), exits + head[0][first], NEVER), head, tail

    def matrix(self) -> np.ndarray:
        """entry state x exit state."""
        size = self.model.longest
        entry = np.full((size, size), NEVER, np.int64)
        np.fill_diagonal(entry, 0)
        return self.reach(entry)[0].T.copy()

    def _walk(self, text: str, back: np.ndarray, at: int) -> tuple[list[int], int]:
        """(ids, where the trace ends) of the best path to a position."""
        known, ids = self.model.score, []
        while back[at, 0] >= 0:
            start = int(back[at, 0])
            own = text[start:at]
            ids.append(self.model.ids(text, start, at, known[own][1] if own in known else -1))
            at = start
        return [i for part in reversed(ids) for i in part], at

    def trace(self, entry: np.ndarray, exit_state: int) -> tuple[int, list[int], str, list[int]]:
        """(entry state, ids up to the first cut, text between the cuts, ids after it) of the best path out at `exit_state`."""
        _, head, tail = self.reach(entry[:, None])
        if tail is None:
            ids, at = self._walk(self.text, head[1], self.own + exit_state)
            return at, ids, "", []
        first, last = self.cut
        ids, at = self._walk(self.text, head[1], first)
        return at, ids, self.text[first:last], self._walk(self.text[last:], tail[1], self.own - last + exit_state)[0]

    def entries(self, entry: np.ndarray) -> np.ndarray:
        """Entry state of the best path for every exit state, -1 where there is none."""
        exits, head, tail = self.reach(entry[:, None])
        ends = [self.own + e if tail is None else self.cut[0] for e in range(self.model.longest)]
        where = {end: self._walk(self.text, head[1], end)[1] for end in set(ends)}
        return np.array([where[end] if exits[e, 0] > NEVER else -1 for e, end in enumerate(ends)], np.int64)


def whole_ids(memo: WordMemo, traced: list[tuple[int, list[int], str, list[int]]]) -> list[np.ndarray]:
    """Ids of traced chunks: way in, words between the cuts, way out."""
    flat, at = memo([t.replace(MARK, " ").encode() for _, _, t, _ in traced])
    return [np.concatenate([np.array(head, np.int32), flat[a:b], np.array(tail, np.int32)]) for (_, head, _, tail), a, b in zip(traced, at[:-1], at[1:])]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two transfer matrices (entry state x exit state); associative."""
    usable = (a[:, :, None] > NEVER) & (b[None] > NEVER)
    return np.where(usable, a[:, :, None] + b[None], NEVER).max(axis=1)


def entry_scores(matrices: list[np.ndarray], now: np.ndarray | None = None) -> list[np.ndarray]:
    """Best score of every entry state of each chunk, from those of the first chunk (state 0 alone if not given)."""
    if now is None:
        now = np.full(matrices[0].shape[0], NEVER, np.int64)
        now[0] = 0
    out = []
    for m in matrices:
        out.append(now)
        now = product(now[None], m)[0]
    return out


def exit_states(maps: list[np.ndarray], state: int = 0) -> list[int]:
    """Exit state of each chunk, from that of the last; the entry state of a chunk is the exit state of the one before."""
    out = []
    for m in reversed(maps):
        out.append(state)
        state = int(m[state])
    return out[::-1]


Fold = Callable[[list[np.ndarray]], np.ndarray]
Unfold = Callable[[list[np.ndarray], list[int] | None], list[list[int]]]


def blocked_scan(items: DataFrame, fold: Fold, unfold: Unfold, fan: int = 0) -> DataFrame:
    """(id, h, k, v): the scan of `items` (id, h, k, m array<long>) per text (id, h) in the order of k, for an associative `fold`.

    Up: runs of `fan` neighbours are folded to one item, level by level, until a text is one item. Down: `unfold` gives every
    member of a run its value from the run's own value (None for the whole text). A row holds `fan` items at most, and runs of one
    text go to different tasks.
    """
    fan = fan or FAN
    schema = "id long, h long, k long, {} array<long>"

    def runs(level: DataFrame) -> DataFrame:
        return level.groupBy("id", "h", F.expr(f"k div {fan}").alias("run")).agg(F.sort_array(F.collect_list(F.struct("k", "m"))).alias("rows"))

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                one = fold([np.array(x["m"], np.int64) for x in r["rows"]])
                yield pa.RecordBatch.from_arrays([pa.array([r["id"]]), pa.array([r["h"]]), pa.array([r["run"]]), pa.array([one.tolist()], pa.list_(pa.int64()))], ["id", "h", "k", "m"])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                values = unfold([np.array(x["m"], np.int64) for x in r["rows"]], r.get("v"))
                n = len(values)
                yield pa.RecordBatch.from_arrays([pa.array([r["id"]] * n), pa.array([r["h"]] * n), pa.array([x["k"] for x in r["rows"]]), pa.array(values, pa.list_(pa.int64()))],
                                                 ["id", "h", "k", "v"])

    levels = [items]
    while (levels[-1].agg(F.max("k")).first()[0] or 0) >= fan:
        levels.append(materialise(runs(levels[-1]).mapInArrow(up, schema.format("m"))))
    found = None
    for level in reversed(levels):
        rows = runs(level)
        if found is not None:
            rows = rows.join(found.withColumnRenamed("k", "run"), ["id", "h", "run"])
        found = materialise(rows.mapInArrow(down, schema.format("v")))
    return found


def _giant_ids(giants: DataFrame, path: str) -> DataFrame:
    """(id, h, ids) of giant texts."""
    reach = model_at(path).longest - 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            for i, h, text in zip(*(part.column(c).to_pylist() for c in ("id", "h", "text"))):
                text = marked(text)
                at = range(0, len(text), CHUNK_CHARS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(at)), pa.array([h] * len(at)), pa.array(range(len(at)), pa.int64()),
                     pa.array([min(CHUNK_CHARS, len(text) - a) for a in at], pa.int64()), pa.array([text[a:a + CHUNK_CHARS + reach] for a in at], pa.string())],
                    ["id", "h", "k", "own", "text"])

    chunks = materialise(giants.mapInArrow(cut, "id long, h long, k long, own long, text string").repartition("id", "h", "k"))

    def per_chunk(work, out: str, names: list[str], kind):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = model_at(path)
            for part in slices(batches):
                rows = part.to_pylist()
                values = work([Chunk(model, r["text"], r["own"]) for r in rows], rows)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "h", "k")), pa.array(values, kind)], names)
        return run, out

    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    keys = "id long, h long, k long"
    run, out = per_chunk(lambda cs, rs: [c.matrix().ravel() for c in cs], f"{keys}, m array<long>", ["id", "h", "k", "m"], longs)
    size = reach + 1
    square = lambda ms: [m.reshape(size, size) for m in ms]
    entry = blocked_scan(
        materialise(chunks.mapInArrow(run, out)), lambda ms: reduce(product, square(ms)).ravel(),
        lambda ms, v: [x.tolist() for x in entry_scores(square(ms), None if v is None else np.array(v, np.int64))])
    known = chunks.join(entry.withColumnRenamed("v", "entry"), ["id", "h", "k"])
    run, out = per_chunk(lambda cs, rs: [c.entries(np.array(r["entry"], np.int64)) for c, r in zip(cs, rs)], f"{keys}, m array<long>", ["id", "h", "k", "m"], longs)
    # Entry state by exit state: maps of neighbours are put one into the other, from the last chunk of a text to the first.
    exits = blocked_scan(
        materialise(known.mapInArrow(run, out)), lambda ms: reduce(lambda a, b: np.where(b >= 0, a[b], -1), ms),
        lambda ms, v: [[x] for x in exit_states(ms, 0 if v is None else v[0])]).select("id", "h", "k", F.col("v")[0].alias("v"))
    run, out = per_chunk(lambda cs, rs: whole_ids(memo_at(path), [c.trace(np.array(r["entry"], np.int64), r["exit"]) for c, r in zip(cs, rs)]), f"{keys}, ids array<int>", ["id", "h", "k", "ids"], ints)
    traced = known.join(exits.withColumnRenamed("v", "exit"), ["id", "h", "k"]).mapInArrow(run, out)
    return traced.groupBy("id", "h").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))


def encode_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: doc_id, ids. NULL and empty texts have no ids.

    The model file is read by every task from `path`, which must lead to it on every machine. Rows that repeat an id with
    the same text each have their row. Other columns are not read.
    """
    rows = docs.select(row_key(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    giant = F.char_length("text") > GIANT_CHARS

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = memo_at(path)
        for part in slices(batches, limit=SLICE_BYTES):
            flat, ends = memo([blank_bytes(t) for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))], ["id", "ids"])

    short = rows.where(~giant).mapInArrow(encode, "id long, ids array<int>")
    giants = rows.where(giant).withColumn("h", F.xxhash64("text"))
    found = _giant_ids(giants.dropDuplicates(["id", "h"]), path)
    times = giants.groupBy("id", "h").count()
    long = found.join(times, ["id", "h"]).select("id", "ids", F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("_")).drop("_")
    return short.unionByName(long).select(F.when(F.col("id") != -(2**63), F.col("id")).alias("doc_id"), "ids")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """One row per row of `encoded`: doc_id, ids, text. A mark that was in a text comes back as a blank; NULL or no ids give an empty text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path)
        raw = pa.array([bytes([model.byte_of[k]]) if k in model.byte_of else s.encode() for k, s in enumerate(model.surfaces)], pa.large_binary())
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = part.column("ids")
                at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                pieces = raw.take(lists.flatten())
                ends = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1) if len(pieces) else np.zeros(1, np.int64)
                # Pieces lie one after the other, so texts are stretches of the same bytes.
                joined = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends[at].copy()), pieces.buffers()[2] or pa.py_buffer(b"")])
                try:
                    texts = pc.utf8_slice_codeunits(pc.replace_substring(joined.cast(pa.large_string()), MARK, " "), 1).cast(pa.string())
                except pa.ArrowInvalid:  # bytes that are no UTF-8
                    texts = pa.array([b.decode("utf-8", "replace").replace(MARK, " ")[1:] for b in joined.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, texts], ["doc_id", "ids", "text"])

    return encoded.mapInArrow(decode, "doc_id long, ids array<int>, text string")
