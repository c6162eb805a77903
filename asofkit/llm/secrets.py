"""Operator 5: secret scan with multipart credential linking.

Base findings (assign, access, hex) stand alone. Weak parts (a bare account name, a random-looking word, an address) prove
nothing by themselves: they are reported only when complementary parts lie within REACH code points in the same scope, a
stretch of text without a blank line. A weak secret needs an identifier or an endpoint, a weak identifier needs a secret, an
endpoint needs an identifier and a secret. All parts of a link lie in one document, so the interval join runs beside the
scan on sorted starts and nothing shuffles.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices

# The base patterns and their least sizes.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

KINDS = ("assign", "access", "hex", "linked_id", "linked_secret", "linked_endpoint")
REACH = 300
MIN_ENTROPY = 3.5  # bits per character of a weak secret

_WEAK_ID = re.compile(r"""(?:access_key_id|client_id|account|username|user|login)["']?\x20{0,8}[:=]\x20{0,8}["']?([A-Za-z0-9_.@-]{3,})""", re.I | re.A)
_WEAK_SECRET = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_ENDPOINT = re.compile(r"""(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3|ftp)://[^\s"'<>]+""", re.I | re.A)
_BLANK_LINE = re.compile(r"\n[ \t\r]*\n")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ID_WORDS = (b"access_key_id", b"client_id", b"account", b"user", b"login")
_HEX_RAW = re.compile(rb"[0-9a-f]{24}")

SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the standing findings: leftmost, non-overlapping per kind, by start, then kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def _random_looking(word: str) -> bool:
    if not (any(c.isdigit() for c in word) and any(c.isalpha() for c in word)):
        return False
    return -sum(n / len(word) * math.log2(n / len(word)) for n in Counter(word).values()) >= MIN_ENTROPY


class _Near:
    """Interval join side: is any part within REACH of [start, end) in the same scope?"""

    def __init__(self, spans: list[tuple[int, int]], breaks: list[int]):
        self.starts, self.ends, self.breaks = sorted(s for s, _ in spans), sorted(e for _, e in spans), breaks

    def __call__(self, start: int, end: int) -> bool:
        k = bisect_right(self.breaks, start)
        low = max(start - REACH, self.breaks[k - 1] if k else 0)
        high = min(end + REACH, self.breaks[k] if k < len(self.breaks) else 1 << 62)
        # Parts that overlap [low, high): all that begin before high less all that end at or before low.
        return bisect_left(self.starts, high) > bisect_right(self.ends, low)


def linked_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    taken = sorted((s, e) for s, e, _ in base)
    starts = [s for s, _ in taken]
    furthest, most = [], 0
    for _, e in taken:
        most = max(most, e)
        furthest.append(most)

    def free(span: tuple[int, int]) -> bool:
        k = bisect_left(starts, span[1])
        return not k or furthest[k - 1] <= span[0]

    ends = [m.span() for m in _ENDPOINT.finditer(text)]
    inside = _Near(ends, [])
    ids = [m.span() for m in _WEAK_ID.finditer(text) if free(m.span())]
    weak = [m.span() for m in _WEAK_SECRET.finditer(text) if free(m.span()) and _random_looking(m[0])]
    weak = [x for x in weak if bisect_left(inside.starts, x[1]) <= bisect_right(inside.ends, x[0])]
    breaks = [m.end() for m in _BLANK_LINE.finditer(text)]
    an_id = _Near([(s, e) for s, e, k in base if k == "access"] + ids, breaks)
    a_secret = _Near([(s, e) for s, e, k in base if k != "access"] + weak, breaks)
    an_end = _Near(ends, breaks)
    found = [(*x, "linked_id") for x in ids if a_secret(*x)]
    found += [(*x, "linked_secret") for x in weak if an_id(*x) or an_end(*x)]
    return found + [(*x, "linked_endpoint") for x in ends if an_id(*x) and a_secret(*x)]


def spans_of(raw: bytes) -> list[tuple[int, int, str]]:
    low = raw.lower()
    if not (b"AKIA" in raw or any(k in low for k in _KEYWORDS) or b"://" in raw or any(k in low for k in _ID_WORDS) or _HEX_RAW.search(raw)):
        return []
    text = raw.decode("utf-8", "replace")
    base = base_spans(text)
    return sorted(base + linked_spans(text, base), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        found = [[{"kind": k, "start": s, "end": e} for s, e, k in spans_of(raw or b"")] for raw in part.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, _ARROW.field("spans").type)], schema=_ARROW)


def scan_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: doc_id, spans (kind, start, end in code points, end exclusive) by start, then kind.

    NULL texts are empty and give an empty list; a NULL or repeated id is passed on; no other column is read. A document is
    scanned whole, in time linear in its length.
    """
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_scan, SCHEMA)


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
                        F.sha2(span_list(base).cast("binary"), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"),
                        *[count(k).alias(f"n_{k}") for k in KINDS[3:]])
