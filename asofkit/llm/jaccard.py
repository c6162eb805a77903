"""Operator 9: n-gram Jaccard join as a blocked sparse matrix product.

The document by n-gram incidence matrix is never multiplied out. Its columns (n-gram hashes) are cut into blocks whose number
follows from the size of a document: sets of a and b n-grams that link with a share of s in a hundred differ in at most
(a + b) (100 - s) / (100 + s) columns, so with one block more than that, at least one block of both rows is identical. Rows
with no identical block are below that bound and are discarded together. A row leaves out its lightest blocks, empty ones
first, while they are fewer than the identical blocks that any link of it has. Blocks are compared by a hash of their content. Pairs of classes that meet in a block face a second
bound of the same kind: each row also keeps the parity of its n-gram count in 1,024 buckets, and two rows differ in at least
as many n-grams as buckets of unlike parity. Overlap counts are accumulated for the pairs that are left. Classes already
joined by a link are not compared again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, broadcast_if_small, bytes_of, hash_words, materialise, mix, ngram_hash, row_key, slices, text_name, word_bounds
from .components import components

SHINGLE = 3          # the contract of op9; other callers give their own
SHARE = 90           # links: 100 * intersection >= share * union
PARITY_BITS = 1024
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _bounds(share: int) -> np.ndarray:
    """First size of every size group: linked sets lie in the same group or in neighbouring ones."""
    at = [1]
    while at[-1] < 1 << 40:
        at.append(max(at[-1] + 1, -(-at[-1] * 100 // share)))
    return np.array(at)


BOUNDS = _bounds(SHARE)


def blocks_of(group: np.ndarray, share: int = SHARE, bounds: np.ndarray = BOUNDS) -> np.ndarray:
    """Blocks for sets of the size groups `group` and the next: one more than the columns in which a linked pair may differ."""
    return 2 * (bounds[group + 2] - 1) * (100 - share) // (100 + share) + 1


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, int]:
    """(text, hash) of the distinct shingles of every text, by text, then hash; and the number of texts.

    A text of fewer words than a shingle has its whole sequence as one; a text without words has none.
    """
    data, at = bytes_of(texts)
    data = _LOWER[data]
    starts, ends = word_bounds(data, SPACE)
    words, first = hash_words(data, starts, ends), np.searchsorted(starts, at)
    size = np.diff(first)
    left = np.repeat(first[1:], size) - np.arange(len(words))
    full = np.flatnonzero(left >= shingle)
    owner = np.repeat(np.arange(len(size)), size)
    h, o = ngram_hash(words, shingle)[full] if len(full) else np.empty(0, np.uint64), owner[full]
    short = np.flatnonzero((size > 0) & (size < shingle))
    if len(short):
        whole = words[first[short]].copy()
        for k in range(1, shingle - 1):
            more = size[short] > k
            whole[more] = mix(whole[more] + mix(words[first[short[more]] + k] + np.uint64(k + 1)))
        h, o = np.concatenate([h, mix(whole + size[short].astype(np.uint64))]), np.concatenate([o, short])
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return o[fresh], h[fresh], len(size)


def _block_names(o: np.ndarray, h: np.ndarray, n: np.ndarray, group: np.ndarray, most: np.ndarray, share: int,
                 bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block names, how many per text) for the matrix of size group `group` per text; texts with a negative group have none.

    `most` is the largest size of a set that a text has to meet here. At least `sure` of its blocks equal those of any link. With L
    the largest number so that fewer than `sure` blocks have up to L columns, those are left out. A linked pair still meets: by
    the text with the larger L, one of the equal blocks has more columns than that, and both texts name it.
    """
    k = np.where(group >= 0, blocks_of(np.maximum(group, 0), share, bounds), 0)
    base = np.cumsum(k) - k
    use = group[o] >= 0
    o, h = o[use], h[use]
    place = (base[o] + (((h >> np.uint64(32)) * k[o].astype(np.uint64)) >> np.uint64(32)).astype(np.int64))
    names = np.zeros(int(k.sum()), np.uint64)
    if len(place):
        at = np.flatnonzero(np.diff(place, prepend=-1))
        names[place[at]] = np.add.reduceat(mix(h + np.uint64(77)), at)
    owner = np.repeat(np.arange(len(k)), k)
    number = np.arange(len(names)) - base[owner]
    names = mix(names ^ mix(number.astype(np.uint64) + (group[owner].astype(np.uint64) << np.uint64(40))))
    weight, sure = np.bincount(place, minlength=len(names)), k - (n + most) * (100 - share) // (100 + share)
    order = np.lexsort((weight, owner))  # by text, lightest first
    # The block with the number `sure` - 1 of this order is the first that stays, with all of its weight.
    least = np.zeros(len(k), np.int64)
    some = k > 0
    least[some] = weight[order[(base + np.clip(sure, 1, np.maximum(k, 1)) - 1)[some]]]
    stays = weight >= least[owner]
    return names[stays], np.bincount(owner[stays], minlength=len(k))


def _sketch(shingle: int, share: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    bounds = _bounds(share)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            o, h, rows = shingle_sets(part.column("text"), shingle)
            n = np.bincount(o, minlength=rows)
            sums = []
            for salt in (np.uint64(1), np.uint64(2)):
                total = np.zeros(rows, np.uint64)
                at = np.flatnonzero(np.diff(o, prepend=-1))
                if len(o):
                    total[o[at]] = np.add.reduceat(mix(h ^ mix(np.array([salt]))[0]), at)
                sums.append(pa.array(mix(total + n.astype(np.uint64)).view(np.int64)))
            odd = (np.bincount(o * PARITY_BITS + (h & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=rows * PARITY_BITS) & 1).astype(np.uint8)
            lanes = PARITY_BITS // 64
            parity = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * lanes), pa.array(np.packbits(odd).view(np.int64)))
            group = np.where(n > 0, np.searchsorted(bounds, n, side="right") - 1, -1)
            at = np.maximum(group, 0)
            own, k_own = _block_names(o, h, n, group, np.minimum(n * 100 // share, bounds[at + 2] - 1), share, bounds)
            below, k_below = _block_names(o, h, n, np.where(group > 0, group - 1, -1), bounds[at] - 1, share, bounds)
            owner = np.concatenate([np.repeat(np.arange(rows), k_own), np.repeat(np.arange(rows), k_below)])
            values = np.concatenate([own, below])[np.argsort(owner, kind="stable")]
            ends = np.concatenate([[0], np.cumsum(k_own + k_below)]).astype(np.int32)
            blocks = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), pa.array(n), *sums, parity, blocks],
                                             ["id", "h", "n", "d1", "d2", "parity", "blocks"])

    return sketch


def _overlap(shingle: int, share: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text_a"):
            for piece in slices(iter([part]), "text_b"):
                oa, ha, rows = shingle_sets(piece.column("text_a"), shingle)
                ob, hb, _ = shingle_sets(piece.column("text_b"), shingle)
                tag = lambda o, h: mix(h ^ mix(o.astype(np.uint64) + np.uint64(5)))
                both = np.bincount(oa[np.isin(tag(oa, ha), tag(ob, hb))], minlength=rows)
                union = np.bincount(oa, minlength=rows) + np.bincount(ob, minlength=rows) - both
                yield piece.select(["a", "b"]).filter(pa.array(100 * both >= share * union))

    return overlap


def _may_link(n_a: Column, n_b: Column, parity_a: Column, parity_b: Column, share: int) -> Column:
    """False only for sets that can not link, by their sizes and by the buckets of unlike parity."""
    unlike = F.bit_count(parity_a[0].bitwiseXOR(parity_b[0]))
    for k in range(1, PARITY_BITS // 64):
        unlike = unlike + F.bit_count(parity_a[k].bitwiseXOR(parity_b[k]))
    near = 100 * F.least(n_a, n_b) >= share * F.greatest(n_a, n_b)
    return near & ((100 + share) * unlike <= (100 - share) * (n_a + n_b))


def _linked(docs: DataFrame, names: DataFrame, pairs: DataFrame, shingle: int, share: int) -> DataFrame:
    """The pairs (a, b) of classes whose texts link, by their exact overlap count on one text of each class."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    wanted = materialise(names.join(wanted, "class", "left_semi").select("class", F.col("id").alias("__id"), F.col("h").alias("__h")))
    texts = docs.join(broadcast_if_small(wanted), (F.col("id") == F.col("__id")) & (F.col("h") == F.col("__h")))
    texts = materialise(texts.select("class", "text").dropDuplicates(["class"]))
    rows = pairs.join(texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a")
    rows = rows.join(texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b")
    return materialise(rows.select("a", "b", "text_a", "text_b").mapInArrow(_overlap(shingle, share), "a long, b long"))


def similar_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", *, shingle: int = SHINGLE, share: int = SHARE,
                   named: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (smallest id reachable by links, itself included).

    Texts link when their sets of `shingle` consecutive words have at least `share` hundredths of their union in common.
    Words are runs of anything but ASCII white space, lower-cased A-Z. A NULL or wordless text has no shingles and links with
    nothing. A NULL id is smaller than any other; a component that holds it has a NULL component_id. Rows that repeat an id
    with different texts are compared each by its own text. `named` adds text_name, the hash of the text, and first: whether
    the row has the smallest id of its component and, of that id, the smallest hash. Other columns are not read. An empty table
    gives an empty result.
    """
    docs = docs.select(row_key(key).alias("id"), text_name(text).alias("h"), F.col(text).alias("text"))
    sketch = materialise(docs.mapInArrow(_sketch(shingle, share), "id long, h long, n long, d1 long, d2 long, parity array<long>, blocks array<long>"))
    # Equal sets form a class, represented by its smallest row (id, h). Classes, not rows, are joined from here on.
    smallest = lambda c: F.min(c).alias("rep")
    classes = materialise(sketch.where("n > 0").groupBy("n", "d1", "d2").agg(smallest(F.struct("id", "h"))))
    # A class goes by d1. Different sets that share it (as good as never, but possible in a very large corpus) go by all three numbers.
    alike = classes.groupBy("d1").count().where("count > 1").select("d1")
    twins = materialise(classes.join(alike, "d1", "left_semi").select("n", "d1", "d2", F.xxhash64("n", "d1", "d2").alias("own")))
    own_class = lambda rows: rows.join(broadcast_if_small(twins), ["n", "d1", "d2"], "left").withColumn("class", F.coalesce("own", "d1")).drop("own")
    filled = own_class(sketch.where("n > 0").select("n", "d1", "d2", "blocks")).select(F.explode("blocks").alias("block"), "class")
    met = materialise(filled.groupBy("block").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi"))
    names = own_class(classes).select("class", "rep.*")
    facts = own_class(sketch.where("n > 0").select("id", "h", "n", "d1", "d2", "parity")).select("id", "h", "class", "n", "parity").dropDuplicates(["id", "h", "class"])
    names = materialise(names.join(facts, ["id", "h", "class"]))

    def side(s: str) -> DataFrame:
        return names.select(F.col("class").alias(f"class_{s}"), F.col("n").alias(f"n_{s}"), F.col("parity").alias(f"parity_{s}"))

    open_pair = _may_link(F.col("n_x"), F.col("n_y"), F.col("parity_x"), F.col("parity_y"), share)
    as_pair = (F.least("class_x", "class_y").alias("a"), F.greatest("class_x", "class_y").alias("b"))
    # First every class of a block against two of them, the least and the largest: enough to join most near copies.
    member = materialise(filled.join(met, "block").select("block", "class", "lo", "hi").distinct())
    spokes = F.explode(F.array(*[F.struct(F.least("class", c).alias("class_x"), F.greatest("class", c).alias("class_y")) for c in ("lo", "hi")]))
    tried = member.select(spokes.alias("p")).select("p.*").where("class_x <> class_y").distinct()
    tried = materialise(tried.join(side("x"), "class_x").join(side("y"), "class_y").where(open_pair).select(*as_pair))
    links = _linked(docs, names, tried, shingle, share)
    known = components(links)
    # Then all pairs of classes that share a block, are in different components and within the bounds: no link is missed.
    homes = materialise(names.join(known.withColumnRenamed("id", "__class"), F.col("class") == F.col("__class"), "left").select(
        "class", "n", "parity", F.coalesce("component", "class").alias("component")))
    placed = member.join(homes.select("class", "component"), "class").select("block", "class", "component")
    mixed = materialise(placed.groupBy("block").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("block"))
    spread = materialise(member.join(mixed, "block").select("block", "class").join(homes, "class"))
    x, y = (spread.select("block", *[F.col(c).alias(f"{c}_{s}") for c in ("class", "n", "parity", "component")]) for s in "xy")
    pairs = materialise(x.join(y, "block").where((F.col("component_x") < F.col("component_y")) & open_pair).select(*as_pair).distinct())
    more = _linked(docs, names, pairs.join(tried, ["a", "b"], "left_anti"), shingle, share)
    found = components(links.unionByName(more))
    placed = materialise(own_class(classes).join(found, F.col("class") == F.col("id"), "left").select(
        F.col("n").alias("cn"), F.col("d1").alias("c1"), F.col("d2").alias("c2"), "rep", F.coalesce("component", "class").alias("component")))
    # Read back from storage, so AQE can split a large component.
    least = materialise(placed.groupBy("component").agg(smallest("rep")))
    homes = materialise(placed.drop("rep").join(least, "component").drop("component"))
    out = sketch.select("id", "h", "n", "d1", "d2").join(homes, F.expr("n = cn and d1 = c1 and d2 = c2"), "left")
    null_id = lambda c: F.when(c != -(2**63), c)
    extra = [F.col("h").alias("text_name"), F.expr("rep is null or (id = rep.id and h = rep.h)").alias("first")] if named else []
    return out.select(null_id(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), null_id(F.coalesce("rep.id", "id")).alias("component_id"), *extra)
