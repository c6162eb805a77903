"""Order-free digests that combine map-side, so no task ever holds all keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_LIMBS = ((1, 12), (13, 12), (25, 12), (37, 12), (49, 12))


def row_hash(columns: list[str]) -> Column:
    """sha256 of one row, columns in the given order, NULL kept apart from the text 'NULL'."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


def limb_sums(hash_col: Column, prefix: str = "limb") -> list[Column]:
    """Aggregates: the row count and the sums of five 48-bit limbs of sha256 hex strings.

    Sums are associative and commutative, so partial sums merge in any order and the result
    does not depend on row order or partitioning; adding, dropping or changing a row changes
    it. They can be kept per cell and added up again later.
    """
    limbs = [
        F.sum(F.conv(F.substring(hash_col, start, size), 16, 10).cast("decimal(20,0)")).alias(f"{prefix}{i}")
        for i, (start, size) in enumerate(_LIMBS, 1)
    ]
    return [F.count(hash_col).alias(f"{prefix}0"), *limbs]


def merge_limbs(prefix: str = "limb") -> list[Column]:
    return [F.sum(f"{prefix}{i}").alias(f"{prefix}{i}") for i in range(len(_LIMBS) + 1)]


def finish_digest(prefix: str = "limb") -> Column:
    parts = [F.coalesce(F.col(f"{prefix}{i}").cast("string"), F.lit("0")) for i in range(len(_LIMBS) + 1)]
    return F.sha2(F.concat_ws(":", *parts), 256)
