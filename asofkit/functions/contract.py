"""Feature contract: a small list of entries that names exactly what a matrix may hold."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

ROLES = ("predictor", "target", "diagnostic", "audit", "metadata")
TIERS = ("structural", "core", "extended")


@dataclass(frozen=True)
class Entry:
    name: str
    role: str
    family: str
    tier: str | None = None
    is_pattern: bool = False


def parse_entries(raw: Sequence[dict]) -> list[Entry]:
    """Validated entries: required keys, known roles and tiers, no name twice."""
    entries = []
    for item in raw:
        missing = [k for k in ("name", "role", "family") if not item.get(k)]
        if missing:
            raise ValueError(f"contract entry {item.get('name')!r} lacks {missing}")
        if item["role"] not in ROLES or item.get("tier") not in (None, *TIERS):
            raise ValueError(f"contract entry {item['name']!r}: unknown role or tier")
        if item["role"] == "predictor" and not item.get("tier"):
            raise ValueError(f"predictor {item['name']!r} has no tier")
        entries.append(Entry(item["name"], item["role"], item["family"], item.get("tier"), bool(item.get("is_pattern"))))
    names = [e.name for e in entries]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"contract names repeated: {repeated}")
    return entries


def names(entries: Sequence[Entry], *, role: str, families: Sequence[str] | None = None) -> list[str]:
    return sorted(e.name for e in entries if e.role == role and not e.is_pattern and (families is None or e.family in families))


def tier_columns(entries: Sequence[Entry], tier: str) -> list[str]:
    """structural: its own columns; core: core only; extended: core and extended."""
    wanted = {"structural": ("structural",), "core": ("structural", "core"), "extended": ("structural", "core", "extended")}[tier]
    return sorted(e.name for e in entries if e.role == "predictor" and not e.is_pattern and e.tier in wanted)


def check_columns(columns: Sequence[str], entries: Sequence[Entry], *, ids: Sequence[str] = ()) -> None:
    """Predictor columns equal the contract both ways."""
    have, want = set(columns) - set(ids), set(names(entries, role="predictor"))
    if have != want:
        raise AssertionError(f"not in the contract: {sorted(have - want)}; missing: {sorted(want - have)}")
