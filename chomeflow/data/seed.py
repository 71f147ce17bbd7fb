"""The bundled registry: all prefectures, and a partial list of municipalities, in two CSV files.

The list holds every administrative ward of the designated cities, the special
wards, the prefectural capitals and some more; it isn't the whole statutory
register.  Load that with ``chomeflow.sources.registry.municipalities(spark, path)``.
Codes are public (JIS X 0402); the check digit is computed from the base code.
"""

from __future__ import annotations

import csv
from pathlib import Path

HERE = Path(__file__).parent


def check_digit(base: str) -> str:
    """The sixth digit of a local government code, by weights 6 to 2 modulo 11."""
    if len(base) != 5 or not base.isdigit():
        raise ValueError(f"a base code has 5 digits, not {base!r}")
    return str((11 - sum(int(d) * w for d, w in zip(base, (6, 5, 4, 3, 2), strict=True)) % 11) % 10)


def _read(name: str) -> list[dict[str, str]]:
    with (HERE / name).open(encoding="utf-8", newline="") as f:
        return list(csv.DictReader(f))


def prefecture_rows() -> list[tuple[str, ...]]:
    """(code, name, stem, suffix, kana, romaji) in code order."""
    return [tuple(r.values()) for r in _read("prefectures.csv")]


def municipality_rows() -> list[tuple[str | None, ...]]:
    """(prefecture_code, prefecture_name, base_code, check_digit, lg_code, name, city, ward, county, entity_type, kana) in lg_code order."""
    names = {r[0]: r[1] for r in prefecture_rows()}
    rows = []
    for r in _read("municipalities.csv"):
        base, d = r["base_code"], check_digit(r["base_code"])
        rows.append((base[:2], names[base[:2]], base, d, base + d, r["name"], r["city"], r["ward"] or None, r["county"] or None, r["entity_type"], None))
    return sorted(rows, key=lambda r: r[4])
