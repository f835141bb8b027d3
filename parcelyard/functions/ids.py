"""Asset identifiers and seeded 64-bit hashes.

Spark's xxhash64 has a fixed seed of 42, so seeded hashes run in Arrow batches
over the xxhash library.
"""

from __future__ import annotations

import uuid

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the fifth prime of the XXH64 definition.
PRIME5 = 0x27D4EB2F165667C5
_MASK = (1 << 64) - 1


def xxh64(data: bytes, seed: int = 0) -> int:
    """Standard XXH64."""
    return xxhash.xxh64_intdigest(data, seed)


def xxh64_compat(data: bytes, seed: int = 0) -> int:
    """XXH64, except that empty input gives seed + PRIME5 without the final mixing."""
    return xxh64(data, seed) if data else (seed + PRIME5) & _MASK


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def asset_id_of(path: str | None) -> str | None:
    """Stable id of a path: case and slash direction do not matter. Empty gives the zero id, null gives null."""
    if path is None:
        return None
    if path == "":
        return str(uuid.UUID(int=0))
    raw = path.replace("\\", "/").lower().encode()
    low = xxh64(raw, 0)
    both = bytearray(low.to_bytes(8, "little") + xxh64(raw, low).to_bytes(8, "little"))
    both[6] = both[6] & 0x0F | 0x40
    both[8] = both[8] & 0x3F | 0x80
    return str(uuid.UUID(bytes_le=bytes(both)))


def asset_id(path: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(asset_id_of, na_action="ignore")

    return run(path)


def content_hash(data: Column, seed: int = 0, compat: bool = False) -> Column:
    """XXH64 of binary data as the signed number with the same bits."""
    f = xxh64_compat if compat else xxh64

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else _signed(f(bytes(b), seed))).astype("Int64")

    return run(data)
