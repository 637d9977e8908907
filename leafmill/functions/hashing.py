"""XXH3 keys, which Spark has no built-in for: Arrow batches through the xxhash package."""

from __future__ import annotations

import struct

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cache_key_of(source_hash: int, box: tuple[int, int, int, int]) -> int:
    """Key of a page's hash and a box: XXH3 of the 24 little-endian bytes."""
    import xxhash

    return _signed(xxhash.xxh3_64_intdigest(struct.pack("<Q4i", source_hash & ((1 << 64) - 1), *box)))


@F.pandas_udf(LongType())
def xxh3(content: pd.Series) -> pd.Series:
    """XXH3-64 of bytes or text, as the signed 64-bit pattern."""
    import xxhash

    return content.map(lambda x: _signed(xxhash.xxh3_64_intdigest(bytes(x) if not isinstance(x, str) else x.encode())) if x is not None else None).astype("Int64")


@F.arrow_udf(LongType())
def cache_key(source_hash: pa.Array, x1: pa.Array, y1: pa.Array, x2: pa.Array, y2: pa.Array) -> pa.Array:
    """`cache_key_of` by row; null for a null part."""
    cells = zip(source_hash.to_pylist(), x1.to_pylist(), y1.to_pylist(), x2.to_pylist(), y2.to_pylist(), strict=True)
    return pa.array([cache_key_of(c[0], c[1:]) if None not in c else None for c in cells], pa.int64())


@F.arrow_udf(LongType())
def region_key(content: pa.Array, x1: pa.Array, y1: pa.Array, x2: pa.Array, y2: pa.Array) -> pa.Array:
    """Key of a region's own bytes and its box; null for a null part."""
    import xxhash

    cells = zip(content.to_pylist(), x1.to_pylist(), y1.to_pylist(), x2.to_pylist(), y2.to_pylist(), strict=True)
    return pa.array([_signed(xxhash.xxh3_64_intdigest(c[0] + struct.pack("<4i", *c[1:]))) if None not in c else None for c in cells], pa.int64())
