"""FNV-1a hashes. Spark has no wrapping 64-bit product, so a whole batch is hashed by byte position in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

#: Fixed values of the 64-bit FNV-1a hash.
OFFSET, PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


def fnv1a(values: list[bytes]) -> np.ndarray:
    """Hash of each value, sorted by length first so that a step touches only values that long."""
    sizes = np.array([len(v) for v in values], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    data = np.frombuffer(b"".join(values[i] for i in order), dtype=np.uint8)
    sizes = sizes[order]
    starts = np.cumsum(sizes) - sizes
    h = np.full(len(values), OFFSET, dtype=np.uint64)
    for place in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -place, side="left"))
        h[:n] = (h[:n] ^ data[starts[:n] + place]) * PRIME
    out = np.empty_like(h)
    out[order] = h
    return out


def _hash16(text: pd.Series) -> pd.Series:
    hashes = fnv1a([t.encode() if t is not None else b"" for t in text])
    return pd.Series([None if t is None else f"{int(h):016x}" for t, h in zip(text, hashes)], dtype=object)


def hash16(c: Column) -> Column:
    """FNV-1a of a text's UTF-8 bytes as 16 hexadecimal digits; null for null."""
    return F.pandas_udf(_hash16, "string")(c)


def hash8(c: Column) -> Column:
    """The low 32 bits of hash16 as 8 digits."""
    return F.right(hash16(c), F.lit(8))
