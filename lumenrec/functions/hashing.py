"""Signed feature hashing by 32-bit MurmurHash3 with seed 0, which Spark's own hash functions do not offer."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

_ALL = 0xFFFFFFFF


def _rotated(x: int, bits: int) -> int:
    return (x << bits | x >> 32 - bits) & _ALL


def murmur3(data: bytes, seed: int = 0) -> int:
    """Unsigned 32-bit MurmurHash3 of data."""
    h, whole = seed, len(data) // 4 * 4
    words = [*np.frombuffer(data[:whole], "<u4").tolist()]
    tail = int.from_bytes(data[whole:], "little")
    for n, k in enumerate([*words, tail]):
        k = _rotated(k * 0xCC9E2D51 & _ALL, 15) * 0x1B873593 & _ALL
        h ^= k
        if n < len(words):
            h = (_rotated(h, 13) * 5 + 0xE6546B64) & _ALL
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * factor & _ALL
    return h


def hashed(names, size: int) -> list[float]:
    """Each name adds 1 or, for a negative hash, -1 at its place; a null list is a vector of zeros."""
    out = [0.0] * size
    for name in names if names is not None else ():
        if name is not None:
            h = murmur3(name.encode("utf-8", "surrogatepass"))
            h = h - (1 << 32) if h >= 1 << 31 else h
            out[abs(h) % size] += 1.0 if h >= 0 else -1.0
    return out


def signed_hash(names: Column, size: int) -> Column:
    """Vector of size floats from an array of names. Lists repeat, so a batch hashes each distinct one once."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(lists: pd.Series) -> pd.Series:
        keys = [None if x is None else tuple(x) for x in lists]
        known = {k: hashed(k, size) for k in set(keys)}
        return pd.Series([known[k] for k in keys])

    return run(names)
