"""Vector functions on arrays of numbers."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import per_row


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


class _Places(dict):
    """Of words twice their bucket, and one more if they count up; forgets all when it holds ``MOST``."""

    MOST = 1 << 18

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, word: str) -> int:
        digest = hashlib.sha1(word.encode()).digest()
        if len(self) >= self.MOST:
            self.clear()
        self[word] = place = 2 * (int.from_bytes(digest[:4], "little") % self.dim) + digest[4] % 2
        return place


@cache
def _places(dim: int) -> _Places:
    return _Places(dim)


def hashed_embedding_py(text: str | None, dim: int = 512) -> np.ndarray:
    """Deterministic bag-of-words embedding without a model: each word adds a sign to a bucket, both from its SHA-1."""
    counts = Counter(re.findall(r"\w+", (text or "").lower()))
    places = np.fromiter(map(_places(dim).__getitem__, counts), np.int64, len(counts))
    times = np.fromiter(counts.values(), np.int64, len(counts))
    v = np.bincount(places >> 1, np.where(places & 1, times, -times), dim).astype(np.float32)
    norm = float(np.linalg.norm(v))
    return v / norm if norm else v


def with_hashed_embedding(df: DataFrame, text: str, out: str = "embedding", dim: int = 512) -> DataFrame:
    return per_row(df, [F.col(text)], lambda t: hashed_embedding_py(t, dim), out, "array<float>")
