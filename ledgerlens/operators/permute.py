"""A seeded order of rows that every task works out by itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.dataflow import numbered

ROUNDS = 6


def permutation(places: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Where each of the places 0 to ``count`` - 1 goes: Feistel rounds over the next power of four; what falls outside goes round again."""
    half = max(1, (max(1, count - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(seed).integers(1, 1 << 63, ROUNDS, dtype=np.uint64)
    out = places.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for key in keys:
            mixed = (right ^ key) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= count]
    return out.astype(np.int64)


def permuted(df: DataFrame, key: str, seed: int, most: int | None = None) -> DataFrame:
    """Rows in an order that the seed and the number of rows set, from their order by ``key``; any number of rows, none of them on the driver. ``most``: the first of them."""
    placed = numbered(df.orderBy(key), "_at")
    count = placed.count()

    @F.pandas_udf("long")
    def goes_to(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for places in batches:
            yield pd.Series(permutation(places.to_numpy(), count, seed))

    out = placed.withColumn("_to", goes_to("_at"))
    out = out if most is None else out.where(F.col("_to") < most)
    return out.orderBy("_to").select(*df.columns)
