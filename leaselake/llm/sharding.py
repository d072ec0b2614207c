"""Sharding by a Feistel permutation with cycle walking over global row numbers.

A row's place in the shuffle is a keyed permutation of its global row number, so shard and slot can be
computed for any row, and the row for any shard and slot, from the seed and the number of rows alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaselake.llm.common import fresh, global_rows

ROUNDS = 6
SEED = 20_250_701
SHARDS = 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Permutation:
    """A keyed bijection of 0..n-1.

    The Feistel network works on the smallest even number of bits that holds n, so at most three of four
    numbers lie outside; those walk along their cycle until they are inside again.
    """

    def __init__(self, n: int, seed: int = SEED, rounds: int = ROUNDS):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        with np.errstate(over="ignore"):
            self.keys = _mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

    def _network(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & mask
        for key in keys:
            left, right = right, left ^ (_mix(right + key) & mask)
        return (right << half) | left

    def _walk(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = self._network(np.asarray(x, dtype=np.uint64), keys)
            while (outside := np.flatnonzero(out >= np.uint64(self.n))).size:
                out[outside] = self._network(out[outside], keys)
        return out.astype(np.int64)

    def forward(self, rows: np.ndarray) -> np.ndarray:
        """Place of each row number."""
        return self._walk(rows, self.keys)

    def backward(self, places: np.ndarray) -> np.ndarray:
        """Row number at each place. The network ends with a swap, so the keys reversed undo it."""
        return self._walk(places, self.keys[::-1])


def place_of(row: Column, n: int, seed: int = SEED) -> Column:
    @F.pandas_udf("long")
    def place(rows: pd.Series) -> pd.Series:
        return pd.Series(Permutation(n, seed).forward(rows.to_numpy()))

    return place(row)


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """Global row number that lies at a slot of a shard."""
    return int(Permutation(n, seed).backward(np.array([slot * shards + shard]))[0])


def assign_shards(rows: DataFrame, order: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Add ``shard`` and ``slot`` to a narrow table; shard sizes differ by one row at most.

    Global row numbers follow ``order`` (nulls first); rows equal in it are told apart by their place in
    the scan, so repeated rows get places of their own. An empty table stays empty. Columns already named
    shard or slot are replaced; every other column is kept.
    """
    number, place = fresh(rows, "row", "place")
    numbered, n = global_rows(rows.drop("shard", "slot"), order, number)
    return (
        numbered.withColumn(place, place_of(F.col(number), n, seed))
        .withColumn("shard", F.pmod(F.col(place), F.lit(shards)).cast("int"))
        .withColumn("slot", F.expr(f"{place} div {shards}"))
        .drop(number, place)
    )


def write_shards(assigned: DataFrame, path: str) -> None:
    """Write one folder per shard, rows in slot order inside each file; several tasks share a shard."""
    assigned.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)
