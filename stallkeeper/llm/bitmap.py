"""Bitmaps over 64-bit hashes, of one size whatever they hold: a bounded thing to send to executors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 1 << 26


def bitmap(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Cells and their bits of a bitmap over the hashes in column `token`: at most FILTER_BITS / 32 rows reach the driver."""
    cells = tokens.select(F.pmod("token", F.lit(FILTER_BITS)).alias("at")).selectExpr("int(at div 32) AS cell", "shiftleft(1L, int(at % 32)) AS bit")
    found = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    return found["cell"].to_numpy(), found["bits"].to_numpy().astype(np.uint32)


def dense(sparse: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[sparse[0]] = sparse[1]
    return out


def has_bits(cells: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the bitmap may have; never misses one that it was made of."""
    bit = hashes & np.uint64(FILTER_BITS - 1)
    return ((cells[(bit >> np.uint64(5)).astype(np.int64)] >> (bit & np.uint64(31)).astype(np.uint32)) & np.uint32(1)).astype(bool)
