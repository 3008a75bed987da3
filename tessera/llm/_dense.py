"""Fixed-size arrays filled by all tasks and merged in chunks: sketches and Bloom filters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16
SCHEMA = "chunk int, lane int, data binary"


def dense_rows(array: np.ndarray, lane: int) -> pd.DataFrame:
    """Rows of SCHEMA that carry a task's array; all-zero chunks are left out."""
    raw = array.tobytes()
    parts = [(i // CHUNK, lane, raw[i : i + CHUNK]) for i in range(0, len(raw), CHUNK)]
    zero = bytes(CHUNK)
    return pd.DataFrame([p for p in parts if p[2] != zero[: len(p[2])]], columns=["chunk", "lane", "data"])


def merge_dense(rows: DataFrame, size: int, dtype: str, how: str) -> np.ndarray:
    """Merge the tasks' arrays by 'sum' or 'or' into one of ``size`` entries.

    Chunks are merged in 16 lanes, then over lanes; the driver gets the one merged
    array, whose size is a parameter and doesn't grow with the input.
    """
    fold = np.add if how == "sum" else np.bitwise_or

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(pdf["data"].iloc[0], dtype).copy()
        for raw in pdf["data"].iloc[1:]:
            fold(total, np.frombuffer(raw, dtype), out=total)
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "lane": [0], "data": [total.tobytes()]})

    once = rows.withColumn("lane", F.col("lane") % 16).groupBy("chunk", "lane").applyInPandas(merge, SCHEMA)
    merged = once.groupBy("chunk").applyInPandas(merge, SCHEMA)
    out = np.zeros(size, dtype)
    flat = out.view(np.uint8)
    for r in merged.select("chunk", "data").toLocalIterator():
        flat[r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(r["data"])] = np.frombuffer(r["data"], np.uint8)
    return out


class Bloom:
    """A Bloom filter of fixed size over 64-bit hashes; it only spares join rows, never decides."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.shift = np.uint64(64 - int(np.log2(len(bits) * 8)))

    @classmethod
    def empty(cls, log_bits: int = 24) -> Bloom:
        return cls(np.zeros(1 << (log_bits - 3), np.uint8))

    def _probes(self, h: np.ndarray):
        for turn in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
            at = (h * turn) >> self.shift
            yield (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8))

    def add(self, h: np.ndarray) -> None:
        for at, bit in self._probes(h):
            np.bitwise_or.at(self.bits, at, bit)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at, bit in self._probes(h):
            out &= (self.bits[at] & bit) != 0
        return out
