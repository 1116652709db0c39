"""A filter for a set of whole numbers, built in the cluster."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each member, log2 of the least and the most bits (64 MB). The filter lets all members through and few others; with so many members that
#: the most bits are too few, it lets everything through, and what follows, which joins exactly, moves more.
BITS_EACH, LEAST, MOST = 12, 23, 29


def _mixed(x: np.ndarray, k: int, bits: int) -> np.ndarray:
    z = (x.astype(np.int64).view(np.uint64) + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
    z ^= z >> np.uint64(32)
    z *= np.uint64(0xD6E8FEB86659FD93)
    return z >> np.uint64(64 - bits)


def id_filter(df: DataFrame, col: str) -> Callable[[np.ndarray], np.ndarray]:
    """A function for executors: which of the given numbers may be among df's. df is counted first."""
    n = df.count()
    bits = max(LEAST, int(np.ceil(np.log2(max(1, n * BITS_EACH)))))
    if bits > MOST:
        return lambda x: np.ones(len(x), bool)

    def mark(batches):
        import pandas as pd

        for pdf in batches:
            x = pdf["x"].to_numpy(np.int64)
            if not len(x):
                continue
            place = np.concatenate([_mixed(x, k, bits) for k in range(3)])
            place.sort()
            at, bit = (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63))
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            yield pd.DataFrame({"at": at[starts], "word": np.bitwise_or.reduceat(bit, starts).view(np.int64)})

    rows = df.select(F.col(col).cast("long").alias("x")).mapInPandas(mark, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toPandas()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[rows["at"].to_numpy(np.int64)] = rows["word"].to_numpy(np.int64)
    shared = df.sparkSession.sparkContext.broadcast(words)

    def keep(x: np.ndarray) -> np.ndarray:
        words, out = shared.value, np.ones(len(x), bool)
        for k in range(3):
            p = _mixed(x, k, bits)
            out &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)).astype(np.int64)) & 1 == 1
        return out

    return keep
