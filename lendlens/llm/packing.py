"""Small numbers as compressed planes of their bytes, and sets of keys as bits."""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(values: np.ndarray) -> bytes:
    """Numbers below 2^32."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


class Mask:
    """One bit for every key that may be in a set; no key of the set lacks its bit.

    The bits are sent to every task: 2^bits, however many keys there are. Whoever uses a mask
    still has to decide on the keys that it lets through.
    """

    def __init__(self, keys: DataFrame, bits: int, name: str = "key"):
        self.low = 2**bits - 1
        at = F.col(name).bitwiseAND(F.lit(self.low))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
        words = keys.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(bit).alias("bits"))
        # At most 2^(bits - 6) rows, whatever the corpus.
        found = words.toArrow()
        made = np.zeros(2**bits // 64, np.uint64)
        made[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        self._sent: Broadcast = keys.sparkSession.sparkContext.broadcast(made)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = keys & np.uint64(self.low)
        return (self._sent.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)) == 1

    def may_hold(self, key: str | Column) -> Column:
        """A filter on a column of longs that are not NULL."""

        def held(keys: pd.Series) -> pd.Series:
            return pd.Series(self.holds(keys.to_numpy(np.int64).view(np.uint64)))

        return F.pandas_udf(held, "boolean")(key)
