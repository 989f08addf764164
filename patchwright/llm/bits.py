"""Bit arrays of fixed size that tell which keys may occur: a set of any size as a few megabytes, false alarms included."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of an array, and how many pieces it is brought together in: a task builds one piece, the driver puts them side by side.
BITS, PIECES = 1 << 26, 1 << 10


def marked(bits: DataFrame, bit: Column) -> np.ndarray:
    """The packed array (BITS / 8 bytes) in which the given bits are set, from numbers of 0 to BITS - 1."""
    width = BITS // PIECES

    def built(frame: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(width, bool)
        own[frame["at"].to_numpy()] = True
        return pd.DataFrame({"piece": [frame["piece"].iloc[0]], "bits": [np.packbits(own).tobytes()]})

    parts = bits.select(bit.alias("bit")).distinct().select(F.floor(F.col("bit") / width).cast("int").alias("piece"), (F.col("bit") % width).cast("int").alias("at"))
    out = np.zeros((PIECES, width // 8), np.uint8)
    for r in parts.groupBy("piece").applyInPandas(built, "piece int, bits binary").collect():
        out[r["piece"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def is_set(packed: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (packed[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)
