"""Paired tests of two systems on the same segments, from sums of the segments' counts.

Segments never leave their partition: there the weights of all replicates are drawn and multiplied with the counts, and only
replicates x counts numbers are added over the partitions. Draws depend on the replicate and the segment's key alone.

- ``bootstrap``: a segment counts as often as a Poisson variable of mean 1 says, the same for both systems (Koehn 2004, with the sizes of the
  resamples left free, which is what makes it independent of partitions). The p-value is two-sided: how often a replicate's difference is
  farther from the mean of all than the real one is from 0.
- ``randomised``: the systems' outputs of a segment are exchanged with probability 1/2; how often is the difference greater than the real one?

Both p-values count the real outcome: (hits + 1) / (replicates + 1).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import noise as N

KINDS = ("bootstrap", "randomised")
#: Draws from which on a Poisson variable of mean 1 is more than 0, 1, 2, ...
STEPS = [int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * N.PRIME) for k in range(9)]
#: Segments whose weights are held at once.
BLOCK = 2_048


def resampled(df: DataFrame, key: str, first: str, second: str, width: int, replicates: int, kind: str) -> DataFrame:
    """rep (-1: as it is), a0, a1, ..., b0, b1, ...: the sums of both systems' counts (arrays of `width` numbers) in each replicate."""
    if kind not in KINDS:
        raise ValueError("kind must be one of " + "|".join(KINDS))
    names = [f"{x}{i}" for x in "ab" for i in range(width)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((replicates + 1, 2 * width), np.int64)
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            x, y = (b.column(k).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for k in (1, 2))
            for at in range(0, len(keys), BLOCK):
                own, p, q = keys[at : at + BLOCK], x[at : at + BLOCK], y[at : at + BLOCK]
                draws = np.stack([N.draws(rep, own, np.zeros(len(own), np.int64), 1)[0] for rep in range(replicates)])
                total[0] += np.concatenate([p.sum(0), q.sum(0)])
                if kind == "bootstrap":
                    times = np.searchsorted(STEPS, draws, side="right").astype(np.float64)
                    total[1:] += np.rint(times @ np.concatenate([p, q], 1).astype(np.float64)).astype(np.int64)
                else:
                    moved = np.rint((draws % 2).astype(np.float64) @ (q - p).astype(np.float64)).astype(np.int64)
                    total[1:] += np.concatenate([p.sum(0) + moved, q.sum(0) - moved], 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, replicates, dtype=np.int32)), *(pa.array(c) for c in total.T.copy())], names=["rep", *names])

    schema = "rep int, " + ", ".join(f"{n} bigint" for n in names)
    return df.select(key, first, second).mapInArrow(add, schema).groupBy("rep").agg(*(F.sum(n).alias(n) for n in names))


def p_values(sums: DataFrame, score: Callable[[list[Column]], Column], width: int, kind: str) -> DataFrame:
    """replicates, first, second (the real scores), delta, p_value, from the sums of `resampled` and a score of `width` sums."""
    a, b = (score([F.col(f"{x}{i}") for i in range(width)]) for x in "ab")
    d = sums.select("rep", a.alias("a"), b.alias("b")).withColumn("d", F.col("a") - F.col("b"))
    every = Window.partitionBy()  # a row for each replicate
    real, mean = F.max(F.when(F.col("rep") == -1, F.col("d"))).over(every), F.avg(F.when(F.col("rep") >= 0, F.col("d"))).over(every)
    off = F.abs(F.col("d") - mean) if kind == "bootstrap" else F.abs("d")
    seen = d.withColumn("hit", (F.col("rep") >= 0) & (off > F.abs(real)))
    of_real = lambda c: F.max(F.when(F.col("rep") == -1, F.col(c)))
    n = F.count_if(F.col("rep") >= 0)
    return seen.agg(n.alias("replicates"), of_real("a").alias("first"), of_real("b").alias("second"), of_real("d").alias("delta"), ((F.count_if("hit") + 1) / (n + 1)).alias("p_value"))
