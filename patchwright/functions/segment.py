"""Boundary rules over arrays, as Column functions. Positions count from 0.

There are three conventions, kept apart on purpose: ``boundaries_global`` and ``boundaries_monotonic`` start a
patch at k by what the entropy before k says and always start one at 0 and 1; the sweep (operators.entropy)
closes a patch after a byte; ``boundaries_above`` names the bytes themselves. Empty arrays have no boundaries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("global", "monotonic")


def _positions(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def boundaries_global(entropy: Column, threshold: Column) -> Column:
    """0, 1 and every k whose preceding entropy is above the threshold."""
    return F.filter(_positions(F.size(entropy)), lambda k: (k < 2) | (F.get(entropy, k - 1) > threshold))


def boundaries_monotonic(entropy: Column, rise: Column) -> Column:
    """0, 1 and every k before which the entropy rose by more than the threshold."""
    return F.filter(_positions(F.size(entropy)), lambda k: (k < 2) | (F.get(entropy, k - 1) - F.get(entropy, k - 2) > rise))


def boundaries(entropy: Column, mode: str, threshold: Column) -> Column:
    if mode not in MODES:
        raise ValueError("mode must be one of " + "|".join(MODES))
    return boundaries_global(entropy, threshold) if mode == "global" else boundaries_monotonic(entropy, threshold)


def boundaries_above(entropy: Column, threshold: Column) -> Column:
    """Every byte whose entropy is above the threshold."""
    return F.filter(_positions(F.size(entropy)), lambda k: F.get(entropy, k) > threshold)


def lengths(starts: Column, n: Column) -> Column:
    """Patch lengths from their starts: up to the next start, the last up to n."""
    return F.transform(starts, lambda s, i: F.coalesce(F.get(starts, i + 1), n) - s)


def patch_records(starts: Column, entropy: Column) -> Column:
    """patch_index, byte_start, byte_end, length_bytes, entropy_at_boundary, mean_entropy of every patch."""
    n = F.size(entropy)

    def record(s: Column, i: Column) -> Column:
        end = F.coalesce(F.get(starts, i + 1), n)
        mean = F.aggregate(F.slice(entropy, s + 1, end - s), F.lit(0.0), lambda a, x: a + x) / (end - s)
        return F.struct(
            i.alias("patch_index"), s.alias("byte_start"), end.alias("byte_end"), (end - s).alias("length_bytes"),
            F.get(entropy, s).alias("entropy_at_boundary"), mean.alias("mean_entropy"),
        )

    return F.transform(starts, record)


def fixed_chunks(n: Column, k: int) -> Column:
    """k, 2k, ... below n."""
    return F.when(n - 1 >= k, F.sequence(F.lit(k), n - 1, F.lit(k))).otherwise(F.array().cast("array<int>"))


def newline_segments(text: Column) -> Column:
    """Parts that end after each newline, which they keep."""
    return F.filter(F.split(text, r"(?<=\n)"), lambda s: s != "")


def training_chunks(n: Column, length: int) -> Column:
    """(start, size) of chunks of length + 1 bytes, each beginning with the last byte of the one before; of two bytes or more."""
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(length))).otherwise(F.array().cast("array<int>"))
    chunks = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(F.lit(length + 1), n - s).alias("size")))
    return F.filter(chunks, lambda c: c["size"] >= 2)


def teacher_forced(tokens: Column, bos: int = 1, eot: int = 2, longest: int = 512) -> Column:
    """(input, target): the tokens after a begin mark, and before an end mark, cut to the same length."""
    return F.struct(
        F.slice(F.concat(F.array(F.lit(bos)), tokens), 1, longest).alias("input"),
        F.slice(F.concat(tokens, F.array(F.lit(eot))), 1, longest).alias("target"),
    )


def windows(n: Column, length: int) -> Column:
    """(src, dst_start, dst_end) of windows of `length` bytes with at least half of it as left context; the dst parts tile 0..n."""
    half = length // 2
    more = F.when(n > length, F.transform(F.sequence(F.lit(0), F.ceil((n - length) / half).cast("int") - 1), lambda i: i)).otherwise(F.array().cast("array<int>"))
    first = F.array(F.struct(F.lit(0).alias("src"), F.lit(0).alias("dst_start"), F.least(n, F.lit(length)).alias("dst_end")))
    rest = F.transform(
        more,
        lambda i: F.struct(
            (length + i * half - half).alias("src"), (length + i * half).alias("dst_start"), F.least(length + (i + 1) * half, n).alias("dst_end")
        ),
    )
    return F.when(n > 0, F.concat(first, rest)).otherwise(F.slice(first, 1, 0))


def matched(query: Column, ref: Column, tolerance: int) -> Column:
    """How many of the sorted query positions have a ref position within the tolerance (one may serve many)."""
    near = F.array_distinct(F.flatten(F.transform(ref, lambda r: F.sequence(r - tolerance, r + tolerance))))
    return F.size(F.array_intersect(query, near))


def prf(pred: Column, gold: Column, tolerance: int) -> Column:
    """precision, recall, f1 of distinct positions: all 1 if both sides are empty, all 0 if one is."""
    np_, ng = F.size(pred), F.size(gold)
    p, r = matched(pred, gold, tolerance) / np_, matched(gold, pred, tolerance) / ng
    fill = lambda x: F.when((np_ == 0) & (ng == 0), 1.0).when((np_ == 0) | (ng == 0), 0.0).otherwise(x)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return F.struct(fill(p).alias("precision"), fill(r).alias("recall"), fill(f1).alias("f1"))
