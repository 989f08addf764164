"""Byte statistics: bigram counts, conditional entropy, and what follows from them for each text.

Texts go through Arrow in batches: a byte is a few nanoseconds of numpy, where a column expression would be a
boxed value. Counts are combined in each partition before they are shuffled, and no table here has
more than 65 536 rows whatever the corpus; the entropy table has at most 256 and is sent to the tasks.

Null and empty texts have no bytes: they add nothing to the counts and have 0 patches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Entropy of a byte that was never followed by another, and of every last byte.
UNSEEN = 8.0


def texts_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of a batch of texts, offsets of the texts); null counts as empty."""
    binary = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = binary.buffers()
    at = np.frombuffer(offsets, np.int64)[binary.offset : binary.offset + len(binary) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def byte_counts(df: DataFrame, text: str) -> DataFrame:
    """byte, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for b in batches:
            total += np.bincount(texts_bytes(b.column(0))[0], minlength=256)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["byte", "n"])

    return df.select(text).mapInArrow(count, "byte int, n bigint").groupBy("byte").agg(F.sum("n").alias("n"))


def bigrams(df: DataFrame, text: str) -> DataFrame:
    """prev, next, n: how often a byte follows another within a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(65536, np.int64)
        for b in batches:
            data, at = texts_bytes(b.column(0))
            if len(data) > 1:
                pair = data[:-1].astype(np.int64) * 256 + data[1:]
                inside = np.ones(len(pair), bool)
                ends = at[1:-1] - 1
                inside[ends[(ends >= 0) & (ends < len(pair))]] = False
                total += np.bincount(pair[inside], minlength=65536)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array((found // 256).astype(np.int32)), pa.array((found % 256).astype(np.int32)), pa.array(total[found])], names=["prev", "next", "n"]
        )

    return df.select(text).mapInArrow(count, "prev int, next int, n bigint").groupBy("prev", "next").agg(F.sum("n").alias("n"))


def probabilities(pairs: DataFrame) -> DataFrame:
    """prev, next, n, p: the share of a byte among those that follow another."""
    return pairs.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("prev")))


def conditional_entropy(pairs: DataFrame) -> DataFrame:
    """prev, n, entropy: bits of uncertainty about the byte that follows."""
    return probabilities(pairs).groupBy("prev").agg(F.sum("n").alias("n"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def entropy_table(df: DataFrame, text: str) -> np.ndarray:
    """The entropy for each of the 256 bytes; UNSEEN where none followed."""
    table = np.full(256, UNSEEN)
    for r in conditional_entropy(bigrams(df, text)).collect():  # at most 256 rows
        table[r["prev"]] = max(r["entropy"], 0.0)
    return table


def sweep(df: DataFrame, record: str, text: str, table: np.ndarray, taus: list[float]) -> DataFrame:
    """record, n_bytes, tau, num_patches: a patch closes after each byte whose entropy is above tau, and at the end.

    The last byte always closes one, so the number is one more than the bytes before it that are above."""
    limits = np.array(taus)
    passed = np.searchsorted(np.sort(limits), table, side="left")  # how many thresholds each byte's entropy is above
    place = np.searchsorted(np.sort(limits), limits) + 1
    kind = dict(df.dtypes)[record]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = texts_bytes(b.column(1))
            n = np.diff(at)
            rows = np.repeat(np.arange(len(n)), len(limits))
            inner = np.ones(len(data), bool)
            inner[at[1:][n > 0] - 1] = False  # the last byte closes a patch whatever its entropy
            owner = np.repeat(np.arange(len(n)), n)[inner]
            hits = np.bincount(owner * (len(limits) + 1) + passed[data[inner]], minlength=len(n) * (len(limits) + 1)).reshape(len(n), -1)
            above = [np.where(n > 0, 1 + hits[:, k:].sum(axis=1), 0) for k in place]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows)), pa.array(np.repeat(n, len(limits))), pa.array(np.tile(limits, len(n))), pa.array(np.stack(above, 1).ravel().astype(np.int64))],
                names=[record, "n_bytes", "tau", "num_patches"],
            )

    return df.select(record, text).mapInArrow(count, f"`{record}` {kind}, n_bytes bigint, tau double, num_patches bigint")


def entropies(df: DataFrame, record: str, text: str, table: np.ndarray) -> DataFrame:
    """record, entropies: one for each byte, UNSEEN for the last."""
    kind = dict(df.dtypes)[record]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = texts_bytes(b.column(1))
            h = table[data]
            h[at[1:][np.diff(at) > 0] - 1] = UNSEEN
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[record, "entropies"])

    return df.select(record, text).mapInArrow(score, f"`{record}` {kind}, entropies array<double>")


def character_offsets(df: DataFrame, record: str, text: str) -> DataFrame:
    """record, offsets: where each character of a text begins in its bytes; null for null."""
    kind = dict(df.dtypes)[record]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = texts_bytes(b.column(1))
            first = np.flatnonzero((data & 0xC0) != 0x80)
            owner = np.searchsorted(at, first, side="right") - 1
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=b.num_rows))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array((first - at[owner]).astype(np.int32)), mask=b.column(1).is_null())
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[record, "offsets"])

    return df.select(record, text).mapInArrow(find, f"`{record}` {kind}, offsets array<int>")


def reset_entropies(df: DataFrame, record: str, text: str, table: np.ndarray) -> DataFrame:
    """record, entropies: as `entropies`, but with the context reset at each newline: the byte that ends a line, as the last one, is
    followed by nothing. Lines are scored apart and put together again, one value for each byte."""
    kind = dict(df.dtypes)[record]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = texts_bytes(b.column(1))
            h = table[data]
            h[at[1:][np.diff(at) > 0] - 1] = UNSEEN
            h[data == 10] = UNSEEN
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h))], names=[record, "entropies"])

    return df.select(record, text).mapInArrow(score, f"`{record}` {kind}, entropies array<double>")


def group_bits(df: DataFrame, group: str, text: str, table: np.ndarray) -> DataFrame:
    """group, bits: the entropies of all bytes of a group's texts, summed in each partition first."""
    kind = dict(df.dtypes)[group]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = texts_bytes(b.column(1))
            h = table[data]
            h[at[1:][np.diff(at) > 0] - 1] = UNSEEN
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.bincount(np.repeat(np.arange(b.num_rows), np.diff(at)), weights=h, minlength=b.num_rows))], names=[group, "bits"])

    return df.select(group, text).mapInArrow(add, f"`{group}` {kind}, bits double").groupBy(group).agg(F.sum("bits").alias("bits"))
