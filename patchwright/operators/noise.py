"""Reproducible noise on characters and on byte ids, for whole batches of texts at once.

A draw depends on (seed, key of the text, position, number of the draw) only, through squares modulo a Mersenne
prime: integers of 64 bits do in every engine, so SQL can repeat it, and no generator has to be carried along.

Defined results: null stays null, an empty text stays empty; a share of 0 changes nothing; white space is never changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PRIME = (1 << 31) - 1

# Signs that noise may delete, and the characters it puts in for those of each script.
MATRAS = "ािीुूृॄॅॆेैॉॊोौ्ॎॏंँः"
DEVANAGARI = "अआइईउऊएऐओऔकखगघचछजझटठडढतथदधनपफबभमयरलवशषसह" + MATRAS
ASCII = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
# Code points that are white space.
WHITE = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _points(letters: str) -> np.ndarray:
    return np.array([ord(c) for c in letters], np.uint32)


_MATRAS, _DEVANAGARI, _ASCII, _WHITE = _points(MATRAS), _points(DEVANAGARI), _points(ASCII), np.array(WHITE, np.uint32)


def squared(x: np.ndarray, a: int) -> np.ndarray:
    """x * x + a * x + 1 modulo PRIME, for 0 <= x < PRIME; what is beyond 31 bits is added to them, as 2 ** 31 is 1 there."""
    y = (x + a) * x + 1
    y = (y & PRIME) + (y >> 31)
    y = (y & PRIME) + (y >> 31)
    return np.where(y >= PRIME, y - PRIME, y)


def draws(seed: int, key: np.ndarray, position: np.ndarray, n: int) -> list[np.ndarray]:
    """n numbers below PRIME for each (key, position)."""
    x = squared(squared((key % PRIME * 1103515245 + position * 12345 + seed * 69069) % PRIME, 40014), 40692)
    out = []
    for _ in range(n):
        x = squared(x, 48271)
        out.append(x)
    return out


def limit(share: float) -> int:
    """A draw below it comes with the probability `share`."""
    return int(share * PRIME)


def decoded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, offsets of the texts)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(sizes)])


def hits(at: np.ndarray, keys: np.ndarray, seed: int) -> np.ndarray:
    """The first draw of each character of the texts: noise of any share changes those whose draw is below its limit."""
    sizes = np.diff(at)
    return draws(seed, np.repeat(keys, sizes), np.arange(at[-1]) - np.repeat(at[:-1], sizes), 1)[0]


def struck(points: np.ndarray, hit: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(code points, whether each is deleted) under noise: of the characters that a draw hits, signs are deleted in half of the cases, all
    others (and these else) replaced by one of their script."""
    out, gone = points.copy(), np.zeros(len(points), bool)
    at = np.flatnonzero(hit < limit(share))
    at = at[~np.isin(points[at], _WHITE)]
    was, half = points[at], squared(hit[at], 48271)
    pick = squared(half, 48271)
    out[at] = np.where((was >= 0x900) & (was <= 0x97F), _DEVANAGARI[pick % len(_DEVANAGARI)], _ASCII[pick % len(_ASCII)])
    gone[at] = (half % 2 == 0) & np.isin(was, _MATRAS)
    return out, gone


def noised(points: np.ndarray, at: np.ndarray, keys: np.ndarray, share: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with noise."""
    if share <= 0 or not len(points):
        return points, at
    out, gone = struck(points, hits(at, keys, seed), share)
    return out[~gone], at - np.concatenate([[0], np.cumsum(gone)])[at]


def encoded(points: np.ndarray, at: np.ndarray) -> list[str]:
    whole = points.tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def characters(df: DataFrame, key: str, text: str, shares: dict[str, float], seed: int) -> DataFrame:
    """key, and a column of noised texts for each name and share."""
    kind = dict(df.dtypes)[key]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            none = np.array([t is None for t in texts], bool)
            points, at = decoded([t or "" for t in texts])
            keys = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            cols = [pa.array(np.array(encoded(*noised(points, at, keys, p, seed)), object), pa.string(), mask=none) for p in shares.values()]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[key, *shares])

    return df.select(key, text).mapInArrow(make, f"`{key}` {kind}, " + ", ".join(f"`{n}` string" for n in shares))


def byte_ids(df: DataFrame, key: str, text: str, share: float, seed: int, unknown: int = 3, offset: int = 4) -> DataFrame:
    """key, ids: the byte ids of every text (null for null), a share of them replaced by the unknown id. Padding (0) never is; texts have none."""
    kind = dict(df.dtypes)[key]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .entropy import texts_bytes

        for b in batches:
            data, at = texts_bytes(b.column(1))
            owner = np.repeat(np.arange(b.num_rows), np.diff(at))
            keys = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = draws(seed, keys[owner], np.arange(len(data)) - at[owner], 1)[0] < limit(share)
            ids = np.where(hit, unknown, data.astype(np.int32) + offset).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids), mask=b.column(1).is_null())
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[key, "ids"])

    return df.select(key, text).mapInArrow(make, f"`{key}` {kind}, ids array<int>")


def grid(df: DataFrame, key: str, text: str, cells: list[tuple[int, float]]) -> DataFrame:
    """key, seed, noise, hyp, ref: every text (null ones left out), noised for each cell (seed, noise)."""
    kind = dict(df.dtypes)[key]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points, at = decoded(b.column(1).to_pylist())
            keys = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for seed, noise in cells:
                cell = [pa.array(np.full(len(keys), seed, np.int32)), pa.array(np.full(len(keys), noise))]
                yield pa.RecordBatch.from_arrays([b.column(0), *cell, pa.array(encoded(*noised(points, at, keys, noise, seed)), pa.string()), b.column(1)], names=[key, "seed", "noise", "hyp", "ref"])

    return df.where(df[text].isNotNull()).select(key, text).mapInArrow(make, f"`{key}` {kind}, seed int, noise double, hyp string, ref string")
