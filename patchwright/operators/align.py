"""Alignment of predicted boundaries with a proxy of the linguistic ones, in one pass over the texts.

Gold boundaries are byte offsets: 0, every word start, and the start of every listed suffix of a word that is
longer than the suffix by more than one character. Words are cut at white space of any kind and before every danda.
Predictions: bytes whose entropy is above a threshold, or fixed chunks. A boundary matches if one of the other side
lies within the tolerance; one may serve many.

Null and empty texts give no row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .entropy import UNSEEN, texts_bytes

# Suffixes of the gold proxy.
SUFFIXES = [
    "ों", "ें", "याँ", "ियाँ", "ता", "ती", "ते", "ना", "ने", "कर", "करना",
    "वाला", "वाली", "वाले", "पन", "कारी", "कार", "ई", "आई", "ता है", "ती है",
]
#: Suffixes that the stand-in for a morphological analyzer takes off.
ANALYZER_SUFFIXES = ["च्या", "साठी", "बद्दल", "पासून", "ला", "ने", "ची", "चे", "ing", "ed", "s"]
_SINGLE = np.zeros(256, bool)
_SINGLE[[*range(9, 14), *range(28, 33)]] = True


def _at(data: np.ndarray, *wanted: int | range) -> np.ndarray:
    """Where a sequence of bytes begins, each one of a value or a range of values."""
    n = max(0, len(data) - len(wanted) + 1)
    ok = np.ones(n, bool)
    for k, w in enumerate(wanted):
        part = data[k : k + n]
        ok &= (part == w) if isinstance(w, int) else (part >= w.start) & (part < w.stop)
    return np.flatnonzero(ok)


def spaces(data: np.ndarray) -> np.ndarray:
    """Marks the bytes of white space of any kind."""
    mask = _SINGLE[data]
    for size, found in (
        (2, (_at(data, 0xC2, 0x85), _at(data, 0xC2, 0xA0))),
        (3, (_at(data, 0xE1, 0x9A, 0x80), _at(data, 0xE2, 0x80, range(0x80, 0x8B)), _at(data, 0xE2, 0x80, range(0xA8, 0xAA)), _at(data, 0xE2, 0x80, 0xAF), _at(data, 0xE2, 0x81, 0x9F), _at(data, 0xE3, 0x80, 0x80))),
    ):
        at = np.concatenate(found)
        for k in range(size):
            mask[at + k] = True
    return mask


def gold_mask(data: np.ndarray, at: np.ndarray, suffixes: list[str]) -> np.ndarray:
    """Marks the gold boundaries of a batch of texts."""
    n = len(data)
    space = spaces(data)
    danda = np.zeros(n + 1, bool)
    danda[_at(data, 0xE0, 0xA5, 0xA4)] = True
    first = np.zeros(n, bool)
    first[at[:-1][np.diff(at) > 0]] = True
    starts = np.flatnonzero(~space & (first | danda[:n] | np.concatenate([[True], space[:-1]])))
    last = np.zeros(n, bool)
    last[at[1:][np.diff(at) > 0] - 1] = True
    ends = np.flatnonzero(~space & (last | danda[1:] | np.concatenate([space[1:], [True]]))) + 1
    mask = first.copy()
    mask[starts] = True
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = points[ends] - points[starts]
    for s in suffixes:
        raw = np.frombuffer(s.encode(), np.uint8)
        ok = (chars > len(s) + 1) & (ends - starts >= len(raw))
        e = ends[ok]
        same = np.ones(len(e), bool)
        for k, byte in enumerate(raw):
            same &= data[e - len(raw) + k] == byte
        mask[e[same] - len(raw)] = True
    return mask


def _near(mask: np.ndarray, owner: np.ndarray, tolerance: int) -> np.ndarray:
    """Marks what lies within the tolerance of a mark of the same text."""
    out = mask.copy()
    for d in range(1, tolerance + 1):
        same = owner[d:] == owner[:-d]
        out[d:] |= mask[:-d] & same
        out[:-d] |= mask[d:] & same
    return out


def aligned(df: DataFrame, record: str, text: str, table: np.ndarray, taus: list[float], chunks: list[int], tolerances: list[int], suffixes: list[str] = SUFFIXES) -> DataFrame:
    """record, method (tau_x or fixed_k), tolerance, n_bytes, n_pred, n_gold, hit_pred, hit_gold."""
    kind = dict(df.dtypes)[record]
    methods = [*(f"tau_{t}" for t in taus), *(f"fixed_{k}" for k in chunks)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = texts_bytes(b.column(1))
            size = np.diff(at)
            some = np.flatnonzero(size > 0)
            if not len(some):
                continue
            owner = np.repeat(np.arange(len(size)), size)
            inner = np.arange(len(data)) - at[owner]
            h = table[data]
            h[at[1:][size > 0] - 1] = UNSEEN
            gold = gold_mask(data, at, suffixes)
            total = lambda m: np.bincount(owner[m], minlength=len(size))[some]
            wide_gold = {t: _near(gold, owner, t) for t in tolerances}
            cols: list[list[np.ndarray]] = [[] for _ in range(8)]
            for name, pred in [*((f"tau_{t}", h > t) for t in taus), *((f"fixed_{k}", (inner > 0) & (inner % k == 0)) for k in chunks)]:
                for t in tolerances:
                    values = (some, np.full(len(some), methods.index(name)), np.full(len(some), t), size[some], total(pred), total(gold), total(pred & wide_gold[t]), total(gold & _near(pred, owner, t)))
                    for c, v in zip(cols, values):
                        c.append(v)
            flat = [np.concatenate(c) for c in cols]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(flat[0])), pa.array([methods[m] for m in flat[1]]), pa.array(flat[2].astype(np.int32)), *(pa.array(v.astype(np.int64)) for v in flat[3:])],
                names=[record, "method", "tolerance", "n_bytes", "n_pred", "n_gold", "hit_pred", "hit_gold"],
            )

    schema = f"`{record}` {kind}, method string, tolerance int, n_bytes bigint, n_pred bigint, n_gold bigint, hit_pred bigint, hit_gold bigint"
    return df.select(record, text).mapInArrow(score, schema)


def with_prf(df: DataFrame, both_empty: float = 1.0) -> DataFrame:
    """precision, recall, f1 from the counts: all `both_empty` if both sides are empty, all 0 if one is."""
    none, one = (F.col("n_pred") == 0) & (F.col("n_gold") == 0), (F.col("n_pred") == 0) | (F.col("n_gold") == 0)
    fill = lambda x: F.when(none, both_empty).when(one, 0.0).otherwise(x)
    out = df.withColumn("precision", fill(F.try_divide("hit_pred", "n_pred"))).withColumn("recall", fill(F.try_divide("hit_gold", "n_gold")))
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("f1", F.coalesce(f1, F.lit(0.0)))


def split_suffix(word: str) -> list[str]:
    """A stand-in for a morphological analyzer: a listed suffix comes off a word longer by two characters or more."""
    for s in sorted(ANALYZER_SUFFIXES, key=len, reverse=True):
        if word.endswith(s) and len(word) > len(s) + 1:
            return [word[: -len(s)], s]
    return [word]


def morpheme_gold(text: str, analyse: Callable[[str], list[str]] = split_suffix) -> list[int]:
    """Byte offsets inside the text where a morpheme or a word ends. Words are runs of letters, marks and digits, and
    single other characters; one the analyzer fails on is taken whole."""
    raw = text.encode()
    found: set[int] = set()
    at = 0
    for token in re.findall(r"[\w\u0900-\u0963]+|[^\w\s]", text):
        piece = token.encode()
        start = raw.find(piece, at)
        if start < 0:
            at += len(piece)
            continue
        try:
            parts = analyse(token)
        except Exception:  # noqa: BLE001
            parts = [token]
        end = start
        for part in parts[:-1]:
            end += len(part.encode())
            found.add(end)
        at = start + len(piece)
        found.add(at)
    return sorted(x for x in found if x < len(raw))


def gold_by_morphemes(df: DataFrame, record: str, text: str, analyse: Callable[[str], list[str]] = split_suffix) -> DataFrame:
    """record, gold: the boundaries of every text; null for null."""
    kind = dict(df.dtypes)[record]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gold = [None if t is None else morpheme_gold(t, analyse) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(gold, pa.list_(pa.int32()))], names=[record, "gold"])

    return df.select(record, text).mapInArrow(find, f"`{record}` {kind}, gold array<int>")


def four_places(col: Column) -> Column:
    """Rounded to four decimals, halves up, by the same arithmetic everywhere."""
    return F.floor(col * 10000 + 0.5) / 10000


def greedy(df: DataFrame, record: str, text: str, table: np.ndarray, tau: float, tolerance: int, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """record, n_pred, n_gold, hits of the one-to-one match."""
    kind = dict(df.dtypes)[record]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = texts_bytes(b.column(1))
            h = table[data]
            h[at[1:][np.diff(at) > 0] - 1] = UNSEEN
            gold = gold_mask(data, at, suffixes)
            rows = []
            for i in range(b.num_rows):
                x, y = at[i], at[i + 1]
                if y > x:
                    pred, wanted = np.flatnonzero(h[x:y] > tau), np.flatnonzero(gold[x:y])
                    rows.append((i, len(pred), len(wanted), _greedy_sorted(pred.tolist(), wanted.tolist(), tolerance)))
            i, p, g, hits = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i, pa.int32())), *(pa.array(c, pa.int64()) for c in (p, g, hits))], names=[record, "n_pred", "n_gold", "hits"])

    return df.select(record, text).mapInArrow(score, f"`{record}` {kind}, n_pred bigint, n_gold bigint, hits bigint")


def _greedy_sorted(pred: list[int], gold: list[int], tolerance: int) -> int:
    """How many predictions, in ascending order, find the nearest gold boundary that is still free, the first of equals; of ascending lists
    only what is near each prediction is looked at."""
    used = [False] * len(gold)
    lo = hits = 0
    for p in pred:
        while lo < len(gold) and gold[lo] < p - tolerance:
            lo += 1
        best, j = -1, lo
        while j < len(gold) and gold[j] <= p + tolerance:
            if not used[j] and (best < 0 or abs(gold[j] - p) < abs(gold[best] - p)):
                best = j
            j += 1
        if best >= 0:
            used[best] = True
            hits += 1
    return hits
