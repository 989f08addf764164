"""Percentiles with a stated rank error from summaries that can be merged.

Method: deterministic rank-interval tuples. A summary holds values with the least and the greatest rank each
may have. A partition sorts the values of a group it has; summaries merge by adding the rank intervals of
their neighbours, and are compressed by what uncertainty is permitted. A summary of level l may be off by
epsilon (1 - 2 ** -(l + 1)) of its values: each merge adds half of what is left, so the bound holds
however often summaries are merged, and days combine to runs by the same merge. Merging goes up a tree of at most
FAN_IN children a node, so a hot group, or one in very many partitions, never meets in one task but as
a few summaries of bounded size.

Bound: ``rank_error`` is the most ranks by which the value given for a percentile may be off, at most ``epsilon`` of
the values; groups of no more than 1 / epsilon values are kept whole, with an error of 0.

Defined results: null and NaN values don't count; a group without any value gives no row; ties count each;
repeated rows count each; a null group key is a group of its own; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .workspace import written

#: The share of a group's values by which a rank may be off.
EPSILON = 0.005
FAN_IN = 32
#: Values that a task holds before it summarises them.
MOST_HELD = 4_000_000
PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
SUMMARY = "v array<double>, lo array<bigint>, hi array<bigint>, n bigint, level int"
_FIELDS = ["v", "lo", "hi", "n", "level"]
_LISTS = [pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
Summary = tuple[np.ndarray, np.ndarray, np.ndarray, int, int]


def permitted(n: int, level: int, epsilon: float) -> int:
    """By how many ranks a summary of this level may be off."""
    return int(epsilon * (1 - 2.0 ** -(level + 1)) * n)


def compress(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int, off: int, whole: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As few tuples as answer every rank to within `off`; all of them if there are no more than `whole`."""
    if len(v) <= whole or off < 1:
        return v, lo, hi
    at, last = [0], len(v) - 1
    while at[-1] < last:  # the farthest tuple that leaves no rank between it and the one before unanswered
        at.append(max(at[-1] + 1, int(np.searchsorted(hi, lo[at[-1]] + 2 * off + 1, side="right")) - 1))
    return v[at], lo[at], hi[at]


def exact(values: np.ndarray, epsilon: float = EPSILON) -> Summary:
    """The summary of sorted values: their ranks are known."""
    n = len(values)
    ranks = np.arange(1, n + 1)
    return (*compress(values, ranks, ranks, n, permitted(n, 0, epsilon), int(1 / epsilon)), n, 0)


def merge(parts: list[Summary], epsilon: float = EPSILON) -> Summary:
    """Rank intervals of all parts together: each tuple adds what it knows of the other parts' neighbours."""
    if len(parts) == 1:
        return parts[0]
    v = np.concatenate([p[0] for p in parts])
    lo = np.concatenate([p[1] for p in parts]).astype(np.int64)
    hi = np.concatenate([p[2] for p in parts]).astype(np.int64)
    part = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    order = np.lexsort((part, v))  # ties: an earlier part's come first, which is an order as good as any
    place = np.empty(len(v), np.int64)
    place[order] = np.arange(len(v))
    first = 0
    for k, (pv, plo, phi, pn, _) in enumerate(parts):
        own = place[first : first + len(pv)]  # where this part's tuples stand among all, ascending
        before = np.searchsorted(own, place, side="left")
        other = part != k
        below = np.where(before > 0, plo[np.maximum(before - 1, 0)], 0)
        above = np.where(before < len(pv), phi[np.minimum(before, len(pv) - 1)] - 1, pn)
        lo += np.where(other, below, 0)
        hi += np.where(other, above, 0)
        first += len(pv)
    n, level = sum(p[3] for p in parts), 1 + max(p[4] for p in parts)
    return (*compress(v[order], lo[order], hi[order], n, permitted(n, level, epsilon), int(1 / epsilon)), n, level)


def _gathered(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def partials(df: DataFrame, keys: list[str], columns: list[str], arrays: list[str], epsilon: float = EPSILON) -> DataFrame:
    """keys, measure, v, lo, hi, n, level, part: a summary of every group and measure in each partition (or in MOST_HELD values of it)."""
    kinds = dict(df.dtypes)
    measures = [*columns, *arrays]
    types = [to_arrow_type(df.schema[k].dataType) for k in keys]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n, part = 0, TaskContext.get().partitionId() << 32
        for b in batches:
            frame = pa.Table.from_batches([b]).select(keys).to_pandas(date_as_object=True).astype(object)
            code, groups = pd.factorize(pd.MultiIndex.from_frame(frame) if len(keys) > 1 else frame[keys[0]], use_na_sentinel=False)
            names = [tuple(None if pd.isna(x) else x for x in (g if isinstance(g, tuple) else (g,))) for g in groups]
            own = np.array([known.setdefault(g, len(known)) for g in names], np.int64)[code] * len(measures)
            for m, name in enumerate(measures):
                col, owner = b.column(b.schema.get_field_index(name)), own
                if name in arrays:
                    owner = np.repeat(own, col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                    col = col.flatten()
                x = col.cast(pa.float64()).to_numpy(zero_copy_only=False)
                ok = ~np.isnan(x)
                held.append((owner[ok] + m, x[ok]))
                n += len(held[-1][1])
            if n > MOST_HELD:
                yield from summaries(known, held, part)
                known, held, n, part = {}, [], 0, part + 1
        if n:
            yield from summaries(known, held, part)

    def summaries(known: dict[tuple, int], held: list[tuple[np.ndarray, np.ndarray]], part: int) -> Iterator[pa.RecordBatch]:
        owner, x = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((x, owner))
        owner, x = owner[order], x[order]
        ids, first, size = np.unique(owner, return_index=True, return_counts=True)
        names = list(known)
        small = size <= int(1 / epsilon)
        whole = np.repeat(small, size)
        rank = np.arange(len(x)) - np.repeat(first, size) + 1
        for rows, lists, counts in (
            (np.flatnonzero(small), [_gathered(c[whole], size[small]) for c in (x, rank, rank)], size[small]),
            (np.flatnonzero(~small), None, size[~small]),
        ):
            if not len(rows):
                continue
            if lists is None:
                made = [exact(x[first[i] : first[i] + size[i]], epsilon) for i in rows]
                lists = [pa.array([d[k] for d in made], _LISTS[k]) for k in range(3)]
            key = [names[i // len(measures)] for i in ids[rows]]
            cols = [pa.array([k[j] for k in key], types[j]) for j in range(len(keys))] + [pa.array([measures[i % len(measures)] for i in ids[rows]], pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *lists, pa.array(counts), pa.array(np.zeros(len(rows), np.int32)), pa.array(np.full(len(rows), part))], names=[*keys, "measure", *_FIELDS, "part"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", measure string, {SUMMARY}, part bigint"
    return df.select(*keys, *measures).mapInArrow(summarise, schema)


def _rows(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column as arrays, without a copy of their values."""
    values, at = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(values, at[:-1]) if len(at) else []


def merged(parts: DataFrame, keys: list[str], epsilon: float = EPSILON) -> DataFrame:
    """One summary for each group of the keys and measure, up a tree of FAN_IN summaries a node.

    `parts` is read twice (for the number of parts of the largest group, then to merge them), so it should be a written table."""
    groups = [*keys, "measure"]
    kinds = dict(parts.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in groups) + f", {SUMMARY}"

    def fold(batches: Iterator[pa.RecordBatch], more: int) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from folded(b, len(groups) + more)

    def folded(b: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
        names = [*b.schema.names[:k], *_FIELDS]
        count = b.column(k).value_lengths().to_numpy(zero_copy_only=False)
        first = np.cumsum(count) - count
        flat = b.column(k).flatten()
        v, lo, hi, n, level = (flat.field(x) for x in _FIELDS)
        sizes, n, level = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), n.to_numpy(zero_copy_only=False), level.to_numpy(zero_copy_only=False)
        if not len(count):
            return
        total, held = np.add.reduceat(n, first), np.add.reduceat(sizes, first)
        alone = count == 1
        known = ~alone & (total == held) & (total <= int(1 / epsilon))  # every value is there: the merge is a sort
        if alone.any():  # nothing to merge
            at = pa.array(first[alone])
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(np.flatnonzero(alone))) for i in range(k)), *(flat.field(x).take(at) for x in _FIELDS)], names=names)
        if known.any():
            own = np.repeat(np.repeat(np.arange(len(count)), count), sizes)
            keep = known[own]
            x, own = v.flatten().to_numpy(zero_copy_only=False)[keep], own[keep]
            x = x[np.lexsort((x, own))]
            size = total[known]
            rank = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size) + 1
            cols = [_gathered(c, size) for c in (x, rank, rank)]
            up = pa.array((np.maximum.reduceat(level, first)[known] + 1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(np.flatnonzero(known))) for i in range(k)), *cols, pa.array(size), up], names=names)
        rest = np.flatnonzero(~alone & ~known)
        if len(rest):
            lists = list(zip(_rows(v), _rows(lo), _rows(hi), n.tolist(), level.tolist()))
            done = [merge(lists[first[i] : first[i] + count[i]], epsilon) for i in rest]
            cols = [pa.array([d[j] for d in done], t) for j, t in enumerate([*_LISTS, pa.int64(), pa.int32()])]
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(rest)) for i in range(k)), *cols], names=names)

    packed = F.collect_list(F.struct(*_FIELDS)).alias("parts")  # about FAN_IN summaries at most
    most = parts.groupBy(*groups).agg(F.count(F.lit(1)).alias("parts")).agg(F.max("parts")).first()[0] or 0
    steps = max(1, math.ceil(math.log(max(most, 1), FAN_IN) - 1e-9))
    out, leaf = parts, [c for c in parts.columns if c not in (*groups, *_FIELDS)]  # what tells the parts of a group apart
    for step in range(1, steps):
        node = F.pmod(F.xxhash64(F.lit(step), *leaf), F.lit(math.ceil(most / FAN_IN**step)))
        out = out.withColumn("_node", node).groupBy(*groups, "_node").agg(packed).mapInArrow(lambda x: fold(x, 1), schema.replace(", v array", ", _node bigint, v array"))
        leaf = ["_node"]
    return out.groupBy(*groups).agg(packed).mapInArrow(lambda x: fold(x, 0), schema)


def percentiles(summaries: DataFrame, keys: list[str], at: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """keys, measure, percentile, value, n, rank_error (the most ranks the value may be off), error (as a share of n)."""
    groups = [*keys, "measure"]
    kinds = dict(summaries.dtypes)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(groups)
        for b in batches:
            if not b.num_rows:
                continue
            v, lo, hi = (b.column(k + i).flatten().to_numpy(zero_copy_only=False) for i in range(3))
            sizes = b.column(k).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            n = b.column(k + 3).to_numpy(zero_copy_only=False)
            first, row = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
            for q in at:
                rank = np.maximum(1, np.minimum(n, np.ceil(q * n - 1e-9).astype(np.int64)))
                off = np.maximum(np.maximum(rank[row] - lo, hi - rank[row]), 0)
                least = np.minimum.reduceat(off, first)
                hit = np.flatnonzero(off == least[row])
                best = hit[np.unique(row[hit], return_index=True)[1]]  # of equals the first
                yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(np.full(len(n), q)), pa.array(v[best]), pa.array(n), pa.array(least)], names=[*groups, "percentile", "value", "n", "rank_error"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in groups) + ", percentile double, value double, n bigint, rank_error bigint"
    return summaries.select(*groups, "v", "lo", "hi", "n").mapInArrow(answer, schema).withColumn("error", F.round(F.col("rank_error") / F.col("n"), 9))


def summarised(df: DataFrame, keys: list[str], columns: list[str], arrays: list[str], epsilon: float = EPSILON) -> DataFrame:
    """One summary for each group and measure of a table, written."""
    return written(merged(written(partials(df, keys, columns, arrays, epsilon), "summaries"), keys, epsilon), "summaries")
