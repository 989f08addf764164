"""Vectors in array columns: search, scaling, pooling, quantisation.

Null vectors, and those with a null or of another length than the first of the queries, are left out of
searches and fits; zero vectors have a cosine of 0 with everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import positions, quantiles

#: Queries held by a task at once; more of them take more passes over the index.
MOST_QUERIES = 8_192


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Of length 1; a zero vector stays."""
    n = norm(a)
    return F.zip_with(a, F.array_repeat(F.when(n > 0, n).otherwise(1.0), F.size(a)), lambda x, y: x.cast("double") / y)  # the norm is found once


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def _matrix(column: pa.Array) -> np.ndarray:
    width = len(column[0]) if len(column) else 0
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def nearest(queries: DataFrame, index: DataFrame, record: str, vector: str, k: int, itself: bool = False) -> DataFrame:
    """query_id, rank, neighbour_id, score: the exact k nearest by cosine, ties by smaller id.

    Queries go to the tasks in blocks of MOST_QUERIES; every partition of the index keeps its own k best for
    each query, so k rows a query and partition are shuffled, not all pairs."""
    spark = index.sparkSession
    whole = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    queries, index = queries.where(whole), index.where(whole)
    blocks = -(-queries.count() // MOST_QUERIES)
    numbered = queries.select(record, vector, F.pmod(F.xxhash64(record), F.lit(max(1, blocks))).alias("block"))
    parts = []
    for block in range(max(1, blocks)):
        rows = numbered.where(F.col("block") == block).select(record, vector).toArrow()
        if not rows.num_rows:
            continue
        held = spark.sparkContext.broadcast((rows.column(0).to_numpy(), _matrix(rows.column(1).combine_chunks())))
        width = len(rows.column(1)[0])

        def best(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, q = held.value
            top: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)
            for b in batches:
                own = b.column(0).to_numpy()
                for at in range(0, len(ids), 512):  # a block of scores at a time
                    scores = np.round(q[at : at + 512] @ _matrix(b.column(1)).T, 9)
                    for i, s in enumerate(scores, at):
                        keep = np.ones(len(own), bool) if itself else own != ids[i]
                        x, y = np.concatenate([top[i][0], own[keep]]), np.concatenate([top[i][1], s[keep]])
                        order = np.lexsort((x, -y))[:k]
                        top[i] = (x[order], y[order])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, [len(t[0]) for t in top])), pa.array(np.concatenate([t[0] for t in top]).astype(np.int64)), pa.array(np.concatenate([t[1] for t in top]))],
                names=["query_id", "neighbour_id", "score"],
            )

        fits = index.where(F.size(vector) == width)
        parts.append(fits.select(F.col(record).cast("bigint"), vector).mapInArrow(best, "query_id bigint, neighbour_id bigint, score double"))
    if not parts:
        return spark.createDataFrame([], "query_id bigint, rank int, neighbour_id bigint, score double")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbour_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", "score")


def _iqr(q: DataFrame, keep: list[str]) -> DataFrame:
    return q.select(*keep, F.get("q", F.lit(1)).alias("median"), F.greatest(F.get("q", F.lit(2)) - F.get("q", F.lit(0)), F.lit(1e-6)).alias("iqr"))


def quartiles(df: DataFrame, vector: str) -> DataFrame:
    """dim, median, iqr (at least 1e-6), exact, from all vectors."""
    x = df.where(F.col(vector).isNotNull()).select(F.posexplode(vector).alias("dim", "x"))
    return _iqr(quantiles(x, ["dim"], "x", [0.25, 0.5, 0.75]), ["dim"])


def capped_quartiles(df: DataFrame, record: str, vector: str, most: int = 200_000) -> DataFrame:
    """The same from the first `most` vectors by id."""
    return quartiles(df.where(F.col(vector).isNotNull()).orderBy(record).limit(most), vector)


def running_quartiles(df: DataFrame, record: str, vector: str, batch: int = 50, momentum: float = 0.9) -> DataFrame:
    """dim, median, iqr, batches: medians and ranges (at least 1e-6) of batches of ids, each blended into those before it.

    The first batch starts the blend; momentum is what is kept of it. A batch's share depends only on how many follow, so
    the blend is a weighted sum, and batches are numbered from the last by ranges, never in one window."""
    x = df.where(F.col(vector).isNotNull()).select(F.floor(F.col(record) / batch).alias("batch"), F.posexplode(vector).alias("dim", "x")).where("x is not null")
    q = x.groupBy("batch", "dim").agg(F.percentile(F.col("x").cast("double"), F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q"))  # a batch is small
    batches = x.select((-F.col("batch")).alias("key")).distinct()
    later = positions(batches, "key", out="later").select((-F.col("key")).alias("batch"), "later")
    n = later.agg(F.count(F.lit(1)).alias("n"))
    share = F.pow(F.lit(momentum), F.col("later")) * F.when(F.col("later") == F.col("n") - 1, 1.0).otherwise(1 - momentum)
    out = _iqr(q, ["batch", "dim"]).join(later.crossJoin(F.broadcast(n)), "batch")  # n is one row
    return out.groupBy("dim").agg(F.sum(share * F.col("median")).alias("median"), F.sum(share * F.col("iqr")).alias("iqr"), F.count(F.lit(1)).cast("int").alias("batches"))


def masked_mean(df: DataFrame, group: str, mask: Column, vector: str) -> DataFrame:
    """group, dim, mean: the mean of a group's vectors where the mask (0 or 1) is set, component by component; 0 where it is set nowhere."""
    x = df.select(group, mask.cast("double").alias("_m"), F.posexplode(vector).alias("dim", "x"))
    return x.groupBy(group, "dim").agg((F.sum(F.col("_m") * F.col("x")) / F.greatest(F.lit(1.0), F.sum("_m"))).alias("mean"))


def stops(df: DataFrame, sequence: str, order: str, vector: str, end: Column, most: float = 0.9) -> DataFrame:
    """sequence, kept, reason: how many vectors of a generated sequence are kept before the first that is like the end vector (`end`), or
    like the one before it (`loop`), by a cosine above `most`; all, and no reason, if none is."""
    w = Window.partitionBy(sequence).orderBy(order)
    seen = df.select(sequence, F.row_number().over(w).alias("_i"), F.lag(vector).over(w).alias("_before"), vector)
    why = F.when(cosine(F.col(vector), end) > most, "end").when(F.col("_before").isNotNull() & (cosine(F.col(vector), F.col("_before")) > most), "loop")
    first = F.min(F.when(F.col("_why").isNotNull(), F.struct(F.col("_i"), F.col("_why"))))
    g = seen.withColumn("_why", why).groupBy(sequence).agg(F.count(F.lit(1)).alias("_n"), first.alias("_f"))
    return g.select(sequence, F.coalesce(F.col("_f._i") - 1, F.col("_n")).cast("int").alias("kept"), F.col("_f._why").alias("reason"))


def scaled(df: DataFrame, vector: str, scale: DataFrame, inverse: bool = False) -> DataFrame:
    """Vectors less the medians, over the interquartile ranges; or back."""
    rows = sorted(scale.collect(), key=lambda r: r["dim"])  # one row a dimension
    m, s = F.array(*(F.lit(r["median"]) for r in rows)), F.array(*(F.lit(r["iqr"]) for r in rows))
    x = F.zip_with(vector, s, (lambda a, b: a.cast("double") * b) if inverse else (lambda a, b: a.cast("double") / b))
    shift = F.zip_with(m, s, lambda a, b: a / b)
    return df.withColumn(vector, F.zip_with(x, m, lambda a, b: a + b) if inverse else F.zip_with(x, shift, lambda a, b: a - b))


def codebooks(df: DataFrame, record: str, vector: str, levels: int, size: int, rounds: int, seed: int = 1) -> np.ndarray:
    """k-means centroids for each level of residuals, fitted on all vectors; an empty cluster keeps its centroid.

    Each level starts from the residuals of vectors drawn by a hash of their ids. A round is a pass over the vectors: every
    partition sums its own by centroid, these sums are added by centroid in the order of the partitions, and one row a
    centroid comes to the driver."""
    whole = df.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    first = whole.orderBy(record, vector).select(F.size(vector)).first()
    if first is None:
        raise ValueError("no vectors to fit")
    whole = whole.where(F.size(vector) == first[0])
    books = np.zeros((0, size, first[0]))
    for level in range(levels):
        drawn = whole.orderBy(F.xxhash64(F.lit(seed + level), record), record, vector).limit(size).select(vector).collect()
        c = np.resize(_residuals(np.array([r[0] for r in drawn], np.float64), books), books.shape[1:])  # fewer vectors than centroids: in turn
        for _ in range(rounds):
            for r in _sums(whole, vector, books, c).collect():
                c[r["centroid"]] = np.array(r["total"]) / r["n"]
        books = np.concatenate([books, c[None]])
    return books


def _sums(whole: DataFrame, vector: str, books: np.ndarray, c: np.ndarray) -> DataFrame:
    """centroid, n, total: how many residuals are nearest to each centroid that has any, and their sum."""
    held = whole.sparkSession.sparkContext.broadcast((books, c))
    kind = "part int, centroid int, n bigint, total array<double>"

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, c = held.value
        n, total = np.zeros(len(c), np.int64), np.zeros(c.shape)
        for b in batches:
            if b.num_rows:
                x = _residuals(b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1), books)
                near = _nearest_centroid(x, c)
                n += np.bincount(near, minlength=len(c))
                np.add.at(total, near, x)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), TaskContext.get().partitionId(), np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(total[at].tolist(), pa.list_(pa.float64()))],
            names=["part", "centroid", "n", "total"],
        )

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("part")
        return pd.DataFrame({"centroid": [f["centroid"].iloc[0]], "n": [f["n"].sum()], "total": [np.stack(f["total"].tolist()).sum(axis=0)]})

    return whole.select(vector).mapInArrow(own, kind).groupBy("centroid").applyInPandas(added, "centroid int, n bigint, total array<double>")


def _residuals(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    for c in books:
        x = x - c[_nearest_centroid(x, c)]
    return x


def _nearest_centroid(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)


def quantised(df: DataFrame, record: str, vector: str, books: np.ndarray) -> DataFrame:
    """record, codes (a centroid for each level), error (squared length of what is left)."""
    held = df.sparkSession.sparkContext.broadcast(books)
    kind = dict(df.dtypes)[record]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column(1).to_pylist(), np.float64)
            codes = []
            for c in held.value:
                codes.append(_nearest_centroid(x, c))
                x = x - c[codes[-1]]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.stack(codes, 1).tolist(), pa.list_(pa.int32())), pa.array((x * x).sum(1))], names=[record, "codes", "error"])

    return df.where(F.col(vector).isNotNull()).select(record, vector).mapInArrow(encode, f"`{record}` {kind}, codes array<int>, error double")


def decoded(codes: DataFrame, record: str, books: np.ndarray, levels: int | None = None) -> DataFrame:
    """record, vector: the sum of the centroids of the first `levels` codes (all by default); an unknown code raises."""
    held = codes.sparkSession.sparkContext.broadcast(books)
    kind, n = dict(codes.dtypes)[record], len(books) if levels is None else levels

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, n), np.int32)
            total = sum((held.value[k][at[:, k]] for k in range(n)), np.zeros((len(at), books.shape[2])))
            offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * books.shape[2])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))], names=[record, "vector"])

    return codes.select(record, "codes").mapInArrow(decode, f"`{record}` {kind}, vector array<double>")


PRIME = (1 << 61) - 1


def rolling_hashes(values: list[int], n: int, base: int = 1_000_000_007) -> list[int]:
    """The polynomial hash of the n values that end at each position, modulo 2**61 - 1; -1 where there are fewer."""
    top = pow(base, n - 1, PRIME)
    out, h = [], 0
    for i, v in enumerate(values):
        if i >= n:
            h -= values[i - n] * top
        h = (h * base + v) % PRIME
        out.append(h if i >= n - 1 else -1)
    return out


def packed(df: DataFrame, record: str, length: str, budget: int, most_rows: int) -> DataFrame:
    """record, length, bin: rows by length, then record, in bins whose rows times their greatest length stay within the budget, and that
    have no more than `most_rows`; a row longer than the budget is alone.

    What comes before a length only matters by how full the last bin is, so the bins are found on the number of rows of each
    length (a row for each length that occurs, on the driver), and a row's bin follows from its place among those of its length."""
    rows = df.where(F.col(length).isNotNull()).select(record, F.col(length).cast("bigint").alias("_l"))
    plan, bin_, filled = [], 0, 0
    for l, n in rows.groupBy("_l").agg(F.count(F.lit(1)).alias("n")).orderBy("_l").toLocalIterator():
        room = max(1, min(most_rows, budget // max(l, 1)))
        if filled >= room:
            bin_, filled = bin_ + 1, 0
        fits = room - filled
        plan.append((l, bin_, fits, room))
        if n <= fits:
            filled += n
        else:
            more = -(-(n - fits) // room)
            bin_, filled = bin_ + more, n - fits - (more - 1) * room
    bins = df.sparkSession.createDataFrame(plan, "_l bigint, _bin bigint, _fits bigint, _room bigint")
    placed = positions(rows, record, by=["_l"], out="_at").join(bins, "_l")
    after = F.floor((F.col("_at") - F.col("_fits")) / F.col("_room")) + 1
    return placed.select(record, F.col("_l").alias(length), F.when(F.col("_at") < F.col("_fits"), F.col("_bin")).otherwise(F.col("_bin") + after).alias("bin"))


def noise_schedule(name: str, steps: int, gamma: float = 1.5, delta: float = -1.0, first: float = 0.001, last: float = 0.0012) -> Column:
    """alpha-bar before rescaling, for a column t from 1 to steps over steps; the quadratic one is its factor 1 - beta."""
    t = F.col("t")
    if name == "cosine":
        s = 0.008
        f = lambda x: F.pow(F.cos((x + s) / (1 + s) * F.pi() / 2), F.lit(2.0))
        return f(t) / f(F.lit(0.0))
    if name == "quadratic":
        a, b = first**0.5, last**0.5
        return 1 - F.pow(F.lit(a) + t * (b - a), F.lit(2.0))
    if name == "sigmoid":
        if gamma <= 0:
            raise ValueError("gamma must be positive")
        eps = 1e-6
        c = F.greatest(F.least(t, F.lit(1 - eps)), F.lit(eps))
        sig = lambda x: 1 / (1 + F.exp(-x))
        logit = lambda x: F.ln(x / (1 - x))
        return sig(delta - gamma * logit(c)) / sig(delta - gamma * logit(F.lit(eps)))
    raise ValueError(f"unknown noise schedule {name}")
