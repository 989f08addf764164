"""Positions, ranks and quantiles in a global order, without one task that sees it all.

Rows go to ranges of their keys (cut points come from an approximate percentile, which decides nothing but how even the
ranges are), totals of the ranges are summed, and only within a range are rows sorted. There are at most MOST_RANGES
ranges, and no more than the rows need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a range should hold, and the most ranges there are: a row for each (and group) is summed in one window.
IN_RANGE, MOST_RANGES = 200_000, 4_096


def ranged(df: DataFrame, key: str, out: str = "_range") -> DataFrame:
    """The rows with the number of the range their key is in; null keys and NaN come last. What is costly to compute should be written first:
    the rows are read to count them, to find the cut points, and to place them."""
    ranges = min(MOST_RANGES, -(-df.count() // IN_RANGE))
    if ranges <= 1:
        return df.withColumn(out, F.lit(0))
    cuts = df.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 4 * MOST_RANGES)).first()[0]
    if not cuts:
        return df.withColumn(out, F.lit(0))
    held = df.sparkSession.sparkContext.broadcast(np.unique(cuts))
    at = df.columns.index(key)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(at)
            own = np.searchsorted(held.value, col.fill_null(0).to_numpy(zero_copy_only=False), side="left")
            own[col.is_null().to_numpy(zero_copy_only=False)] = len(held.value) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32))], names=[*b.schema.names, out])

    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInArrow(place, f"{kinds}, `{out}` int")


def positions(df: DataFrame, key: str, by: list[str] | None = None, weight: Column | None = None, out: str = "position", ties: list[str] | None = None) -> DataFrame:
    """The rows with the sum of the weights (1 each) of those before them in the order of the key (and of `ties`), in each group of `by`."""
    by, w = by or [], F.lit(1).cast("bigint") if weight is None else weight
    rows = ranged(df, key).withColumn("_w", w)
    totals = rows.groupBy(*by, "_range").agg(F.sum("_w").alias("_in"))
    before = F.sum("_in").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_in")
    placed = rows.join(totals.select(*by, "_range", before.alias("_before")), [*by, "_range"])
    inside = F.sum("_w").over(Window.partitionBy(*by, "_range").orderBy(key, *(ties or [])).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w")
    return placed.withColumn(out, F.col("_before") + inside).drop("_w", "_range", "_before")


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """by, n, q: the exact quantiles of a column in each group, between neighbours in proportion; null and NaN don't count.

    Equal values are counted before anything is moved; of these counts only the ranges that a wanted rank is in are sorted."""
    x = df.select(*by, F.col(value).cast("double").alias("_x")).where("_x is not null and not isnan(_x)")
    counts = ranged(x.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_k")), "_x")
    totals = counts.groupBy(*by, "_range").agg(F.sum("_k").alias("_n"))
    group = Window.partitionBy(*by)
    totals = totals.withColumn("_before", F.sum("_n").over(group.orderBy("_range")) - F.col("_n")).withColumn("n", F.sum("_n").over(group))
    place = lambda s: F.lit(s) * (F.col("n") - 1)
    wanted = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(s)), F.ceil(place(s))) for s in shares))))
    hit = totals.withColumn("_wanted", F.filter(wanted, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))).where(F.size("_wanted") > 0)
    near = counts.join(hit.select(*by, "_range", "_before", "n", "_wanted"), [*by, "_range"])
    first = F.col("_before") + F.sum("_k").over(Window.partitionBy(*by, "_range").orderBy("_x")) - F.col("_k")
    found = near.withColumn("_first", first).withColumn("_mine", F.filter("_wanted", lambda r: (r >= F.col("_first")) & (r < F.col("_first") + F.col("_k")))).where(F.size("_mine") > 0)
    at = F.map_from_entries(F.collect_list(F.struct(F.col("_r"), F.col("_x"))))  # two ranks a share at most
    ranks = found.select(*by, "n", "_x", F.explode("_mine").alias("_r")).groupBy(*by, "n").agg(at.alias("_at"))

    def between(s: float) -> Column:
        low, high = F.element_at("_at", F.floor(place(s))), F.element_at("_at", F.ceil(place(s)))
        return low + (high - low) * (place(s) - F.floor(place(s)))

    return ranks.select(*by, "n", F.array(*(between(s) for s in shares)).alias("q"))


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """The rows with the mean of the ranks that equal values share, from counts of distinct values."""
    counts = positions(df.groupBy(value).agg(F.count(F.lit(1)).alias("_n")), value, weight=F.col("_n"), out="_place")
    return df.join(counts.select(value, (F.col("_place") + (F.col("_n") + 1) / 2).alias(out)), value)
