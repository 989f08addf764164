"""Append-only logs that can be resumed: idempotent appends, latest rows, memoised stages, retention.

A log is a folder of parquet under a fingerprint of what affects its results, so a changed configuration never
meets old rows. Spark's commit protocol leaves no torn tail: files of a failed write aren't listed.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.order import positions
from ..sources.shared import exists
from ..sources.tables import fingerprint


class Log:
    """Rows with a unique key under a fingerprint."""

    def __init__(self, spark: SparkSession, folder: str, key: str, config: dict, ignore: tuple[str, ...] = ()):
        self.spark, self.key = spark, key
        self.path = f"{folder}/{fingerprint(config, ignore)}"

    def exists(self) -> bool:
        return exists(self.spark, self.path + "/_SUCCESS")

    def pending(self, df: DataFrame) -> DataFrame:
        """The rows whose key isn't written yet; of rows with the same key the one with the least hash."""
        w = Window.partitionBy(self.key).orderBy(F.xxhash64(*(F.col(c).cast("string") for c in df.columns)))
        df = df.withColumn("_copy", F.row_number().over(w)).where("_copy = 1").drop("_copy")
        if not self.exists():
            return df
        return df.join(self.spark.read.parquet(self.path).select(self.key), self.key, "left_anti")

    def append(self, df: DataFrame) -> None:
        """Write what is missing; doing it again changes nothing."""
        self.pending(df).write.mode("append").parquet(self.path)

    def rows(self, ordered: bool = False) -> DataFrame:
        df = self.spark.read.parquet(self.path)
        return df.orderBy(self.key) if ordered else df

    def follow(self, stream: DataFrame, checkpoint: str):
        """A streaming query that appends each micro-batch idempotently, also when it is replayed."""
        return stream.writeStream.foreachBatch(lambda df, _: self.append(df)).option("checkpointLocation", checkpoint)


def memo(spark: SparkSession, folder: str, stage: str, config: dict, build: Callable[[], DataFrame], valid: Callable[[DataFrame], bool] | None = None) -> DataFrame:
    """The table of a stage: read if it was built under this configuration and is valid, built and written otherwise."""
    path = f"{folder}/{fingerprint(config)}/{stage}"
    if exists(spark, path + "/_SUCCESS"):  # a table that can't be read raises; it isn't built over
        df = spark.read.parquet(path)
        if valid is None or valid(df):
            return df
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; the rank is cut before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*(c.desc() for c in order))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def upserted(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Changes in place of the rows with their key, others appended."""
    return base.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes)


def pruned(published: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Published rows that still have a source."""
    return published.join(source.select(key).distinct(), key, "left_semi")


def kept_checkpoints(df: DataFrame, group: str, name: str, keep: int) -> DataFrame:
    """The newest checkpoints of each group by the number in their name, never by its spelling."""
    step = F.regexp_extract(name, r"(\d+)", 1).try_cast("bigint")
    w = Window.partitionBy(group).orderBy(step.desc_nulls_last(), F.col(name))
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= keep).drop("_rank")


def epoch_order(df: DataFrame, key: str, seed: int, epoch: int, skip: int = 0) -> DataFrame:
    """The rows with their position in an order that depends on seed, epoch and key only, from `skip` on."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), F.col(key).cast("string"))), 1, 15), 16, 10).cast("bigint")
    return positions(df.withColumn("_h", h), "_h", ties=[key]).where(F.col("position") >= skip).drop("_h")


def shuffled_cap(df: DataFrame, key: str, seed: int, limit: int, fraction: float) -> DataFrame:
    """The first int(limit * fraction) rows of a shuffled order."""
    return epoch_order(df, key, seed, 0).where(F.col("position") < int(limit * fraction)).drop("position")


def scan_summary(df: DataFrame, group: str) -> DataFrame:
    """What a scan of patch records adds up to by group: sentences, bytes, patches, the least and greatest of each, how many were empty. Sums
    and extremes only, so it takes the same memory over a stream (complete or update mode) as over what is already written."""
    n, p = F.col("num_bytes"), F.col("num_patches")
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("sentences"), F.sum(n).alias("bytes"), F.sum(p).alias("patches"), F.min(p).alias("least"), F.max(p).alias("most"), F.count_if(p == 0).alias("empty"),
        F.sum(p.cast("double") * p).alias("squares"),
    )


def finished_summary(sums: DataFrame) -> DataFrame:
    """Means, the population deviation and the bytes a patch of what `scan_summary` added up."""
    k = F.col("sentences")
    mean = F.col("patches") / k
    return sums.withColumn("mean_patches", mean).withColumn("std_patches", F.sqrt(F.greatest(F.col("squares") / k - mean * mean, F.lit(0.0)))).withColumn("bytes_per_patch", F.try_divide("bytes", "patches")).drop("squares")


def ema(series: Column, alpha: float = 0.1) -> Column:
    """The exponential moving average at the end of an ordered array; null and NaN are passed over."""
    step = lambda a, x: F.when(x.isNull() | F.isnan(x), a).when(a.isNull(), x).otherwise(alpha * x + (1 - alpha) * a)
    return F.aggregate(series, F.lit(None).cast("double"), step)


def plateau(df: DataFrame, group: str, order: str, loss: str, min_delta: float, patience: int) -> DataFrame:
    """group, best, best_at, stopped_at: a run stops once `patience` observations in a row don't beat the best by min_delta.

    The best depends on all observations before, so a run's are folded in order; a run is a bounded series."""
    item = F.struct(F.col(order).alias("o"), F.when(~F.isnan(loss), F.col(loss)).alias("x"))
    runs = df.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("s"))
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(None).cast(dict(df.dtypes)[order]).alias("at"), F.lit(0).alias("since"), F.lit(None).cast(dict(df.dtypes)[order]).alias("stop"))

    def step(a: Column, x: Column) -> Column:
        better = x["x"].isNotNull() & (a["best"].isNull() | (x["x"] < a["best"] - min_delta))
        since = F.when(better, 0).otherwise(a["since"] + 1)
        live = a["stop"].isNull()
        return F.struct(
            F.when(live & better, x["x"]).otherwise(a["best"]).alias("best"), F.when(live & better, x["o"]).otherwise(a["at"]).alias("at"), since.alias("since"),
            F.when(live & (since >= patience), x["o"]).otherwise(a["stop"]).alias("stop"),
        )

    folded = runs.select(group, F.aggregate("s", start, step).alias("a"))
    return folded.select(group, F.col("a.best").alias("best"), F.col("a.at").alias("best_at"), F.col("a.stop").alias("stopped_at"))


def tumbling(df: DataFrame, ts: str, keys: list[str], width: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts and sums by window; on a stream, events later than `late` are left out."""
    if late and df.isStreaming:
        df = df.withWatermark(ts, late)
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return df.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(df: DataFrame, ts: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    if late and df.isStreaming:
        df = df.withWatermark(ts, late)
    return df.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def first_seen(stream: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """A stream without the repeats of a key that come within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def record(values: dict) -> str:
    """A run record as JSON with sorted keys."""
    return json.dumps(values, sort_keys=True, default=str)
