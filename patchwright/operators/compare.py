"""Comparison tables over metric rows (model, fraction, noise, metrics ...), and joins that check what they join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import model_name

NEGLIGIBLE, LEVEL = 1e-6, 0.05


def near(a: Column, b: Column | float) -> Column:
    """Equal up to 1e-9."""
    return F.abs(a - b) < 1e-9


def cell_key(col: Column) -> Column:
    """A float as a join key: six decimals."""
    return F.round(col.cast("double"), 6)


def complete(df: DataFrame, models: list[str], noises: list[float], model: str = "model", noise: str = "noise") -> DataFrame:
    """The rows, if every model has every noise; raises with the missing cells as model@noise otherwise."""
    want = df.sparkSession.createDataFrame([(m, float(n)) for m in models for n in noises], "_m string, _n double")
    have = df.select(model_name(F.col(model)).alias("_m"), cell_key(F.col(noise)).alias("_n")).distinct()
    missing = want.join(have, ["_m", "_n"], "left_anti").orderBy("_m", "_n").collect()  # cells of a requested grid
    if missing:
        raise ValueError("missing: " + ", ".join(f"{r['_m']}@{r['_n']:g}" for r in missing))
    return df


def curve(df: DataFrame, models: list[str], noises: list[float], metric: str, order: str, strict: bool = True) -> DataFrame:
    """model, noise, value: one row for each cell in the requested order; of several the last by `order`."""
    named = df.withColumn("model", model_name(F.col("model"))).withColumn("noise", cell_key(F.col("noise")))
    if strict:
        complete(named, models, noises)
    last = named.withColumn("_r", F.row_number().over(Window.partitionBy("model", "noise").orderBy(F.desc(order)))).where("_r = 1")
    place = F.array_position(F.array(*map(F.lit, models)), F.col("model"))
    kept = last.where(F.col("model").isin(models) & F.col("noise").isin([float(n) for n in noises]))
    return kept.orderBy(place, "noise").select("model", "noise", F.col(metric).cast("double").alias("value"))


def metric_pivot(df: DataFrame, fraction: float, models: list[str], metrics: list[str], order: str, strict: bool = False) -> DataFrame:
    """A row for each noise of one fraction: models_present and {model}_{metric}; of several rows the last; missing is null, or raises if strict."""
    one = df.where(near(F.col("fraction").cast("double"), fraction)).withColumn("model", model_name(F.col("model"))).withColumn("noise", cell_key(F.col("noise")))
    if strict:
        complete(one, models, [r["noise"] for r in one.select("noise").distinct().collect()])
    last = lambda m, x: F.max_by(F.when(F.col("model") == m, F.col(x).try_cast("double")), F.when(F.col("model") == m, F.col(order))).alias(f"{m}_{x}")
    present = F.array_join(F.array_sort(F.collect_set(F.when(F.col("model").isin(models), F.col("model")))), ";").alias("models_present")
    return one.groupBy("noise").agg(present, *(last(m, x) for m in models for x in metrics))


def significance(delta: Column, p_value: Column, identical: Column) -> Column:
    """significant and note: a difference that is none is never significant, whatever the test says."""
    none = F.abs(delta) < NEGLIGIBLE
    note = F.when(identical, "identical output to the baseline").when(none, "no measurable difference; p-value not meaningful").otherwise("")
    return F.struct((~none & F.coalesce(p_value < LEVEL, F.lit(False))).alias("significant"), note.alias("note"))


def best_row(df: DataFrame, metric: str) -> DataFrame:
    """The row with the highest metric; NaN and null come last."""
    x = F.coalesce(F.when(~F.isnan(metric), F.col(metric)), F.lit(-1e9))
    return df.orderBy(x.desc(), *(F.col(c) for c in df.columns if c != metric)).limit(1)


def zipped(left: DataFrame, right: DataFrame, key: str, truncate: bool = False) -> DataFrame:
    """Two sides joined by position; sides of different length raise, or lose their tails if asked to."""
    if not truncate:
        n, m = left.count(), right.count()
        if n != m:
            raise ValueError(f"the sides have {n} and {m} rows")
    return left.join(right, key)


def subset(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows with the wanted ids; raises if one of those isn't there."""
    lost = ids.join(df.select(key), key, "left_anti").limit(5).collect()
    if lost:
        raise ValueError("out of range: " + ", ".join(str(r[key]) for r in lost))
    return df.join(ids.select(key).distinct(), key, "left_semi")


def history_rollup(df: DataFrame, losses: str) -> DataFrame:
    """final, best and number of the losses of an array; null without any."""
    return df.withColumn("final_loss", F.element_at(F.when(F.size(losses) > 0, F.col(losses)), -1)).withColumn("best_loss", F.array_min(losses)).withColumn("epochs", F.size(losses))
