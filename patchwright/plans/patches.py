"""Patch records: boundary rules over stored entropies, and what the records add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import segment as S
from ..functions import text as X
from ..sources.tables import table

_KEY = ["run_name", "sentence_index", "written_at"]


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "blt_marathi_patched")


def _starts() -> Column:
    return F.when(F.col("patching_mode") == "global", S.boundaries_global(F.col("entropy_per_byte"), F.col("threshold_used"))).otherwise(
        S.boundaries_monotonic(F.col("entropy_per_byte"), F.col("threshold_add"))
    )


def patch_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries and lengths by the row's own mode and threshold, and whether the stored ones are the same."""
    out = _runs(spark, sf_dir).withColumn("starts", _starts())
    return out.select(
        *_KEY, "starts", S.lengths(F.col("starts"), F.size("entropy_per_byte")).alias("lengths"), F.coalesce(F.col("starts") == F.col("patch_boundaries"), F.lit(False)).alias("as_stored")
    )


def patch_records_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(_runs(spark, sf_dir).withColumn("starts", S.boundaries_global(F.col("entropy_per_byte"), F.lit(1.335))))


def patch_records_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(_runs(spark, sf_dir).withColumn("starts", S.boundaries_monotonic(F.col("entropy_per_byte"), F.lit(0.6))))


def _records(df: DataFrame) -> DataFrame:
    p = df.select(*_KEY, F.explode(S.patch_records(F.col("starts"), F.col("entropy_per_byte"))).alias("p"))
    return p.select(*_KEY, "p.patch_index", "p.byte_start", "p.byte_end", "p.length_bytes", "p.entropy_at_boundary", F.round("p.mean_entropy", 8).alias("mean_entropy"))


def patch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run: sentences, bytes, patches, micro- and macro-averaged ratio, compression."""
    ratio = F.coalesce(F.try_divide("num_bytes", "num_patches"), F.lit(0.0))
    return _runs(spark, sf_dir).groupBy("run_name").agg(
        F.count(F.lit(1)).alias("sentences"),
        F.sum("num_bytes").alias("bytes"),
        F.sum("num_patches").alias("patches"),
        F.round(F.try_divide(F.sum("num_bytes"), F.sum("num_patches")), 8).alias("micro"),
        F.round(F.avg(ratio), 8).alias("macro"),
        F.round(1 - F.try_divide(F.sum("num_patches"), F.sum("num_bytes")), 8).alias("reduction"),
    )


def patch_number_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, exact median, population deviation, least and most, by run."""
    x = F.col("num_patches").cast("double")
    return (
        _runs(spark, sf_dir)
        .groupBy("run_name")
        .agg(F.round(F.avg(x), 8).alias("mean"), F.median(x).alias("median"), F.round(F.stddev_pop(x), 8).alias("std"), F.min("num_patches").alias("least"), F.max("num_patches").alias("most"))
    )


def patch_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median, deviation and extremes of bytes, patches, patch lengths and entropies by mode."""
    r = _runs(spark, sf_dir)
    one = lambda name, col: r.select("patching_mode", F.lit(name).alias("measure"), F.col(col).cast("double").alias("x"))
    many = lambda name, col: r.select("patching_mode", F.lit(name).alias("measure"), F.explode(F.col(col).cast("array<double>")).alias("x"))
    every = one("bytes", "num_bytes").unionByName(one("patches", "num_patches")).unionByName(many("lengths", "patch_lengths")).unionByName(many("entropies", "entropy_per_byte"))
    return every.where("x is not null and not isnan(x)").groupBy("patching_mode", "measure").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 7).alias("mean"), F.median("x").alias("median"), F.round(F.stddev_pop("x"), 7).alias("std"), F.min("x").alias("least"), F.max("x").alias("most")
    )


def position_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean entropy at each byte position over all records."""
    p = _runs(spark, sf_dir).select(F.posexplode("entropy_per_byte").alias("pos", "h"))
    return p.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("h"), 7).alias("mean"))


def patch_length_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select(F.explode("patch_lengths").alias("length")).groupBy("length").agg(F.count(F.lit(1)).alias("n"))


def patch_length_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tally scaled down to 1000 in all, at least one of each value."""
    t = patch_length_tally(spark, sf_dir)
    total = F.sum("n").over(Window.partitionBy())
    return t.select("length", F.greatest(F.lit(1), F.floor(F.col("n") * F.least(F.lit(1.0), 1000 / total) + 0.5)).cast("bigint").alias("kept"))


def upper_median_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value at index n // 2, not averaged; found on counts of distinct values, so no group is gathered."""
    counts = _runs(spark, sf_dir).where("num_patches is not null").groupBy("run_name", "num_patches").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("run_name")
    ranked = counts.withColumn("upto", F.sum("n").over(w.orderBy("num_patches"))).withColumn("total", F.sum("n").over(w))
    return ranked.groupBy("run_name").agg(F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("num_patches"))).alias("upper_median"))


def example_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patches of the first ten sentences in key order."""
    first = _runs(spark, sf_dir).orderBy(*_KEY).limit(10)
    return first.select("run_name", "sentence_index", F.explode("patches").alias("p")).select("run_name", "sentence_index", "p.patch_index", "p.byte_start", "p.length_bytes")


def latest_patch_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each key was written, and the last time."""
    return _runs(spark, sf_dir).groupBy("run_name", "sentence_index").agg(F.count(F.lit(1)).alias("writes"), F.max("written_at").alias("last_written"))


def run_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run is complete if all its keys have patches, none is missing a length, and it has ten sentences or more."""
    g = _runs(spark, sf_dir).groupBy("run_name").agg(
        F.count_distinct("sentence_index").alias("keys"), F.bool_and(F.col("num_patches").isNotNull()).alias("patched"), F.bool_and(F.col("patch_lengths").isNotNull()).alias("with_lengths")
    )
    return g.withColumn("complete", F.col("patched") & F.col("with_lengths") & (F.col("keys") >= 10))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", "text", F.octet_length("text").alias("n"))


def fixed_chunk_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda k: S.fixed_chunks(F.col("n"), k)
    return _docs(spark, sf_dir).select("doc_id", *(F.size(c(k)).alias(f"fixed_{k}") for k in (4, 8)), *(F.coalesce(F.element_at(F.when(F.size(c(k)) > 0, c(k)), -1), F.lit(-1)).alias(f"last_{k}") for k in (4, 8)))


def newline_reset_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(S.newline_segments(F.col("text"))).alias("segment", "x")).select("doc_id", "segment", F.octet_length("x").alias("n_bytes"))


def training_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.explode(S.training_chunks(F.col("n"), 512)).alias("c")).select("doc_id", "c.start", "c.size")


def teacher_forced_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input and target ids of every document, cut to 512; the sums stand for the arrays."""
    p = _docs(spark, sf_dir).select("doc_id", S.teacher_forced(X.byte_tokens(F.col("text"))).alias("p"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return p.select("doc_id", F.size("p.input").alias("n"), total(F.col("p.input")).alias("inputs"), total(F.col("p.target")).alias("targets"))


def window_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows of 256 bytes over each document."""
    return _docs(spark, sf_dir).select("doc_id", F.explode(S.windows(F.col("n"), 256)).alias("w")).select("doc_id", "w.src", "w.dst_start", "w.dst_end")


def patch_index_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner, slot, start and length of each stored patch, for gathering ragged batches."""
    runs = _runs(spark, sf_dir).where("patch_lengths is not null")
    return runs.select(*_KEY, F.posexplode(F.arrays_zip("patch_boundaries", "patch_lengths")).alias("slot", "p")).select(*_KEY, "slot", F.col("p.patch_boundaries").alias("start"), F.col("p.patch_lengths").alias("length"))


def utf8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text comes back from its byte ids, and their number."""
    t = _docs(spark, sf_dir).withColumn("ids", X.byte_tokens(F.col("text")))
    return t.select("doc_id", F.size("ids").alias("n"), (X.text_of_tokens(F.col("ids")) == F.col("text")).alias("same"))


_RUNS = "FROM blt_marathi_patched"
_N = "len(entropy_per_byte)"
_GLOBAL = "list_filter(range({n}), lambda k: k < 2 OR entropy_per_byte[k] > {t})".format(n=_N, t="{t}")
_MONO = "list_filter(range({n}), lambda k: k < 2 OR entropy_per_byte[k] - entropy_per_byte[k - 1] > {t})".format(n=_N, t="{t}")
_LENGTHS = "list_transform(starts, lambda s, i: coalesce(starts[i + 1], n) - s)"
_DOCS = "d AS (SELECT doc_id, text, strlen(text)::INT AS n FROM documents WHERE text <> '')"


def _records_sql(starts: str) -> str:
    return (
        f"WITH s AS (SELECT run_name, sentence_index, written_at, entropy_per_byte AS e, {_N} AS n, {starts} AS starts {_RUNS}),"
        " p AS (SELECT *, unnest(range(len(starts))) AS patch_index FROM s),"
        " q AS (SELECT *, starts[patch_index + 1] AS byte_start, coalesce(starts[patch_index + 2], n) AS byte_end FROM p)"
        " SELECT run_name, sentence_index, written_at, patch_index, byte_start, byte_end, byte_end - byte_start AS length_bytes, e[byte_start + 1] AS entropy_at_boundary,"
        " round(list_sum(e[byte_start + 1:byte_end]) / (byte_end - byte_start), 8) AS mean_entropy FROM q"
    )


SQL = {
    "patch_boundaries": f"WITH s AS (SELECT run_name, sentence_index, written_at, patch_boundaries, {_N} AS n, CASE WHEN patching_mode = 'global' THEN {_GLOBAL.format(t='threshold_used')} ELSE {_MONO.format(t='threshold_add')} END AS starts {_RUNS}) SELECT run_name, sentence_index, written_at, starts, {_LENGTHS} AS lengths, coalesce(starts = patch_boundaries, false) AS as_stored FROM s",
    "patch_records_global": _records_sql(_GLOBAL.format(t="1.335")),
    "patch_records_monotonic": _records_sql(_MONO.format(t="0.6")),
    "patch_stats": f"SELECT run_name, count(*) AS sentences, sum(num_bytes)::BIGINT AS bytes, sum(num_patches)::BIGINT AS patches, round(sum(num_bytes) / nullif(sum(num_patches), 0), 8) AS micro, round(avg(coalesce(num_bytes / nullif(num_patches, 0), 0.0)), 8) AS macro, round(1 - sum(num_patches) / nullif(sum(num_bytes), 0), 8) AS reduction {_RUNS} GROUP BY run_name",
    "patch_number_summary": f"SELECT run_name, round(avg(num_patches), 8) AS mean, median(num_patches::DOUBLE) AS median, round(stddev_pop(num_patches), 8) AS std, min(num_patches) AS least, max(num_patches) AS most {_RUNS} GROUP BY run_name",
    "patch_distributions": "WITH e AS (SELECT patching_mode, 'bytes' AS measure, num_bytes::DOUBLE AS x FROM blt_marathi_patched UNION ALL SELECT patching_mode, 'patches', num_patches FROM blt_marathi_patched UNION ALL SELECT patching_mode, 'lengths', unnest(patch_lengths) FROM blt_marathi_patched UNION ALL SELECT patching_mode, 'entropies', unnest(entropy_per_byte) FROM blt_marathi_patched) SELECT patching_mode, measure, count(*) AS n, round(avg(x), 7) AS mean, median(x) AS median, round(stddev_pop(x), 7) AS std, min(x) AS least, max(x) AS most FROM e WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY 1, 2",
    "position_entropy": "SELECT pos::INT AS pos, count(*) AS n, round(avg(h), 7) AS mean FROM (SELECT unnest(range(len(entropy_per_byte))) AS pos, unnest(entropy_per_byte) AS h FROM blt_marathi_patched) GROUP BY 1",
    "patch_length_tally": f"SELECT length, count(*) AS n FROM (SELECT unnest(patch_lengths) AS length {_RUNS}) GROUP BY 1",
    "patch_length_sample": f"WITH t AS (SELECT length, count(*) AS n FROM (SELECT unnest(patch_lengths) AS length {_RUNS}) GROUP BY 1) SELECT length, greatest(1, floor(n * least(1.0::DOUBLE, 1000 / sum(n) OVER ()) + 0.5))::BIGINT AS kept FROM t",
    "upper_median_patches": f"SELECT run_name, v[n // 2 + 1] AS upper_median FROM (SELECT run_name, list_sort(list(num_patches)) AS v, count(*) AS n {_RUNS} WHERE num_patches IS NOT NULL GROUP BY 1)",
    "example_patches": f"SELECT run_name, sentence_index, p.patch_index, p.byte_start, p.length_bytes FROM (SELECT run_name, sentence_index, unnest(patches) AS p FROM (SELECT * {_RUNS} ORDER BY run_name, sentence_index, written_at LIMIT 10))",
    "latest_patch_record": f"SELECT run_name, sentence_index, count(*) AS writes, max(written_at) AS last_written {_RUNS} GROUP BY 1, 2",
    "run_completeness": f"SELECT *, patched AND with_lengths AND keys >= 10 AS complete FROM (SELECT run_name, count(DISTINCT sentence_index) AS keys, bool_and(num_patches IS NOT NULL) AS patched, bool_and(patch_lengths IS NOT NULL) AS with_lengths {_RUNS} GROUP BY 1)",
    "fixed_chunk_boundaries": f"WITH {_DOCS} SELECT doc_id, (n - 1) // 4 AS fixed_4, (n - 1) // 8 AS fixed_8, CASE WHEN n > 4 THEN (n - 1) // 4 * 4 ELSE -1 END AS last_4, CASE WHEN n > 8 THEN (n - 1) // 8 * 8 ELSE -1 END AS last_8 FROM d",
    "newline_reset_segments": f"WITH {_DOCS}, s AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM d), t AS (SELECT doc_id, unnest(p) AS x, unnest(range(len(p))) AS segment, len(p) AS k FROM s) SELECT doc_id, segment::INT AS segment, (strlen(x) + CASE WHEN segment < k - 1 THEN 1 ELSE 0 END)::INT AS n_bytes FROM t WHERE segment < k - 1 OR x <> ''",
    "training_chunks": f"WITH {_DOCS}, s AS (SELECT doc_id, n, unnest(range(0, n, 512)) AS start FROM d) SELECT doc_id, start::INT AS start, least(513, n - start)::INT AS size FROM s WHERE least(513, n - start) >= 2",
    "teacher_forced_pairs": f"WITH {_DOCS}, b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::INT + 4) AS t FROM d), p AS (SELECT doc_id, list_concat([1], t)[:512] AS i, list_concat(t, [2])[:512] AS o FROM b) SELECT doc_id, len(i)::INT AS n, list_sum(i)::BIGINT AS inputs, list_sum(o)::BIGINT AS targets FROM p",
    "window_plan": f"WITH {_DOCS}, k AS (SELECT doc_id, n, unnest(range(0, 1 + CASE WHEN n > 256 THEN ceil((n - 256) / 128)::INT ELSE 0 END)) AS i FROM d) SELECT doc_id, CASE WHEN i = 0 THEN 0 ELSE i * 128 END::INT AS src, CASE WHEN i = 0 THEN 0 ELSE 256 + (i - 1) * 128 END::INT AS dst_start, least(256 + i * 128, n)::INT AS dst_end FROM k",
    "patch_index_plan": f"SELECT run_name, sentence_index, written_at, unnest(range(len(patch_lengths)))::INT AS slot, unnest(patch_boundaries) AS start, unnest(patch_lengths) AS length {_RUNS} WHERE patch_lengths IS NOT NULL",
    "utf8_roundtrip": f"WITH {_DOCS} SELECT doc_id, n, decode(encode(text)) = text AS same FROM d",
}

QUERIES = {
    f.__name__: f
    for f in (
        patch_boundaries, patch_records_global, patch_records_monotonic, patch_stats, patch_number_summary, patch_distributions, position_entropy, patch_length_tally, patch_length_sample, upper_median_patches, example_patches,
        latest_patch_record, run_completeness, fixed_chunk_boundaries, newline_reset_segments, training_chunks, teacher_forced_pairs, window_plan, patch_index_plan, utf8_roundtrip,
    )
}
