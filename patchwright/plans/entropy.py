"""Byte statistics, the threshold sweep and its tables, over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import entropy as E
from ..sources.shared import written
from ..sources.tables import spread, table

TAUS = [0.5, 1.0, 1.5, 2.0, 2.5]
QUANTILES = {"p5": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).where("text <> ''").select("doc_id", "text", "lang", "source")


def _swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return E.sweep(docs, "doc_id", "text", E.entropy_table(docs, "text"), TAUS)


def byte_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.char_length("text").cast("bigint").alias("n_points"))


def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.byte_counts(_docs(spark, sf_dir), "text")


def byte_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = E.probabilities(E.bigrams(_docs(spark, sf_dir), "text"))
    return p.select("prev", "next", "n", F.round("p", 9).alias("p"))


def byte_bigram_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.conditional_entropy(E.bigrams(_docs(spark, sf_dir), "text")).select("prev", "n", F.round(F.abs("entropy"), 8).alias("entropy"))


def bigram_tau_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(_swept(spark, sf_dir))


def _totals(swept: DataFrame) -> DataFrame:
    return swept.groupBy("tau").agg(
        F.sum("num_patches").alias("patches"),
        F.sum("n_bytes").alias("bytes"),
        F.round(F.avg("num_patches"), 6).alias("mean_patches"),
        F.round(F.sum("n_bytes") / F.sum("num_patches"), 6).alias("bytes_per_patch"),
    )


def tau_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _swept(spark, sf_dir).withColumn("avg_patch_size", F.col("n_bytes") / F.col("num_patches"))


def tau_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("num_patches").cast("double")
    return _swept(spark, sf_dir).groupBy("tau").agg(
        F.round(F.avg(x), 6).alias("mean"), F.round(F.median(x), 6).alias("median"), F.round(F.stddev_pop(x), 6).alias("std"), F.min("num_patches").alias("least"), F.max("num_patches").alias("most")
    )


def tau_nearest_rank_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value at index int(n q), without interpolation; found on the counts of distinct values."""
    counts = _swept(spark, sf_dir).groupBy("tau", "num_patches").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("tau")
    ranked = counts.withColumn("upto", F.sum("n").over(w.orderBy("num_patches"))).withColumn("total", F.sum("n").over(w))
    pick = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("total") * F.lit(q)), F.col("num_patches")))
    return ranked.groupBy("tau").agg(*(pick(q).alias(name) for name, q in QUANTILES.items()))


def tau_marginal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each threshold to the next: differences of the mean and the total, and in per cent."""
    w = Window.orderBy("tau")  # one row for each threshold
    t = _totals(_swept(spark, sf_dir)).withColumn("before", F.lag("patches").over(w)).withColumn("mean_before", F.lag("mean_patches").over(w))
    return t.where("before is not null").select(
        "tau",
        F.round(F.col("mean_patches") - F.col("mean_before"), 6).alias("mean_delta"),
        (F.col("patches") - F.col("before")).alias("total_delta"),
        F.round(100 * (F.col("patches") - F.col("before")) / F.col("before"), 6).alias("percent"),
    )


def tau_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.first("patches").over(Window.orderBy("tau"))
    return _totals(_swept(spark, sf_dir)).select(
        "tau", "bytes_per_patch", F.round(1 - F.col("patches") / F.col("bytes"), 6).alias("reduction"), (first - F.col("patches")).alias("saved")
    )


def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entropy, n: bytes by their entropy; at most 257 rows, from one pass over the texts for the counts of pairs (65 536 rows at most)."""
    docs = _docs(spark, sf_dir)
    h = E.conditional_entropy(written(E.bigrams(docs, "text"), "bigrams")).select(F.round(F.abs("entropy"), 8).alias("entropy"), "n")
    last = docs.agg(F.count(F.lit(1)).alias("n")).select(F.lit(E.UNSEEN).alias("entropy"), "n")
    return h.unionByName(last).groupBy("entropy").agg(F.sum("n").alias("n"))


def entropy_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of bytes whose entropy is no more than each value that occurs."""
    w = Window.orderBy("entropy")
    return _histogram(spark, sf_dir).select("entropy", "n", F.round(F.sum("n").over(w) / F.sum("n").over(Window.partitionBy()), 9).alias("share"))


def share_above_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _histogram(spark, sf_dir)
    taus = F.explode(F.array(*map(F.lit, TAUS))).alias("tau")
    return h.select("entropy", "n", taus).groupBy("tau").agg(F.round(F.sum(F.when(F.col("entropy") > F.col("tau"), F.col("n")).otherwise(0)) / F.sum("n"), 9).alias("share"))


def language_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes a patch and bits a byte by language, and the ratio of the former to English. A byte's entropy is in bits already; the last byte
    of a text has none of its own and counts as unseen."""
    docs = _docs(spark, sf_dir).withColumn("lang", F.coalesce("lang", F.lit("unknown")))
    table_ = E.entropy_table(docs, "text")
    named = docs.select(F.struct("doc_id", "lang").alias("key"), "text")
    counts = E.sweep(named, "key", "text", table_, [1.5])
    by = counts.groupBy("key.lang").agg(F.count(F.lit(1)).alias("sentences"), F.sum("n_bytes").alias("bytes"), F.sum("num_patches").alias("patches"))
    bits = E.group_bits(docs, "lang", "text", table_)
    base = F.max(F.when(F.col("lang") == "eng_Latn", F.col("bytes") / F.col("patches"))).over(Window.partitionBy())  # a row for each language
    return by.join(bits, "lang").select("lang", "sentences", "bytes", "patches", F.round(F.col("bytes") / F.col("patches"), 6).alias("bytes_per_patch"), F.round(F.col("bits") / F.col("bytes"), 6).alias("bits_per_byte"), F.round(F.col("bytes") / F.col("patches") / base, 6).alias("ratio"))


# The SQL works on pairs of hexadecimal digits.
_D = "d AS (SELECT doc_id, coalesce(lang, 'unknown') AS lang, regexp_extract_all(hex(encode(text)), '..') AS b FROM documents WHERE text <> '')"
_C = _D + ", c AS (SELECT prev, nxt, count(*) AS n FROM (SELECT unnest(b[:-2]) AS prev, unnest(b[2:]) AS nxt FROM d WHERE len(b) > 1) GROUP BY 1, 2)"
_P = _C + ", p AS (SELECT prev, nxt, n, n / sum(n) OVER (PARTITION BY prev) AS p FROM c)"
_H = _P + ", h AS (SELECT prev, sum(n) AS n, abs(-sum(p * log2(p))) AS h FROM p GROUP BY prev)"
_TAUS = "taus AS (SELECT unnest([0.5, 1.0, 1.5, 2.0, 2.5])::DOUBLE AS tau)"
_S = _H + f", {_TAUS}, x AS (SELECT doc_id, unnest(b[:-2]) AS byte FROM d), k AS (SELECT doc_id, byte, count(*) AS n FROM x GROUP BY 1, 2)" + (
    ", a AS (SELECT doc_id, tau, sum(k.n) AS above FROM k JOIN h ON k.byte = h.prev JOIN taus ON h.h > tau GROUP BY 1, 2)"
    ", s AS (SELECT d.doc_id, d.lang, t.tau, len(b)::BIGINT AS n_bytes, (1 + coalesce(a.above, 0))::BIGINT AS num_patches FROM d CROSS JOIN taus t LEFT JOIN a ON a.doc_id = d.doc_id AND a.tau = t.tau)"
)
_T = _S + (
    ", t AS (SELECT tau, sum(num_patches)::BIGINT AS patches, sum(n_bytes)::BIGINT AS bytes, round(avg(num_patches), 6) AS mean_patches,"
    " round(sum(n_bytes) / sum(num_patches), 6) AS bytes_per_patch FROM s GROUP BY tau)"
)
_G = _H + (
    ", e AS (SELECT round(h.h, 8) AS entropy, n FROM h UNION ALL SELECT 8.0, count(*) FROM d),"
    " g AS (SELECT entropy, sum(n)::BIGINT AS n FROM e GROUP BY 1)"
)

SQL = {
    "byte_lengths": "SELECT doc_id, strlen(text)::BIGINT AS n_bytes, length(text)::BIGINT AS n_points FROM documents",
    "byte_histogram": f"WITH {_D} SELECT ('0x' || x)::INT AS byte, count(*) AS n FROM (SELECT unnest(b) AS x FROM d) GROUP BY 1",
    "byte_bigrams": f"WITH {_P} SELECT ('0x' || prev)::INT AS prev, ('0x' || nxt)::INT AS next, n, round(p, 9) AS p FROM p",
    "byte_bigram_entropy": f"WITH {_H} SELECT ('0x' || prev)::INT AS prev, n::BIGINT AS n, round(h, 8) AS entropy FROM h",
    "bigram_tau_sweep": f"WITH {_T} SELECT * FROM t",
    "tau_by_document": f"WITH {_S} SELECT doc_id, n_bytes, tau, num_patches, n_bytes / num_patches AS avg_patch_size FROM s",
    "tau_stats": f"WITH {_S} SELECT tau, round(avg(num_patches), 6) AS mean, round(median(num_patches::DOUBLE), 6) AS median, round(stddev_pop(num_patches), 6) AS std, min(num_patches) AS least, max(num_patches) AS most FROM s GROUP BY tau",
    "tau_nearest_rank_quantiles": f"WITH {_S}, r AS (SELECT tau, list_sort(list(num_patches)) AS v, count(*) AS n FROM s GROUP BY tau) SELECT tau, "
    + ", ".join(f"v[floor(n * {q})::INT + 1] AS {name}" for name, q in QUANTILES.items())
    + " FROM r",
    "tau_marginal": f"WITH {_T}, m AS (SELECT *, lag(patches) OVER (ORDER BY tau) AS before, lag(mean_patches) OVER (ORDER BY tau) AS mean_before FROM t) SELECT tau, round(mean_patches - mean_before, 6) AS mean_delta, patches - before AS total_delta, round(100 * (patches - before) / before, 6) AS percent FROM m WHERE before IS NOT NULL",
    "tau_compression": f"WITH {_T} SELECT tau, bytes_per_patch, round(1 - patches / bytes, 6) AS reduction, first_value(patches) OVER (ORDER BY tau) - patches AS saved FROM t",
    "entropy_cdf": f"WITH {_G} SELECT entropy, n, round(sum(n) OVER (ORDER BY entropy) / sum(n) OVER (), 9) AS share FROM g",
    "share_above_threshold": f"WITH {_G}, {_TAUS} SELECT tau, round(sum(CASE WHEN entropy > tau THEN n ELSE 0 END) / sum(n), 9) AS share FROM g CROSS JOIN taus GROUP BY tau",
    "language_transfer": f"WITH {_S}, l AS (SELECT lang, count(*) AS sentences, sum(n_bytes)::BIGINT AS bytes, sum(num_patches)::BIGINT AS patches FROM s WHERE tau = 1.5 GROUP BY lang), bi AS (SELECT lang, sum(h.h) AS b FROM (SELECT lang, unnest(b[:-2]) AS byte FROM d) JOIN h ON h.prev = byte GROUP BY lang), li AS (SELECT l.*, coalesce(bi.b, 0) + 8.0 * sentences AS bits FROM l LEFT JOIN bi USING (lang)) SELECT lang, sentences, bytes, patches, round(bytes / patches, 6) AS bytes_per_patch, round(bits / bytes, 6) AS bits_per_byte, round(bytes / patches / max(CASE WHEN lang = 'eng_Latn' THEN bytes / patches END) OVER (), 6) AS ratio FROM li",
}

QUERIES = {
    f.__name__: f
    for f in (
        byte_lengths, byte_histogram, byte_bigrams, byte_bigram_entropy, bigram_tau_sweep, tau_by_document, tau_stats, tau_nearest_rank_quantiles,
        tau_marginal, tau_compression, entropy_cdf, share_above_threshold, language_transfer,
    )
}
