"""Log queries over events: latest rows, upserts, windows, series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import logs as L


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def latest_event_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.latest(_events(spark, sf_dir), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "ts", "event_type")


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by the type of their latest event."""
    return latest_event_per_user(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def upsert_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest rows of the first half of the month, updated by those of the second."""
    e = _events(spark, sf_dir).select("user_id", "event_id", "ts", "value")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    part = lambda rows: L.latest(rows, ["user_id"], [F.col("ts"), F.col("event_id")])
    return L.upserted(part(e.where(F.col("ts") < cut)), part(e.where(F.col("ts") >= cut)), "user_id").select("user_id", "event_id", F.round("value", 6).alias("value"))


def mirror_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of the first half of the month that are still there in the second."""
    e = _events(spark, sf_dir)
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    return L.pruned(e.where(F.col("ts") < cut).select("user_id").distinct(), e.where(F.col("ts") >= cut), "user_id")


def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events still to be done by type when those of the first half of the month are."""
    e = _events(spark, sf_dir)
    done = e.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).select("event_id")
    return e.join(done, "event_id", "left_anti").groupBy("event_type").agg(F.count(F.lit(1)).alias("pending"))


def adopted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's newest record of the wanted type, whatever came after it."""
    wanted = _events(spark, sf_dir).where("event_type = 'purchase' and value is not null")
    return L.latest(wanted, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", F.round("value", 6).alias("value"))


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest checkpoints of each user, named by the event's number."""
    c = _events(spark, sf_dir).select("user_id", F.concat(F.lit("epoch"), F.col("event_id").cast("string"), F.lit(".pth")).alias("name"))
    return L.kept_checkpoints(c, "user_id", "name", 3)


def epoch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of epoch 3 after 50 are skipped."""
    return L.epoch_order(_events(spark, sf_dir).select("event_id"), "event_id", 42, 3, 50)


def shuffled_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of a cap of 1000 events, in a shuffled order."""
    return L.shuffled_cap(_events(spark, sf_dir).select("event_id"), "event_id", 42, 1000, 0.25)


def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of a scan of patch records, by run."""
    s = L.finished_summary(L.scan_summary(table(spark, sf_dir, "blt_marathi_patched").where("num_bytes is not null and num_patches is not null"), "run_name"))
    return s.select("run_name", "sentences", "bytes", "patches", "least", "most", "empty", *(F.round(c, 6).alias(c) for c in ("mean_patches", "std_patches", "bytes_per_patch")))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, day, loss: the mean value of a user's day."""
    e = _events(spark, sf_dir).where("value is not null")
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("loss"))


def plateau_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.plateau(_daily(spark, sf_dir), "user_id", "day", "loss", 0.5, 4)


def ema_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moving average of each user's daily means, a month at most."""
    s = _daily(spark, sf_dir).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "loss"))), lambda x: x["loss"]).alias("s"))
    return s.select("user_id", F.size("s").alias("n"), F.round(L.ema(F.col("s")), 7).alias("ema"))


def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every day of a user the best so far and the days since it last got better."""
    w = Window.partitionBy("user_id").orderBy("day")
    d = _daily(spark, sf_dir).withColumn("best", F.min("loss").over(w)).withColumn("nth", F.row_number().over(w))
    improved = F.max(F.when(F.col("loss") == F.col("best"), F.col("nth"))).over(w)
    return d.select("user_id", "day", "best", (F.col("nth") - improved).alias("since"))


def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.tumbling(_events(spark, sf_dir), "ts", ["event_type"], "1 day")


def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.tumbling(_events(spark, sf_dir), "ts", [], "2 days", slide="1 day")


def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sessions(_events(spark, sf_dir), "ts", "user_id", "4 hours")


def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in the JSON field, summed by type."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"))


def finite_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of patch records are numbers, and their mean, by mode."""
    r = table(spark, sf_dir, "blt_marathi_patched")
    x = F.col("avg_patch_length")
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return r.groupBy("patching_mode").agg(F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("finite"), F.round(F.avg(F.when(ok, x)), 7).alias("mean"))


def summary_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables with different columns concatenated: ids and languages of pairs and previews, by origin."""
    a = table(spark, sf_dir, "parallel_examples").select(F.col("target_lang").alias("lang"), F.col("corpus_key").alias("key"), F.lit("pairs").alias("origin"))
    b = table(spark, sf_dir, "failure_sentences_100").select(F.col("preview_lang").alias("lang"), F.lit("previews").alias("origin"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("origin").agg(F.count(F.lit(1)).alias("rows"), F.count("lang").alias("with_lang"), F.count("key").alias("with_key"))


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of pairs that previews have too, and those they don't have."""
    a = table(spark, sf_dir, "parallel_examples").select(F.lower(F.trim("target_lang")).alias("lang")).where("lang is not null")
    b = table(spark, sf_dir, "failure_sentences_100").select(F.lower(F.trim("preview_lang")).alias("lang")).where("lang is not null")
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.exceptAll(b).distinct().join(b.distinct(), "lang", "left_anti").withColumn("side", F.lit("pairs")))


_LATEST = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1)"
_HALF = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts {op} TIMESTAMP '2024-01-16') WHERE r = 1)"
_DAILY = "d AS (SELECT user_id, ts::DATE AS day, round(avg(value), 6) AS loss FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"

SQL = {
    "latest_event_per_user": f"WITH {_LATEST} SELECT user_id, event_id, ts, event_type FROM l",
    "status_counts": f"WITH {_LATEST} SELECT event_type, count(*) AS n FROM l GROUP BY 1",
    "upsert_by_key": f"WITH a AS {_HALF.format(op='<')}, b AS {_HALF.format(op='>=')} SELECT user_id, event_id, round(value, 6) AS value FROM b UNION ALL SELECT user_id, event_id, round(value, 6) FROM a WHERE user_id NOT IN (SELECT user_id FROM b WHERE user_id IS NOT NULL)",
    "mirror_prune": "SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-16' INTERSECT SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-16'",
    "resume_anti_join": "SELECT event_type, count(*) AS pending FROM events e WHERE NOT EXISTS (SELECT 1 FROM events f WHERE f.event_id = e.event_id AND f.ts < TIMESTAMP '2024-01-16') GROUP BY 1",
    "adopted_records": "SELECT user_id, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'purchase' AND value IS NOT NULL) WHERE r = 1",
    "retention": "SELECT user_id, 'epoch' || event_id || '.pth' AS name FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 3",
    "epoch_order": "SELECT event_id, r AS position FROM (SELECT event_id, row_number() OVER (ORDER BY md5('42|3|' || event_id)[1:15], event_id) - 1 AS r FROM events) WHERE r >= 50",
    "shuffled_cap": "SELECT event_id FROM events ORDER BY md5('42|0|' || event_id)[1:15], event_id LIMIT 250",
    "scan_summary": "SELECT run_name, count(*) AS sentences, sum(num_bytes)::BIGINT AS bytes, sum(num_patches)::BIGINT AS patches, min(num_patches) AS least, max(num_patches) AS most, count(*) FILTER (WHERE num_patches = 0) AS empty, round(avg(num_patches), 6) AS mean_patches, round(stddev_pop(num_patches), 6) AS std_patches, round(sum(num_bytes) / nullif(sum(num_patches), 0), 6) AS bytes_per_patch FROM blt_marathi_patched WHERE num_bytes IS NOT NULL AND num_patches IS NOT NULL GROUP BY 1",
    "plateau_stop": f"WITH RECURSIVE {_DAILY}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM d), r AS (SELECT user_id, i, day, loss AS best, day AS best_at, 0 AS since, NULL::DATE AS stopped_at FROM n WHERE i = 1 UNION ALL"
    " SELECT n.user_id, n.i, n.day, CASE WHEN stopped_at IS NULL AND n.loss < best - 0.5 THEN n.loss ELSE best END, CASE WHEN stopped_at IS NULL AND n.loss < best - 0.5 THEN n.day ELSE best_at END, CASE WHEN n.loss < best - 0.5 THEN 0 ELSE since + 1 END,"
    " CASE WHEN stopped_at IS NOT NULL THEN stopped_at WHEN n.loss >= best - 0.5 AND since + 1 >= 4 THEN n.day END FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1)"
    " SELECT user_id, best, best_at, stopped_at FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1",
    "ema_series": f"WITH {_DAILY}, s AS (SELECT user_id, list(loss ORDER BY day) AS s FROM d GROUP BY 1) SELECT user_id, len(s)::INT AS n, round(list_reduce(s, lambda a, x: 0.1::DOUBLE * x + 0.9::DOUBLE * a), 7) AS ema FROM s",
    "running_best": f"WITH {_DAILY}, b AS (SELECT user_id, day, loss, min(loss) OVER w AS best, row_number() OVER w AS nth FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)) SELECT user_id, day, best, (nth - max(CASE WHEN loss = best THEN nth END) OVER (PARTITION BY user_id ORDER BY day))::INT AS since FROM b",
    "events_tumbling": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "events_sliding": "SELECT (date_trunc('day', ts) - to_days(k::INT))::TIMESTAMP AS start, count(*) AS n FROM events CROSS JOIN range(0, 2) r(k) GROUP BY 1",
    "events_session": "WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 4 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k",
    "props_json": "SELECT event_type, count(TRY_CAST(props->>'k' AS BIGINT)) AS n, sum(TRY_CAST(props->>'k' AS BIGINT))::BIGINT AS total FROM events GROUP BY 1",
    "finite_values": "SELECT patching_mode, count(*) AS rows, count(*) FILTER (WHERE isfinite(avg_patch_length)) AS finite, round(avg(avg_patch_length) FILTER (WHERE isfinite(avg_patch_length)), 7) AS mean FROM blt_marathi_patched GROUP BY 1",
    "summary_union": "SELECT 'pairs' AS origin, count(*) AS rows, count(target_lang) AS with_lang, count(corpus_key) AS with_key FROM parallel_examples UNION ALL SELECT 'previews', count(*), count(preview_lang), 0 FROM failure_sentences_100",
    "set_operations": "WITH a AS (SELECT DISTINCT lower(trim(target_lang)) AS lang FROM parallel_examples WHERE target_lang IS NOT NULL), b AS (SELECT DISTINCT lower(trim(preview_lang)) AS lang FROM failure_sentences_100 WHERE preview_lang IS NOT NULL) SELECT lang, 'both' AS side FROM a WHERE lang IN (SELECT lang FROM b) UNION ALL SELECT lang, 'pairs' FROM a WHERE lang NOT IN (SELECT lang FROM b)",
}

QUERIES = {
    f.__name__: f
    for f in (
        latest_event_per_user, status_counts, upsert_by_key, mirror_prune, resume_anti_join, adopted_records, retention, epoch_order, shuffled_cap, scan_summary, plateau_stop, ema_series, running_best, events_tumbling, events_sliding,
        events_session, props_json, finite_values, summary_union, set_operations,
    )
}
