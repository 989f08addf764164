"""Queries over files: tables of the test data written in every form in use, read back by its reader, and checked against the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import align as A
from ..operators import compare as C
from ..operators import entropy as E
from ..operators import metrics as M
from ..operators import noise as N
from ..sources import shared as H
from ..sources import tables as T
from ..streaming import logs as L
from . import quality as Q
from .entropy import _H
from .quality import SUITE, suite
from .texts import SQL as TEXT_SQL
from .texts import _strip_sql, class_fertility



def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "parallel_examples").select("pair_id", "source", "target")


def json_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON array of the English test texts, read by position."""
    items = T.table(spark, sf_dir, "eval_nway").select(F.struct("item_id", "eng_latn").alias("x"))
    one = items.agg(F.array_sort(F.collect_list("x")).alias("x")).select(F.to_json(F.transform("x", lambda x: x["eng_latn"])).alias("value"))  # a fixed table of 300 rows
    path = H.fresh(spark, "corpus-json")
    one.coalesce(1).write.text(path)
    return T.json_array(spark, path)


def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with a blank line after every one."""
    path = H.fresh(spark, "pairs-jsonl")
    _pairs(spark, sf_dir).select(F.explode(F.array(F.to_json(F.struct("pair_id", "source", "target")), F.lit(""))).alias("value")).write.text(path)
    return T.jsonl(spark, path, "pair_id bigint, source string, target string")


def jsonl_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of which every tenth is torn in the middle."""
    path = H.fresh(spark, "documents-jsonl")
    line = F.to_json(F.struct("doc_id", "text"))
    d = T.table(spark, sf_dir, "documents")
    d.select(F.when(F.col("doc_id") % 10 == 0, line.substr(F.lit(1), F.floor(F.length(line) / 2).cast("int"))).otherwise(line).alias("value")).write.text(path)
    return T.tolerant_jsonl(spark, path, "doc_id bigint, text string").select("doc_id", F.md5("text").alias("digest"))


def _parallel(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    a, b = H.fresh(spark, "sources"), H.fresh(spark, "targets")
    T.write_parallel(_pairs(spark, sf_dir), "pair_id", "source", "target", a, b)
    return a, b


def line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two aligned texts written side by side: the lines of the sources, as many as there are pairs."""
    return T.lines(spark, _parallel(spark, sf_dir)[0], expected=_pairs(spark, sf_dir).count())


def zipped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of two aligned texts joined by position."""
    a, b = _parallel(spark, sf_dir)
    left, right = T.lines(spark, a).withColumnRenamed("text", "source"), T.lines(spark, b).withColumnRenamed("text", "target")
    return C.zipped(left, right, "segment_id").select("segment_id", F.md5("source").alias("source"), F.md5("target").alias("target"))


def truncated_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of two sides of which one is shorter: its tail is lost, on purpose. How many are left, and the last."""
    a, b = _parallel(spark, sf_dir)
    left, right = T.lines(spark, a).withColumnRenamed("text", "source"), T.lines(spark, b).where("segment_id < 1000").withColumnRenamed("text", "target")
    return C.zipped(left, right, "segment_id", truncate=True).agg(F.count(F.lit(1)).alias("n"), F.max("segment_id").alias("last"))


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written with a fixed header and read as strings, with the file they are from."""
    path = H.fresh(spark, "reports-csv")
    T.write_csv(T.table(spark, sf_dir, "failure_sentences_100"), ["failure_id", "preview_lang", "n_words", "categories"], path)
    df = T.csv_with_origin(spark, path)
    return df.select(*(c for c in df.columns if c != "source_csv"), F.col("source_csv").rlike(r"^part-.*\.csv$").alias("has_origin"))


_METRIC_NAMES = {"model": ["model", "system"], "noise": ["noise", "noise_level"], "score": ["chrF++", "chrf"]}


def metric_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows under other headers; rows without a score are left out."""
    path = H.fresh(spark, "metrics-csv")
    f = T.table(spark, sf_dir, "failure_sentences_100")
    f.select(F.concat(F.lit("model "), F.col("report_id").cast("string")).alias("System"), (F.col("n_words") / 10).alias("NOISE"), F.col("blt_fertility").alias("CHRF")).write.option("header", True).csv(path)
    m = T.metric_csv(spark, path, _METRIC_NAMES)
    return m.groupBy("model").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("noise"), 6).alias("noise"), F.round(F.sum("score"), 6).alias("score"))


def fallback_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test items by split, from the first of two sources that is there."""
    names = ["no_such_table", "eval_nway"]
    items = T.first_that_loads([lambda n=n: T.table(spark, sf_dir, n) for n in names])
    return items.groupBy("eval_split").agg(F.count(F.lit(1)).alias("items"))


def column_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in T.available(T.table(spark, sf_dir, "parallel_examples"))], "name string")


def _checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.table(spark, sf_dir, "nation")
    name = F.when(F.col("n_nationkey") % 7 == 3, F.concat(F.lit("best_"), F.lower("n_name"))).otherwise(F.concat(F.lit("epoch"), F.col("n_nationkey").cast("string")))
    return n.select(F.concat(F.lit("run/"), name, F.lit(".pth")).alias("path"))


def checkpoint_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints (named after the 25 nations) in natural order, with the file of their hypotheses."""
    c = T.checkpoints(_checkpoints(spark, sf_dir))
    w = Window.orderBy(F.col("epoch").asc_nulls_last(), F.when(F.contains(F.lower("path"), F.lit("best")), 0).otherwise(1), "path")
    return c.select(F.row_number().over(w).alias("place"), "path", "epoch", T.hypothesis_path(F.col("path")).alias("hypotheses"))


def fertility_summary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fertility by class through a summary file."""
    c = class_fertility(spark, sf_dir)
    entries = F.collect_list(F.struct("class", F.struct(F.col("mean").alias("fertility_lambda"), F.col("words").alias("num_words"))))  # five classes
    path = H.fresh(spark, "fertility-json")
    c.agg(F.to_json(F.struct(F.map_from_entries(entries).alias("classes"))).alias("value")).coalesce(1).write.text(path)
    return T.fertility_summary(spark, path)


def summary_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested report of how many items each split has, read back."""
    items = T.table(spark, sf_dir, "eval_nway")
    path = H.fresh(spark, "report-json")
    T.write_report(spark, {"name": "items", "total": items.count(), "splits": items.groupBy("eval_split").agg(F.count(F.lit(1)).alias("items"))}, path)
    r = spark.read.schema("name string, total bigint, splits array<struct<eval_split:string,items:bigint>>").json(path)
    return r.select("name", "total", F.explode("splits").alias("s")).select("name", "total", "s.eval_split", "s.items")


def log_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of events that is appended to three times, with overlaps, after a failed write left a file behind; another configuration
    starts anew. Rows by day and by configuration."""
    e = T.table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    folder = H.fresh(spark, "log")
    log = L.Log(spark, folder, "event_id", {"threshold": 1.3, "workers": 4}, ignore=("workers",))
    log.append(e.where("event_id % 3 = 0"))
    torn = spark._jvm.org.apache.hadoop.fs.Path(f"{log.path}/_temporary-0/part-00000.parquet")
    torn.getFileSystem(spark._jsc.hadoopConfiguration()).create(torn).close()  # what a writer that died leaves
    again = L.Log(spark, folder, "event_id", {"workers": 8, "threshold": 1.3}, ignore=("workers",))
    again.append(e.where("event_id % 3 < 2"))
    again.append(e)
    other = L.Log(spark, folder, "event_id", {"threshold": 2.0})
    other.append(e.where("event_type = 'purchase'"))
    by_day = lambda rows, name: rows.groupBy(F.to_date("ts").alias("day")).agg(F.lit(name).alias("log"), F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("keys"))
    return by_day(log.rows(), "first").unionByName(by_day(other.rows(), "other"))


def stage_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage asked for four times: built, read, built for another configuration, and built again as it isn't valid. The tables' rows by
    request, and how often the stage was built by then."""
    folder, built, parts = H.fresh(spark, "memo"), [], []
    d = T.table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))

    def build() -> DataFrame:
        built.append(1)
        return d

    for k, (config, valid) in enumerate([({"a": 1}, None), ({"a": 1}, lambda t: t.count() > 0), ({"a": 2}, None), ({"a": 1}, lambda t: t.count() < 0)]):
        t = L.memo(spark, folder, "by-source", config, build, valid)
        parts.append((k, t.count(), t.agg(F.sum("n")).first()[0], len(built)))
    return spark.createDataFrame(parts, "request int, rows bigint, documents bigint, built int")


def nested_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs from rows of three shapes: a nested translation, flat columns, and a nested target beside a flat source."""
    p = _pairs(spark, sf_dir)
    kind = F.col("pair_id") % 3
    only = lambda k, c: F.when(kind == k, F.col(c))
    shaped = p.select(
        F.struct(only(0, "source").alias("en"), only(0, "target").alias("mr")).alias("translation"), F.when(kind > 0, F.col("source")).alias("english"),
        F.struct(F.lit(None).cast("string").alias("mr"), only(2, "target").alias("tgt"), only(2, "source").alias("en")).alias("target"), only(1, "target").alias("marathi"),
    )
    out = T.pairs(shaped)
    return out.groupBy(F.md5("source").alias("source"), F.md5("target").alias("target")).agg(F.count(F.lit(1)).alias("n"))


def side_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which columns the sides of pairs are in: named ones that are blank throughout don't count."""
    p = _pairs(spark, sf_dir).select(F.lit(" ").alias("source"), F.col("source").alias("english"), F.col("target").alias("mr"), "pair_id")
    s = T.side(p, None, T.SOURCE_NAMES)
    return spark.createDataFrame([("source", s), ("target", T.side(p, None, T.TARGET_NAMES, s)), ("explicit", T.side(p, "pair_id", T.SOURCE_NAMES))], "side string, name string")


def class_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports of the sentences of one category: ids that aren't there would raise."""
    f = T.table(spark, sf_dir, "failure_sentences_100")
    ids = f.where(F.array_contains(F.split("categories", "; "), X.LABELS["compound"])).select("failure_id")
    return C.subset(f, ids, "failure_id").select("failure_id", "report_id", "rank_pos")


def float_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas as keys of six decimals, and those that equal what is found by subtraction up to 1e-9."""
    f = T.table(spark, sf_dir, "failure_sentences_100").where("delta is not null")
    best = F.least("fert_augmented", "fert_retrained")
    same = F.coalesce(C.near(F.col("delta"), F.col("blt_fertility") - best), F.lit(False))
    return f.groupBy(C.cell_key(F.col("delta")).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("same"))


def names_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of nations as model names, and metric labels in one spelling."""
    n = T.table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit(" "), F.initcap("n_name"), F.lit("-LCM v1")).alias("name"))
    label = F.element_at(F.array(*map(F.lit, ("chrF2++", "chrF++", "BLEU", "TER", "CHRF2++"))), F.pmod("n_nationkey", F.lit(5)).cast("int") + 1)
    return n.select("n_nationkey", X.model_name(F.col("name")).alias("model"), X.metric_name(label).alias("metric"))


def config_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of each mix's configuration, which its target share doesn't affect."""
    m = T.table(spark, sf_dir, "mix_targets")
    return m.select("mix_name", "source", T.fingerprint_of(mix=F.col("mix_name"), source=F.col("source"), most=F.col("max_repeats")).alias("fingerprint"))


def text_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files of a folder are text: by their suffix, else by what they hold."""
    folder = H.fresh(spark, "files")
    texts = T.table(spark, sf_dir, "eval_nway").orderBy("item_id").select(F.col("mar_deva").alias("value"))
    zeros = spark.range(1).select(F.concat(F.lit("a"), F.decode(F.unhex(F.lit("00")), "UTF-8"), F.lit("b")).alias("value"))
    for name, df in (("notes", texts), ("report.MD", texts), ("weights.pth", texts), ("raw", zeros), ("log.txt", zeros)):
        df.coalesce(1).write.text(f"{folder}/_{name}")
        H.renamed(spark, f"{folder}/_{name}", name)
    return T.sniffed(spark, folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "is_text")


def strict_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment where two empty sides score 0: fixed chunks of 512 bytes against nothing but the start of a text, without tolerance."""
    docs = T.table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", "text")
    a = A.aligned(docs, "doc_id", "text", E.entropy_table(docs, "text"), [], [512], [0])
    inner = a.withColumn("n_gold", F.lit(0)).withColumn("hit_pred", F.lit(0)).withColumn("hit_gold", F.lit(0))
    return A.with_prf(inner, both_empty=0.0).groupBy("n_pred").agg(F.count(F.lit(1)).alias("documents"), F.sum("f1").alias("f1"))


def newline_reset_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropies with the context reset at each newline: how many bytes, their sum, and by how much it differs without the reset."""
    docs = T.spread(T.table(spark, sf_dir, "documents")).where("text <> ''").select("doc_id", "text")
    table = E.entropy_table(docs, "text")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    reset = E.reset_entropies(docs, "doc_id", "text", table).select("doc_id", F.size("entropies").alias("n_bytes"), total("entropies").alias("total"))
    plain = E.entropies(docs, "doc_id", "text", table).select("doc_id", total("entropies").alias("plain"))
    return reset.join(plain, "doc_id").select("doc_id", "n_bytes", F.round("total", 2).alias("total"), F.round(F.col("total") - F.col("plain"), 2).alias("added"))


def _suite(spark: SparkSession, checkpoints: DataFrame, refs: DataFrame, folder: str, strict: bool) -> DataFrame:
    """checkpoint, hyp_file and the scores of every checkpoint whose hypotheses are in the folder, a line for each reference (segment_id, text).
    One without is skipped, or raises if strict; one of another length raises; none at all raises."""
    parts = []
    for r in T.checkpoints(checkpoints).collect():  # a run's checkpoints
        name = r["path"].rsplit("/", 1)[-1]
        hyp = f"{folder}/{name.rsplit('.', 1)[0]}.hyp.txt"
        if not H.exists(spark, hyp):
            if strict:
                raise FileNotFoundError(f"no hypotheses for checkpoint {name}: {hyp}")
            continue
        both = C.zipped(T.lines(spark, hyp).withColumnRenamed("text", "hyp"), refs, "segment_id")
        counts = M.counted(both, ["segment_id"], "hyp", "text", SUITE)
        parts.append(suite(counts.withColumn("checkpoint", F.lit(name)).withColumn("hyp_file", F.lit(hyp.rsplit("/", 1)[-1])), ["checkpoint", "hyp_file"]))
    if not parts:
        raise ValueError("no checkpoints evaluated")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def checkpoint_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU and chrF++ of three checkpoints' hypotheses (targets with ever less noise); a fourth has none and is skipped."""
    t = _pairs(spark, sf_dir).where("target is not null").select("pair_id", F.translate("target", "\n", " ").alias("target"))
    folder = H.fresh(spark, "hypotheses")
    for epoch, noise in ((1, 0.2), (2, 0.1), (10, 0.0)):
        g = N.grid(T.spread(t), "pair_id", "target", [(epoch, noise)])
        g.orderBy("pair_id").select(F.col("hyp").alias("value")).write.text(f"{folder}/epoch{epoch}.hyp.txt")
    g = t.orderBy("pair_id").select(F.col("target").alias("value"))
    g.write.text(f"{folder}/refs")
    paths = spark.createDataFrame([(f"run/epoch{e}.pth",) for e in (10, 2, 1, 11)], "path string")
    out = _suite(spark, paths, T.lines(spark, f"{folder}/refs", expected=t.count()), folder, strict=False)
    return out.select("checkpoint", "hyp_file", "num_sentences", "bleu", "chrfpp")


def checkpoint_suite_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with TER and METEOR, for the least noise but none."""
    t = _pairs(spark, sf_dir).where("target is not null").select("pair_id", F.translate("target", "\n", " ").alias("target"))
    folder = H.fresh(spark, "hypotheses")
    N.grid(T.spread(t), "pair_id", "target", [(2, 0.1)]).orderBy("pair_id").select(F.col("hyp").alias("value")).write.text(f"{folder}/epoch2.hyp.txt")
    t.orderBy("pair_id").select(F.col("target").alias("value")).write.text(f"{folder}/refs")
    return _suite(spark, spark.createDataFrame([("epoch2.pth",)], "path string"), T.lines(spark, f"{folder}/refs"), folder, strict=True)


_FLAT = "translate(coalesce({c}, ''), chr(10), ' ')"
_SPLITS = "SELECT eval_split, count(*) AS items FROM eval_nway GROUP BY 1"
_NAMED = "CASE WHEN n_nationkey % 7 = 3 THEN 'best_' || lower(n_name) ELSE 'epoch' || n_nationkey END"
_CELLS = [(1, 0.2), (2, 0.1), (10, 0.0)]
_ONE_LINE = "(SELECT pair_id, translate(target, chr(10), ' ') AS target FROM parallel_examples WHERE target IS NOT NULL)"
_SUITE = f"WITH {Q._grams_sql(_CELLS)}, {Q._chrf_sql('k', 'seed, noise', 'cs')}, {Q._bleu_grams_sql(_CELLS)}{Q._BLEU.split('br.pair_id = bh.pair_id)', 1)[1]}".replace("FROM parallel_examples WHERE", f"FROM {_ONE_LINE} WHERE")

SQL = {
    "json_corpus": "SELECT row_number() OVER (ORDER BY item_id) - 1 AS sentence_id, eng_latn AS text FROM eval_nway",
    "jsonl_scan": "SELECT pair_id, source, target FROM parallel_examples",
    "jsonl_tolerant": "SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id % 10 <> 0",
    "line_scan": f"SELECT row_number() OVER (ORDER BY pair_id) - 1 AS segment_id, {_FLAT.format(c='source')} AS text FROM parallel_examples",
    "zipped_lines": f"SELECT row_number() OVER (ORDER BY pair_id) - 1 AS segment_id, md5({_FLAT.format(c='source')}) AS source, md5({_FLAT.format(c='target')}) AS target FROM parallel_examples",
    "truncated_zip": "SELECT least(1000, count(*)) AS n, least(1000, count(*)) - 1 AS last FROM parallel_examples",
    "csv_scan": "SELECT failure_id::VARCHAR AS failure_id, nullif(preview_lang, '') AS preview_lang, n_words::VARCHAR AS n_words, nullif(categories, '') AS categories, true AS has_origin FROM failure_sentences_100",
    "metric_scan": "SELECT 'model ' || report_id AS model, count(*) AS rows, round(sum(n_words / 10), 6) AS noise, round(sum(blt_fertility), 6) AS score FROM failure_sentences_100 WHERE n_words IS NOT NULL AND blt_fertility IS NOT NULL GROUP BY 1",
    "fallback_scan": _SPLITS,
    "column_listing": "SELECT column_name AS name FROM (DESCRIBE parallel_examples)",
    "checkpoint_listing": f"WITH c AS (SELECT {_NAMED} AS stem, CASE WHEN n_nationkey % 7 = 3 THEN NULL ELSE n_nationkey END::BIGINT AS epoch FROM nation) SELECT row_number() OVER (ORDER BY epoch NULLS LAST, stem)::INT AS place, 'run/' || stem || '.pth' AS path, epoch, 'run/' || stem || '.hyp.txt' AS hypotheses FROM c",
    "fertility_summary_scan": f"SELECT class, mean AS fertility_lambda, words AS num_words FROM ({TEXT_SQL['class_fertility']})",
    "summary_sink": f"SELECT 'items' AS name, sum(items) OVER ()::BIGINT AS total, eval_split, items FROM ({_SPLITS})",
    "log_resume": "SELECT ts::DATE AS day, 'first' AS log, count(*) AS n, count(DISTINCT event_id) AS keys FROM events GROUP BY 1 UNION ALL SELECT ts::DATE, 'other', count(*), count(DISTINCT event_id) FROM events WHERE event_type = 'purchase' GROUP BY 1",
    "stage_memo": "WITH d AS (SELECT count(*) AS rows, sum(n)::BIGINT AS documents FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)), r AS (SELECT unnest([0, 1, 2, 3]) AS request, unnest([1, 1, 2, 3]) AS built) SELECT request::INT AS request, rows, documents, built::INT AS built FROM r CROSS JOIN d",
    "nested_pairs": f"WITH p AS (SELECT {_strip_sql('source')} AS s, {_strip_sql('target')} AS t FROM parallel_examples) SELECT md5(s) AS source, md5(t) AS target, count(*) AS n FROM p WHERE s <> '' AND t <> '' AND s <> t GROUP BY 1, 2",
    "side_columns": "SELECT unnest(['source', 'target', 'explicit']) AS side, unnest(['english', 'mr', 'pair_id']) AS name",
    "class_subset": "SELECT failure_id, report_id, rank_pos FROM failure_sentences_100 WHERE list_contains(string_split(categories, '; '), 'Long compound words')",
    "float_keys": "SELECT round(delta, 6) AS cell, count(*) AS n, count(*) FILTER (WHERE abs(delta - (blt_fertility - least(fert_augmented, fert_retrained))) < 1e-9) AS same FROM failure_sentences_100 WHERE delta IS NOT NULL GROUP BY 1",
    "names_normalised": "SELECT n_nationkey, translate(lower(trim(n_name)), ' -', '__') || '_lcm_v1' AS model, CASE n_nationkey % 5 WHEN 2 THEN 'BLEU' WHEN 3 THEN 'TER' ELSE 'chrF++' END AS metric FROM nation",
    "config_fingerprints": "SELECT mix_name, source, sha1('{\"mix\": \"' || mix_name || '\", \"most\": ' || coalesce(max_repeats::VARCHAR, 'null') || ', \"source\": \"' || source || '\"}')[1:16] AS fingerprint FROM mix_targets",
    "text_sniff": "SELECT unnest(['notes', 'report.MD', 'weights.pth', 'raw', 'log.txt']) AS name, unnest([true, true, false, false, true]) AS is_text",
    "strict_alignment": "SELECT (strlen(text) - 1) // 512 AS n_pred, count(*) AS documents, 0.0::DOUBLE AS f1 FROM documents WHERE text <> '' GROUP BY 1",
    "newline_reset_entropy": f"WITH {_H}, y AS (SELECT doc_id, unnest(b) AS byte, unnest(range(len(b))) AS i, len(b) AS n FROM d), e AS (SELECT doc_id, CASE WHEN y.byte = '0A' OR i = y.n - 1 THEN 8.0 ELSE h.h END AS r, CASE WHEN i = y.n - 1 THEN 8.0 ELSE h.h END AS p FROM y LEFT JOIN h ON h.prev = y.byte) SELECT doc_id, count(*)::INT AS n_bytes, round(sum(r), 2) AS total, round(sum(r) - sum(p), 2) AS added FROM e GROUP BY 1",
    "checkpoint_suite": f"{_SUITE} SELECT 'epoch' || seed || '.pth' AS checkpoint, 'epoch' || seed || '.hyp.txt' AS hyp_file, (SELECT count(*) FROM parallel_examples WHERE target IS NOT NULL) AS num_sentences, round(bl.s, 6) AS bleu, round(cs.s, 6) AS chrfpp FROM cs JOIN bl USING (seed, noise)",
}

QUERIES = {
    f.__name__: f
    for f in (
        json_corpus, jsonl_scan, jsonl_tolerant, line_scan, zipped_lines, truncated_zip, csv_scan, metric_scan, fallback_scan, column_listing, checkpoint_listing, fertility_summary_scan, summary_sink,
        log_resume, stage_memo, nested_pairs, side_columns, class_subset, float_keys, names_normalised, config_fingerprints, text_sniff, strict_alignment, newline_reset_entropy, checkpoint_suite,
        checkpoint_suite_full,
    )
}
