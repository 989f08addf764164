"""Boundary alignment studies over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import align as A
from ..operators import entropy as E
from .entropy import _H, _TAUS, SQL as ENTROPY_SQL, TAUS, _docs, _swept, _totals

TOLERANCE, TOLERANCES, CHUNKS = 3, [0, 1, 2, 3], [4, 8]


def _aligned(spark: SparkSession, sf_dir: str, taus: list[float], chunks: list[int], tolerances: list[int]) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return A.with_prf(A.aligned(docs, "doc_id", "text", E.entropy_table(docs, "text"), taus, chunks, tolerances))


def proxy_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir, [0.5], [], [0]).select("doc_id", "n_bytes", "n_gold")


def alignment_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir, TAUS, [], [TOLERANCE]).select("doc_id", "method", "n_pred", "n_gold", "hit_pred", "hit_gold", "precision", "recall", "f1")


def _macro(df: DataFrame) -> DataFrame:
    """Means over documents of values rounded to four places, as the reports have them."""
    mean = lambda c: F.round(F.avg(A.four_places(F.col(c))), 8).alias(c)
    return df.groupBy("method").agg(mean("precision"), mean("recall"), mean("f1"), F.round(F.avg("n_pred"), 6).alias("mean_pred"))


def boundary_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _macro(_aligned(spark, sf_dir, TAUS, [], [TOLERANCE]))


def best_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold with the best F1; of equals the first."""
    m = _macro(_aligned(spark, sf_dir, TAUS, [], [TOLERANCE]))
    tau = F.substring("method", 5, 9).cast("double")
    return m.agg(F.max_by("method", F.struct(F.col("f1"), -tau)).alias("method"), F.max("f1").alias("f1"))


def tolerance_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of unrounded values by method and tolerance; the gold boundaries are found once for all."""
    mean = lambda c: F.round(F.avg(c), 8).alias(c)
    return _aligned(spark, sf_dir, [1.0], CHUNKS, TOLERANCES).groupBy("method", "tolerance").agg(mean("precision"), mean("recall"), mean("f1"))


def boundary_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 for each hundred boundaries on average, and its difference to the entropy method's."""
    m = _macro(_aligned(spark, sf_dir, [1.0], CHUNKS, [TOLERANCE]))
    base = F.max(F.when(F.col("method") == "tau_1.0", F.col("f1"))).over(Window.partitionBy())
    return m.select("method", "f1", "mean_pred", F.round(100 * F.col("f1") / F.col("mean_pred"), 8).alias("efficiency"), F.round(F.col("f1") - base, 8).alias("delta"))


def sweep_alignment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches, compression and alignment of each threshold in one table, the best one flagged."""
    t = _totals(_swept(spark, sf_dir))
    m = _macro(_aligned(spark, sf_dir, TAUS, [], [TOLERANCE])).withColumn("tau", F.substring("method", 5, 9).cast("double"))
    best = F.col("f1") == F.max("f1").over(Window.partitionBy())
    return t.join(m, "tau").select("tau", "patches", "bytes_per_patch", "precision", "recall", "f1", best.alias("best"))


def greedy_boundary_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-to-one match; an empty side gives 0."""
    docs = _docs(spark, sf_dir)
    g = A.greedy(docs, "doc_id", "text", E.entropy_table(docs, "text"), 1.5, 2)
    p, r = F.coalesce(F.try_divide("hits", "n_pred"), F.lit(0.0)), F.coalesce(F.try_divide("hits", "n_gold"), F.lit(0.0))
    return g.select("doc_id", "n_pred", "n_gold", "hits", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def morpheme_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries of words and morphemes of every document: how many, and the last."""
    g = A.gold_by_morphemes(_docs(spark, sf_dir), "doc_id", "text")
    return g.select("doc_id", F.size("gold").alias("n_gold"), F.array_max("gold").alias("last"))


def _list(values: list) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


_HINDI = "['ों', 'ें', 'याँ', 'ियाँ', 'ता', 'ती', 'ते', 'ना', 'ने', 'कर', 'करना', 'वाला', 'वाली', 'वाले', 'पन', 'कारी', 'कार', 'ई', 'आई', 'ता है', 'ती है']"
_WORDS = (
    "ch AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS c, unnest(range(length(text))) AS i FROM documents WHERE text <> '')"
    ", co AS (SELECT *, sum(strlen(c)) OVER w - strlen(c) AS o, regexp_matches(c, '^" + X.WHITE + "$') AS space, lag(regexp_matches(c, '^" + X.WHITE + "$'), 1, true) OVER w AS before FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY i))"
    ", wd AS (SELECT *, sum(CASE WHEN before OR c = '\u0964' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS w FROM co WHERE NOT space)"
    ", ws AS (SELECT doc_id, min(o)::BIGINT AS first, string_agg(c, '' ORDER BY i) AS word FROM wd GROUP BY doc_id, w)"
)
_GOLD = _H + (
    f", y AS MATERIALIZED (SELECT doc_id, unnest(b) AS byte, unnest(range(len(b))) AS i, len(b) AS n FROM d), {_WORDS}, suffix AS (SELECT unnest({_HINDI}) AS s)"
    ", gold AS MATERIALIZED (SELECT doc_id, 0 AS i FROM d UNION SELECT doc_id, first FROM ws UNION SELECT doc_id, first + strlen(word) - strlen(s) FROM ws JOIN suffix ON ends_with(word, s) AND length(word) > length(s) + 1)"
    ", ent AS MATERIALIZED (SELECT y.doc_id, y.i, CASE WHEN y.i = y.n - 1 THEN 8.0 ELSE coalesce(h.h, 8.0) END AS e FROM y LEFT JOIN h ON h.prev = y.byte)"
)


def _aligned_sql(taus: list[float], chunks: list[int], tolerances: list[int]) -> str:
    parts = [f"SELECT doc_id, 'tau_{t}' AS method, i FROM ent WHERE e > {t}" for t in taus]
    parts += [f"SELECT doc_id, 'fixed_{k}' AS method, i FROM y WHERE i > 0 AND i % {k} = 0" for k in chunks]
    methods = _list([*(f"tau_{t}" for t in taus), *(f"fixed_{k}" for k in chunks)])
    return _GOLD + (
        f", pred AS MATERIALIZED ({' UNION ALL '.join(parts)}), tol AS (SELECT unnest({_list(tolerances)})::INT AS tolerance), off AS (SELECT tolerance, unnest(range(-tolerance, tolerance + 1)) AS o FROM tol)"
        ", cells AS (SELECT d.doc_id, len(b)::BIGINT AS n_bytes, m.method, tolerance FROM d CROSS JOIN (SELECT unnest(" + methods + ") AS method) m CROSS JOIN tol)"
        ", np AS (SELECT doc_id, method, count(*) AS n FROM pred GROUP BY 1, 2), ng AS (SELECT doc_id, count(*) AS n FROM gold GROUP BY 1)"
        ", gx AS MATERIALIZED (SELECT doc_id, i AS gi, tolerance, i + o AS i FROM gold CROSS JOIN off), gn AS MATERIALIZED (SELECT DISTINCT doc_id, tolerance, i FROM gx)"
        ", hp AS (SELECT p.doc_id, p.method, gn.tolerance, count(*) AS n FROM gn JOIN pred p ON p.doc_id = gn.doc_id AND p.i = gn.i GROUP BY 1, 2, 3)"
        ", hg AS (SELECT doc_id, method, tolerance, count(*) AS n FROM (SELECT DISTINCT p.doc_id, p.method, gx.tolerance, gx.gi FROM gx JOIN pred p ON p.doc_id = gx.doc_id AND p.i = gx.i) GROUP BY 1, 2, 3)"
        ", raw AS (SELECT c.doc_id, c.method, c.tolerance, n_bytes, coalesce(np.n, 0) AS n_pred, coalesce(ng.n, 0) AS n_gold, coalesce(hp.n, 0) AS hit_pred, coalesce(hg.n, 0) AS hit_gold FROM cells c"
        " LEFT JOIN np ON np.doc_id = c.doc_id AND np.method = c.method LEFT JOIN ng ON ng.doc_id = c.doc_id"
        " LEFT JOIN hp ON hp.doc_id = c.doc_id AND hp.method = c.method AND hp.tolerance = c.tolerance LEFT JOIN hg ON hg.doc_id = c.doc_id AND hg.method = c.method AND hg.tolerance = c.tolerance)"
        ", pr AS (SELECT *, CASE WHEN n_pred = 0 AND n_gold = 0 THEN 1.0 WHEN n_pred = 0 OR n_gold = 0 THEN 0.0 ELSE hit_pred / n_pred END AS precision,"
        " CASE WHEN n_pred = 0 AND n_gold = 0 THEN 1.0 WHEN n_pred = 0 OR n_gold = 0 THEN 0.0 ELSE hit_gold / n_gold END AS recall FROM raw)"
        ", f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pr)"
        ", macro AS (SELECT method, round(avg(floor(precision * 10000 + 0.5) / 10000), 8) AS precision, round(avg(floor(recall * 10000 + 0.5) / 10000), 8) AS recall,"
        " round(avg(floor(f1 * 10000 + 0.5) / 10000), 8) AS f1, round(avg(n_pred), 6) AS mean_pred FROM f GROUP BY method)"
    )


_FIVE = _aligned_sql(TAUS, [], [TOLERANCE])
_THREE = _aligned_sql([1.0], CHUNKS, [TOLERANCE])
_T_PART = ENTROPY_SQL["bigram_tau_sweep"].split(" SELECT * FROM t")[0]

SQL = {
    "proxy_boundaries": f"WITH {_GOLD} SELECT d.doc_id, len(b)::BIGINT AS n_bytes, g.n AS n_gold FROM d JOIN (SELECT doc_id, count(*) AS n FROM gold GROUP BY 1) g ON g.doc_id = d.doc_id",
    "alignment_by_document": f"WITH {_FIVE} SELECT doc_id, method, n_pred, n_gold, hit_pred, hit_gold, precision, recall, f1 FROM f",
    "boundary_prf": f"WITH {_FIVE} SELECT * FROM macro",
    "best_tau": f"WITH {_FIVE} SELECT method, f1 FROM macro ORDER BY f1 DESC, method LIMIT 1",
    "tolerance_sensitivity": f"WITH {_aligned_sql([1.0], CHUNKS, TOLERANCES)} SELECT method, tolerance, round(avg(precision), 8) AS precision, round(avg(recall), 8) AS recall, round(avg(f1), 8) AS f1 FROM f GROUP BY 1, 2",
    "boundary_efficiency": f"WITH {_THREE} SELECT method, f1, mean_pred, round(100 * f1 / mean_pred, 8) AS efficiency, round(f1 - max(CASE WHEN method = 'tau_1.0' THEN f1 END) OVER (), 8) AS delta FROM macro",
    "greedy_boundary_f1": f"WITH RECURSIVE {_GOLD.replace('h AS (SELECT', 'h AS MATERIALIZED (SELECT')}, pr AS MATERIALIZED (SELECT doc_id, i FROM ent WHERE e > 1.5)"
    ", ca AS (SELECT p.doc_id, p.i, g.i AS g, abs(g.i - p.i) AS far FROM (SELECT doc_id, i, unnest(range(i - 2, i + 3)) AS at FROM pr) p JOIN gold g ON g.doc_id = p.doc_id AND g.i = p.at)"
    ", li AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, c FROM (SELECT doc_id, i, list(g ORDER BY far, g) AS c FROM ca GROUP BY 1, 2))"
    ", st AS (SELECT doc_id, k, [c[1]] AS used, 1 AS hits FROM li WHERE k = 1 UNION ALL SELECT l.doc_id, l.k, CASE WHEN f IS NULL THEN used ELSE list_append(used[-5:], f) END, hits + CASE WHEN f IS NULL THEN 0 ELSE 1 END"
    " FROM (SELECT st.doc_id, li.k, used, hits, list_filter(c, lambda x: NOT list_contains(used, x))[1] AS f FROM st JOIN li ON li.doc_id = st.doc_id AND li.k = st.k + 1) l)"
    ", en AS (SELECT doc_id, max(hits) AS hits FROM st GROUP BY 1), z AS (SELECT d.doc_id, coalesce(p.n, 0) AS n_pred, g.n AS n_gold, coalesce(en.hits, 0) AS hits FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM pr GROUP BY 1) p USING (doc_id)"
    " JOIN (SELECT doc_id, count(*) AS n FROM gold GROUP BY 1) g USING (doc_id) LEFT JOIN en USING (doc_id)), q AS (SELECT *, coalesce(hits / nullif(n_pred, 0), 0) AS precision, coalesce(hits / nullif(n_gold, 0), 0) AS recall FROM z)"
    " SELECT doc_id, n_pred, n_gold, hits::BIGINT AS hits, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM q",
    "morpheme_gold": "WITH ch AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS c, unnest(range(length(text))) AS i, strlen(text) AS total FROM documents WHERE text <> '')"
    ", k AS (SELECT *, sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY i) AS past, CASE WHEN regexp_matches(c, '^" + X.WHITE + "$') THEN 's' WHEN regexp_matches(c, '^[\\p{L}\\p{N}_\u0900-\u0963]$') THEN 'w' ELSE 'o' END AS kind FROM ch)"
    ", t AS (SELECT *, CASE WHEN kind = 'o' OR lag(kind, 1, 's') OVER (PARTITION BY doc_id ORDER BY i) <> kind THEN 1 ELSE 0 END AS new FROM k)"
    ", n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS token FROM t), w AS (SELECT doc_id, string_agg(c, '' ORDER BY i) AS word, max(past) AS past, any_value(total) AS total FROM n WHERE kind <> 's' GROUP BY doc_id, token)"
    ", sx AS (SELECT unnest(['च्या', 'साठी', 'बद्दल', 'पासून', 'ला', 'ने', 'ची', 'चे', 'ing', 'ed', 's']) AS s), cut AS (SELECT doc_id, past, word, max_by(s, length(s)) AS s FROM w JOIN sx ON ends_with(word, s) AND length(word) > length(s) + 1 GROUP BY doc_id, past, word)"
    ", b AS (SELECT doc_id, past AS x FROM w WHERE past < total UNION SELECT doc_id, past - strlen(s) FROM cut)"
    " SELECT d.doc_id, count(x)::INT AS n_gold, max(x)::INT AS last FROM (SELECT doc_id FROM documents WHERE text <> '') d LEFT JOIN b ON b.doc_id = d.doc_id GROUP BY 1",
    "sweep_alignment_table": f"{_T_PART}, al AS (WITH {_FIVE} SELECT method[5:]::DOUBLE AS tau, precision, recall, f1 FROM macro) SELECT t.tau, patches, bytes_per_patch, precision, recall, f1, f1 = max(f1) OVER () AS best FROM t JOIN al ON al.tau = t.tau",
}

QUERIES = {
    f.__name__: f
    for f in (proxy_boundaries, alignment_by_document, boundary_prf, best_tau, tolerance_sensitivity, boundary_efficiency, sweep_alignment_table, greedy_boundary_f1, morpheme_gold)
}
