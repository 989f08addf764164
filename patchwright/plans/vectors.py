"""Vector queries over embeddings; sequences over their ids."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import vectors as V
from ..sources.tables import spread, table

STEPS = 100


def _vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all vectors for every vector whose id is divisible by 20."""
    v = _vecs(spark, sf_dir)
    return V.nearest(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 5).select("query_id", "rank", "neighbour_id", F.round("score", 6).alias("score"))


def knn_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vecs(spark, sf_dir)
    return V.nearest(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 1).select("query_id", "neighbour_id", F.round("score", 6).alias("score"))


def retrieval_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every 20th vector: the label that follows its nearest neighbour, and the one that truly follows."""
    v = _vecs(spark, sf_dir)
    after = _shifted(v)
    best = V.nearest(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 1)
    a = after.select(F.col("vec_id").alias("neighbour_id"), F.col("next_label").alias("predicted"))
    b = after.select(F.col("vec_id").alias("query_id"), F.col("next_label").alias("actual"))
    return best.join(a, "neighbour_id").join(b, "query_id").select("query_id", "predicted", "actual")


def _shifted(v: DataFrame) -> DataFrame:
    """Sequences of ten vectors by id: each with the one after it; the last of a sequence has none."""
    w = Window.partitionBy("seq").orderBy("vec_id")
    s = v.withColumn("seq", F.floor(F.col("vec_id") / 10))
    return s.select("seq", "vec_id", "label", "embedding", F.lead("vec_id").over(w).alias("next_id"), F.lead("label").over(w).alias("next_label"), F.lead("embedding").over(w).alias("next"))


def shift_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _shifted(_vecs(spark, sf_dir)).where("next is not null")
    return s.select("vec_id", "next_id", F.round(V.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


def prefix_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of three or more of a sequence of ten, and what it has to predict."""
    w = Window.partitionBy("seq").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, -1)
    s = _vecs(spark, sf_dir).withColumn("seq", F.floor(F.col("vec_id") / 10))
    return s.withColumn("prefix", F.collect_list("vec_id").over(w)).where("size(prefix) >= 3").select("vec_id", "prefix")


def position_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squared difference of a vector and the one after it, by position in the sequence."""
    s = _shifted(_vecs(spark, sf_dir)).where("next is not null").withColumn("pos", F.col("vec_id") % 10)
    mse = F.aggregate(F.zip_with("embedding", "next", lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2.0))), F.lit(0.0), lambda x, y: x + y) / F.size("embedding")
    return s.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(mse), 7).alias("mse"))


def stop_criterion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each ten vectors come before one like the end vector (the first of all, which stands for an end of text) or like the one
    before it, by a cosine above 0.9; and the same at 0.2, which these vectors reach more often."""
    v = _vecs(spark, sf_dir).withColumn("seq", F.floor(F.col("vec_id") / 10))
    end = v.orderBy("vec_id").limit(1).select(F.col("embedding").alias("end"))
    ends = end.first()
    fixed = F.array(*(F.lit(float(x)) for x in ends[0])) if ends else F.array().cast("array<double>")
    strict, loose = (V.stops(v, "seq", "vec_id", "embedding", fixed, m) for m in (0.9, 0.2))
    return strict.join(loose.select("seq", F.col("kept").alias("kept_loose"), F.col("reason").alias("reason_loose")), "seq")


def normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vecs(spark, sf_dir).select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(F.get(V.normalised(F.col("embedding")), F.lit(0)), 6).alias("first"))


def logit_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shannon entropy in nats of the softmax of each vector."""
    x = F.transform("embedding", lambda a: a.cast("double"))
    z = F.zip_with(x, F.array_repeat(F.array_max(x), F.size(x)), lambda a, m: a - m)
    sums = F.aggregate(z, F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("u")), lambda s, a: F.struct((s["t"] + F.exp(a)).alias("t"), (s["u"] + F.exp(a) * a).alias("u")))
    h = F.ln(sums["t"]) - sums["u"] / sums["t"]
    return _vecs(spark, sf_dir).select("vec_id", F.round(h, 7).alias("entropy"))


def robust_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V.quartiles(_vecs(spark, sf_dir), "embedding")
    return q.select("dim", F.round("median", 7).alias("median"), F.round("iqr", 7).alias("iqr"))


def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last scaled component, and how far scaling back misses the vector."""
    v = _vecs(spark, sf_dir).withColumn("raw", F.col("embedding"))
    q = V.quartiles(v, "embedding").persist()
    s = V.scaled(v, "embedding", q).withColumn("scaled", F.col("embedding"))
    off = F.array_max(F.zip_with("embedding", "raw", lambda a, b: F.abs(a - b.cast("double"))))
    back = V.scaled(s, "embedding", q, inverse=True)
    return back.select("vec_id", F.round(F.get("scaled", F.lit(0)), 6).alias("first"), F.round(F.element_at("scaled", -1), 6).alias("last"), (off < 1e-6).alias("returns"))


def mean_pool_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each label, component by component."""
    return _vecs(spark, sf_dir).select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 7).alias("mean"))


def masked_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of each ten vectors without those whose id is divisible by 3, which stand for padding."""
    v = _vecs(spark, sf_dir).withColumn("seq", F.floor(F.col("vec_id") / 10))
    return V.masked_mean(v, "seq", F.col("vec_id") % 3 != 0, "embedding").select("seq", "dim", F.round("mean", 7).alias("mean"))


def _books(v: DataFrame):
    return V.codebooks(v, "vec_id", "embedding", 2, 16, 8)


def rvq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes on two levels of sixteen centroids, and the error left."""
    v = _vecs(spark, sf_dir)
    return V.quantised(v, "vec_id", "embedding", _books(v))


def rvq_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the codes of one level and of both give back: the squared distance to the vector."""
    v = _vecs(spark, sf_dir)
    books = _books(v)
    codes = V.quantised(v, "vec_id", "embedding", books)
    one, two = (V.decoded(codes, "vec_id", books, n).withColumnRenamed("vector", f"v{n}") for n in (1, 2))
    far = lambda c: F.round(F.aggregate(F.zip_with("embedding", c, lambda a, b: F.pow(a.cast("double") - b, F.lit(2.0))), F.lit(0.0), lambda x, y: x + y), 6)
    return v.join(one, "vec_id").join(two, "vec_id").select("vec_id", far("v1").alias("error_one"), far("v2").alias("error_two"))


def running_robust_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians and interquartile ranges of batches of fifty vectors by id, blended with momentum 0.9, of every component."""
    q = V.running_quartiles(_vecs(spark, sf_dir), "vec_id", "embedding")
    return q.select("dim", F.round("median", 7).alias("median"), F.round("iqr", 7).alias("iqr"), "batches")


def noise_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alpha-bar of three schedules over a hundred steps, the last with no signal left."""
    t = spark.range(1, STEPS + 1).select(F.col("id").alias("step"), (F.col("id") / STEPS).alias("t"))
    w = Window.orderBy("step")
    parts = []
    for name in ("cosine", "quadratic", "sigmoid"):
        raw = t.withColumn("a", V.noise_schedule(name, STEPS))
        if name == "quadratic":
            raw = raw.withColumn("a", F.exp(F.sum(F.ln("a")).over(w)))
        raw = raw.withColumn("r", F.sqrt(F.greatest(F.least("a", F.lit(1.0)), F.lit(1e-8))))
        ends = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first, last = F.first("r").over(ends), F.last("r").over(ends)
        parts.append(raw.select(F.lit(name).alias("schedule"), "step", F.round(F.pow((F.col("r") - last) * first / (first - last), F.lit(2.0)), 8).alias("alpha_bar")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def ngram_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling hashes of the byte ids of every document, three, four and five at a time: how many, how many are undefined, the last table
    index, and the sum of each index times its position from 1, modulo 2**61 - 1."""

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for record, t in zip(f["doc_id"], f["text"]):
                ids = [b + 4 for b in t.encode()]
                for n in (3, 4, 5):
                    h = V.rolling_hashes(ids, n)
                    slots = [x % 500_000 if x >= 0 else -1 for x in h]
                    digest = sum(i * x for i, x in enumerate(slots, 1) if x >= 0) % V.PRIME
                    rows.append((record, n, len(h), h.count(-1), slots[-1] if slots else -1, digest))
            yield pd.DataFrame(rows, columns=["doc_id", "size", "n", "undefined", "last_slot", "slots_digest"])

    d = spread(table(spark, sf_dir, "documents")).where("text is not null")
    return d.select("doc_id", "text").mapInPandas(score, "doc_id bigint, size int, n bigint, undefined bigint, last_slot bigint, slots_digest bigint")


def budget_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by length into bins of a padded size of at most 65536 bytes and 64 rows."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"))
    return V.packed(d, "doc_id", "n_bytes", 65_536, 64)


def parameter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a grid of widths and layers, the configuration whose closed-form parameter count is nearest to ten million."""
    grid = spark.range(1, 13).select(F.col("id").alias("layers")).select("layers", F.explode(F.array(*(F.lit(64 * k) for k in range(2, 17)))).alias("width"))
    n = 260 * F.col("width") + F.col("layers") * (12 * F.col("width") * F.col("width") + 13 * F.col("width")) + 2 * F.col("width")
    c = grid.withColumn("parameters", n).withColumn("error", F.abs(n - 10_000_000) / 10_000_000)
    return c.orderBy("error", "layers", "width").limit(1).select("layers", "width", "parameters", F.round("error", 8).alias("error"))


def byte_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exp of the mean entropy (taken as nats) of each run's bytes, and bits a byte."""
    r = table(spark, sf_dir, "blt_marathi_patched").select("run_name", F.explode("entropy_per_byte").alias("h"))
    return r.groupBy("run_name").agg(F.round(F.exp(F.avg("h")), 7).alias("perplexity"), F.round(F.avg("h") / F.ln(F.lit(2.0)), 7).alias("bits_per_byte"))


_SIM = "list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"
_KNN = f"k AS (SELECT q.vec_id AS query_id, v.vec_id AS neighbour_id, {_SIM} AS s FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id), r AS (SELECT query_id, neighbour_id, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, neighbour_id)::INT AS rank FROM k)"
_SEQ = "s AS (SELECT vec_id // 10 AS seq, vec_id, label, embedding::DOUBLE[] AS e, lead(vec_id) OVER w AS next_id, lead(label) OVER w AS next_label, lead(embedding::DOUBLE[]) OVER w AS nx FROM embeddings WINDOW w AS (PARTITION BY vec_id // 10 ORDER BY vec_id))"
_Q = "u AS (SELECT vec_id, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), q AS (SELECT dim::INT AS dim, quantile_cont(x, 0.5) AS median, greatest(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 1e-6) AS iqr FROM u GROUP BY 1)"
_SCHEDULE = (
    "t AS (SELECT i AS step, i / 100 AS t FROM range(1, 101) x(i)),"
    " raw AS (SELECT 'cosine' AS schedule, step, pow(cos((t + 0.008) / 1.008 * pi() / 2), 2) / pow(cos(0.008 / 1.008 * pi() / 2), 2) AS a FROM t"
    " UNION ALL SELECT 'quadratic', step, exp(sum(ln(1 - pow(sqrt(0.001) + t * (sqrt(0.0012) - sqrt(0.001)), 2))) OVER (ORDER BY step)) FROM t"
    " UNION ALL SELECT 'sigmoid', step, (1 / (1 + exp(-(-1.0 - 1.5 * ln(greatest(least(t, 1 - 1e-6), 1e-6) / (1 - greatest(least(t, 1 - 1e-6), 1e-6))))))) / (1 / (1 + exp(-(-1.0 - 1.5 * ln(1e-6 / (1 - 1e-6)))))) FROM t),"
    " r AS (SELECT schedule, step, sqrt(greatest(least(a, 1.0), 1e-8)) AS r FROM raw), e AS (SELECT *, first_value(r) OVER w AS f, last_value(r) OVER w AS l FROM r WINDOW w AS (PARTITION BY schedule ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
)

SQL = {
    "knn_topk": f"WITH {_KNN} SELECT query_id, rank, neighbour_id, round(s, 6) AS score FROM r WHERE rank <= 5",
    "knn_top1": f"WITH {_KNN} SELECT query_id, neighbour_id, round(s, 6) AS score FROM r WHERE rank = 1",
    "retrieval_decode": f"WITH {_KNN}, {_SEQ} SELECT r.query_id, a.next_label AS predicted, b.next_label AS actual FROM r JOIN s a ON a.vec_id = r.neighbour_id JOIN s b ON b.vec_id = r.query_id WHERE rank = 1",
    "shift_pairs": f"WITH {_SEQ} SELECT vec_id, next_id, round(list_cosine_similarity(e, nx), 6) AS cosine FROM s WHERE nx IS NOT NULL",
    "prefix_windows": "WITH p AS (SELECT vec_id, list(vec_id) OVER (PARTITION BY vec_id // 10 ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prefix FROM embeddings) SELECT * FROM p WHERE len(prefix) >= 3",
    "position_mse": f"WITH {_SEQ} SELECT vec_id % 10 AS pos, count(*) AS n, round(avg(pow(list_distance(e, nx), 2) / len(e)), 7) AS mse FROM s WHERE nx IS NOT NULL GROUP BY 1",
    "stop_criterion": "WITH z AS (SELECT embedding::DOUBLE[] AS z FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id // 10 AS seq, row_number() OVER w AS i, list_cosine_similarity(embedding::DOUBLE[], z) AS e, coalesce(list_cosine_similarity(embedding::DOUBLE[], lag(embedding::DOUBLE[]) OVER w), -1) AS p FROM embeddings CROSS JOIN z WINDOW w AS (PARTITION BY vec_id // 10 ORDER BY vec_id)), g AS (SELECT seq, count(*) AS n"
    + "".join(f", min(i) FILTER (WHERE e > {m} OR p > {m}) AS f{k}" for k, m in ((1, 0.9), (2, 0.2))) + " FROM s GROUP BY 1) SELECT g.seq"
    + "".join(f", coalesce(f{k} - 1, n)::INT AS kept{x}, (SELECT CASE WHEN e > {m} THEN 'end' ELSE 'loop' END FROM s WHERE s.seq = g.seq AND s.i = g.f{k}) AS reason{x}" for k, m, x in ((1, 0.9, ""), (2, 0.2, "_loose"))) + " FROM g",
    "normalise": "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings",
    "logit_entropy": "WITH z AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE - list_max(embedding)::DOUBLE) AS z FROM embeddings), t AS (SELECT vec_id, z, list_sum(list_transform(z, lambda x: exp(x))) AS t FROM z) SELECT vec_id, round(list_sum(list_transform(z, lambda x: exp(x) / t * (ln(t) - x))), 7) AS entropy FROM t",
    "robust_quartiles": f"WITH {_Q} SELECT dim, round(median, 7) AS median, round(iqr, 7) AS iqr FROM q",
    "robust_scale": f"WITH {_Q} SELECT vec_id, round(max(CASE WHEN u.dim = 0 THEN (x - median) / iqr END), 6) AS first, round(max(CASE WHEN u.dim = 63 THEN (x - median) / iqr END), 6) AS last, max(abs((x - median) / iqr * iqr + median - x)) < 1e-6 AS returns FROM u JOIN q ON u.dim = q.dim GROUP BY 1",
    "mean_pool_by_label": "WITH u AS (SELECT label, unnest(range(len(embedding)))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, dim, round(avg(x), 7) AS mean FROM u GROUP BY 1, 2",
    "masked_pool": "WITH u AS (SELECT vec_id, vec_id // 10 AS seq, unnest(range(len(embedding)))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT seq, dim, round(coalesce(sum(x) FILTER (WHERE vec_id % 3 <> 0), 0) / greatest(1, count(*) FILTER (WHERE vec_id % 3 <> 0)), 7) AS mean FROM u GROUP BY 1, 2",
    "running_robust_stats": "WITH u AS (SELECT vec_id // 50 AS batch, unnest(range(len(embedding)))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), b AS (SELECT batch, dim, quantile_cont(x, 0.5) AS m, greatest(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 1e-6) AS r FROM u GROUP BY 1, 2), s AS (SELECT dim, list(m ORDER BY batch) AS m, list(r ORDER BY batch) AS r FROM b GROUP BY 1) SELECT dim, round(list_reduce(m, lambda a, x: 0.9::DOUBLE * a + 0.1::DOUBLE * x), 7) AS median, round(list_reduce(r, lambda a, x: 0.9::DOUBLE * a + 0.1::DOUBLE * x), 7) AS iqr, len(m)::INT AS batches FROM s",
    "ngram_hash": "WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::HUGEINT + 4) AS b FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, b, unnest([3, 4, 5]) AS size FROM d)"
    ", h AS (SELECT doc_id, size, len(b) AS n, list_transform(range(size, len(b) + 1), lambda e: (b[e] + b[e - 1] * 1000000007 + b[e - 2] * 1000000014000000049 % 2305843009213693951"
    " + CASE WHEN size > 3 THEN b[e - 3] * ((1000000014000000049::HUGEINT * 1000000007) % 2305843009213693951) ELSE 0 END"
    " + CASE WHEN size > 4 THEN b[e - 4] * ((((1000000014000000049::HUGEINT * 1000000007) % 2305843009213693951) * 1000000007) % 2305843009213693951) ELSE 0 END) % 2305843009213693951 % 500000) AS slots FROM s)"
    " SELECT doc_id, size, n, least(n, size - 1)::BIGINT AS undefined, coalesce(slots[-1], -1)::BIGINT AS last_slot, (coalesce(list_sum(list_transform(slots, lambda x, i: x * (i + size - 1))), 0) % 2305843009213693951)::BIGINT AS slots_digest FROM h",
    "budget_packing": "WITH RECURSIVE r AS (SELECT doc_id, strlen(text)::BIGINT AS n, row_number() OVER (ORDER BY strlen(text), doc_id) AS i FROM documents WHERE text IS NOT NULL)"
    ", p AS (SELECT i, doc_id, n, 0::BIGINT AS bin, 1 AS held FROM r WHERE i = 1 UNION ALL SELECT r.i, r.doc_id, r.n, CASE WHEN (held + 1) * r.n > 65536 OR held >= 64 THEN bin + 1 ELSE bin END, CASE WHEN (held + 1) * r.n > 65536 OR held >= 64 THEN 1 ELSE held + 1 END FROM p JOIN r ON r.i = p.i + 1)"
    " SELECT doc_id, n AS n_bytes, bin FROM p",
    "noise_schedules": f"WITH {_SCHEDULE} SELECT schedule, step, round(pow((r - l) * f / (f - l), 2), 8) AS alpha_bar FROM e",
    "parameter_counts": "WITH g AS (SELECT l AS layers, w * 64 AS width FROM range(1, 13) a(l), range(2, 17) b(w)), c AS (SELECT *, 260 * width + layers * (12 * width * width + 13 * width) + 2 * width AS parameters FROM g) SELECT layers, width::INT AS width, parameters, round(abs(parameters - 10000000) / 10000000, 8) AS error FROM c ORDER BY abs(parameters - 10000000), layers, width LIMIT 1",
    "byte_perplexity": "SELECT run_name, round(exp(avg(h)), 7) AS perplexity, round(avg(h) / ln(2.0), 7) AS bits_per_byte FROM (SELECT run_name, unnest(entropy_per_byte) AS h FROM blt_marathi_patched) GROUP BY 1",
}

QUERIES = {
    f.__name__: f
    for f in (
        knn_topk, knn_top1, retrieval_decode, shift_pairs, prefix_windows, position_mse, stop_criterion, normalise, logit_entropy, robust_quartiles, robust_scale, mean_pool_by_label, masked_pool,
        rvq_encode, rvq_decode, running_robust_stats, noise_schedules, ngram_hash, budget_packing, parameter_counts, byte_perplexity,
    )
}
