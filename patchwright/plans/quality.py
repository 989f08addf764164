"""Noise grids and their scores over the targets of pairs, comparison tables, significance."""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as X
from ..operators import compare as C
from ..operators import metrics as M
from ..operators import noise as N
from ..operators import order as O
from ..operators import significance as G
from ..sources.shared import written
from ..sources.tables import spread, table
from .texts import _draws_sql, _labels_sql, _noise_sql

NOISES, SEEDS, REPLICATES = [0.0, 0.1, 0.2], [42, 43, 44], 1000
CELLS = [(s, p) for s in SEEDS for p in NOISES]
#: The cell of the grid that the completeness queries take for missing.
LOST = "not (seed = 44 and noise = 0.2)"


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "parallel_examples").select("pair_id", "target"))


def _counts(spark: SparkSession, sf_dir: str, what: tuple[str, ...] = ("chrf",), cells: list[tuple[int, float]] = CELLS) -> DataFrame:
    return M.noised_counts(_targets(spark, sf_dir), "pair_id", "target", cells, what)


def chrfpp_by_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).groupBy("seed", "noise").agg(F.round(M.chrf_score(M.chrf_sums()), 7).alias("chrfpp"), F.count(F.lit(1)).alias("segments"))


def bleu_by_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir, ("bleu",)).groupBy("seed", "noise").agg(F.round(M.bleu_score(), 7).alias("bleu"))


def edit_metrics_by_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WER, TER (with shifts) and exact-match METEOR in per cent."""
    c = _counts(spark, sf_dir, ("ref_words", "wer", "ter", "meteor"))
    words = F.sum("ref_words")
    return c.groupBy("seed", "noise").agg(F.round(100 * F.sum("wer") / words, 7).alias("wer"), F.round(100 * F.sum("ter") / words, 7).alias("ter"), F.round(100 * F.avg("meteor"), 7).alias("meteor"))


def length_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many noised documents are so much longer than they were, in characters, in each cell."""
    g = N.grid(spread(table(spark, sf_dir, "documents")), "doc_id", "text", CELLS)
    return g.groupBy("seed", "noise", (F.length("hyp") - F.length("ref")).alias("delta")).agg(F.count(F.lit(1)).alias("n"))


def identical_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all hypotheses of a cell are the references."""
    g = N.grid(_targets(spark, sf_dir), "pair_id", "target", CELLS)
    return g.groupBy("seed", "noise").agg(F.bool_and(F.col("hyp") == F.col("ref")).alias("identical"))


def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, sample deviation and t interval over the seeds; one seed has deviation 0 and an interval without width."""
    g = chrfpp_by_noise(spark, sf_dir).groupBy("noise").agg(F.count("chrfpp").alias("n"), F.avg("chrfpp").alias("mean"), F.coalesce(F.stddev_samp("chrfpp"), F.lit(0.0)).alias("std"))
    half = F.when(F.col("n") < 2, 0.0).otherwise(S.t_critical(F.col("n") - 1) * F.col("std") / F.sqrt("n"))
    return g.select("noise", "n", *(F.round(c, 6).alias(a) for c, a in ((F.col("mean"), "mean"), (F.col("std"), "std"), (F.col("mean") - half, "low"), (F.col("mean") + half, "high"))))


def _metric_rows(spark: SparkSession, sf_dir: str, metrics: tuple[str, ...] = ("BLEU", "chrF++")) -> DataFrame:
    """model, fraction, noise, metrics, written: the scores as the rows of three models, with a copy of one row that was written again. The
    scores (a row for each cell) are written once: every reader of the rows would count all texts again."""
    of = {"BLEU": ("bleu", M.bleu_score()), "chrF++": ("chrf", M.chrf_score(M.chrf_sums()))}
    sums = M.noised_sums(_targets(spark, sf_dir), "pair_id", "target", CELLS, tuple(of[m][0] for m in metrics))
    scores = sums.where(LOST).groupBy("seed", "noise").agg(*(of[m][1].alias(m) for m in metrics))
    c = written(scores, "metric-rows")
    rows = c.select(F.element_at(F.create_map(*(F.lit(x) for x in (42, "BLT LCM", 43, "bpe-lcm", 44, "Base LCM"))), F.col("seed")).alias("model"), F.lit("0.5").alias("fraction"), "noise", *metrics, F.lit(1).alias("written"))
    again = rows.where("model = 'BLT LCM' and noise = 0.1").select("model", "fraction", "noise", *((F.col(f"`{m}`") + 1).alias(m) for m in metrics), F.lit(2).alias("written"))
    other = rows.where("noise = 0").withColumn("fraction", F.lit("0.25"))
    return rows.unionByName(again).unionByName(other)


def metric_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three models at one fraction: a row for each noise, a column for each model and metric, and which models are there; the last row
    written counts, a missing one is null."""
    p = C.metric_pivot(_metric_rows(spark, sf_dir), 0.5, ["base_lcm", "blt_lcm", "bpe_lcm"], ["BLEU", "chrF++"], "written")
    scores = [c for c in p.columns if c not in ("noise", "models_present")]
    return p.select("noise", "models_present", *(F.round(F.col(f"`{c}`"), 6).alias(c.replace("++", "pp").lower()) for c in scores))


def metric_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The degradation curves of two models at one fraction: one row for each model and noise, with its place in the requested order."""
    rows = _metric_rows(spark, sf_dir, ("chrF++",)).where(C.near(F.col("fraction").cast("double"), 0.5))
    curve = C.curve(rows, ["bpe_lcm", "blt_lcm"], NOISES, "chrF++", "written")
    place = F.array_position(F.array(F.lit("bpe_lcm"), F.lit("blt_lcm")), F.col("model")).cast("int")
    return curve.select(place.alias("place"), "model", "noise", F.round("value", 6).alias("value"))


def missing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the grid that should be there and aren't, as model@noise: the grid has them as soon as it has a segment."""
    have = _targets(spark, sf_dir).where("target is not null").limit(1).select(F.explode(F.array(*(F.struct(F.lit(s).alias("seed"), F.lit(p).alias("noise")) for s, p in CELLS))).alias("c"))
    want = spark.createDataFrame(CELLS, "seed int, noise double")
    return want.join(have.select("c.seed", "c.noise").where(LOST), ["seed", "noise"], "left_anti").select(F.format_string("seed_%d@%.1f", "seed", "noise").alias("cell"))


def noise_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score at each noise, and what is lost against none."""
    g = chrfpp_by_noise(spark, sf_dir).groupBy("noise").agg(F.avg("chrfpp").alias("m"))
    clean = F.max(F.when(F.col("noise") == 0, F.col("m"))).over(Window.partitionBy())
    return g.select("noise", F.round("m", 6).alias("chrfpp"), F.round(clean - F.col("m"), 6).alias("lost"))


def class_gain_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each category of a sentence and each seed: scores of two systems (noise 0.2 and 0.1) on its sentences, errors, the factor of its
    fertility (patches a word of the reports), and whether the bound holds."""
    c = _counts(spark, sf_dir, cells=[(s, p) for s in SEEDS for p in (0.1, 0.2)])
    labels = _targets(spark, sf_dir).where("target is not null").select("pair_id", F.explode(X.categories(F.col("target"))).alias("class"))
    f = table(spark, sf_dir, "failure_sentences_100").select("blt_fertility", F.explode(F.split("categories", "; ")).alias("class"))
    lam = f.groupBy("class").agg(F.avg("blt_fertility").alias("lam"))
    score = c.join(labels, "pair_id").groupBy("class", "seed", "noise").agg(M.chrf_score(M.chrf_sums()).alias("s"))
    two = score.groupBy("class", "seed").agg(F.max(F.when(F.col("noise") == 0.2, F.col("s"))).alias("a"), F.max(F.when(F.col("noise") == 0.1, F.col("s"))).alias("b"))
    ea, eb = F.greatest(F.lit(0.0), 100 - F.col("a")), F.greatest(F.lit(0.0), 100 - F.col("b"))
    factor = F.when(F.col("lam") > 0, F.pow("lam", F.lit(-1.0)))
    out = two.join(lam, "class")
    return out.select("class", "seed", *(F.round(x, 6).alias(n) for x, n in ((F.col("a"), "score_a"), (F.col("b"), "score_b"), (F.col("b") - F.col("a"), "gain"), (factor, "factor"), (F.try_divide(eb, ea), "error_ratio"))), (eb <= factor * ea).alias("satisfied"))


def bound_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many categories there are, and for how many and what share the bound holds."""
    b = class_gain_bound(spark, sf_dir)
    return b.agg(F.count(F.lit(1)).alias("classes"), F.count_if("satisfied").alias("satisfied"), F.round(F.avg(F.col("satisfied").cast("int")), 9).alias("share"))


def pearson_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of words with patches over the previews, of values and of their average ranks; null without variance."""
    f = table(spark, sf_dir, "failure_sentences_100").where("n_words is not null and n_patches is not null").select(F.col("n_words").cast("double").alias("x"), F.col("n_patches").cast("double").alias("y"))
    ranked = O.average_rank(O.average_rank(f, "x", "rx"), "y", "ry")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.round(S.pearson(F.col("x"), F.col("y")), 7).alias("pearson"), F.round(S.pearson(F.col("rx"), F.col("ry")), 7).alias("spearman"))


_CHRF, _BLEU_N = 3 * (M.CHARS + M.WORDS), 2 + 2 * M.GRAMS


def _chrf_of(s: list[Column]) -> Column:
    return M.chrf_score([tuple(s[3 * i : 3 * i + 3]) for i in range(_CHRF // 3)])


def _significance(spark: SparkSession, sf_dir: str, metrics: list[str], kind: str) -> DataFrame:
    """metric, seed, replicates, delta, p_value, significant, note: does the system of noise 0.1 differ from that of 0.2, for each seed?"""
    flat = {
        "chrF++": F.flatten(F.transform("chrf", lambda x: F.array(x["hyp"], x["ref"], x["both"]))),
        "BLEU": F.col("bleu"),
        "TER": F.array("ter", "ref_words"),
    }
    scores = {"chrF++": (_chrf_of, _CHRF), "BLEU": (M.bleu_of, _BLEU_N), "TER": (lambda s: 100 * F.try_divide(s[0], s[1]), 2)}
    needs = {"chrF++": ("chrf",), "BLEU": ("bleu",), "TER": ("ter", "ref_words")}
    what = tuple(w for m in metrics for w in needs[m])
    counts = _counts(spark, sf_dir, what, [(s, p) for s in SEEDS for p in (0.1, 0.2)])
    all_of = F.concat(*(flat[m].cast("array<bigint>") for m in metrics))
    of = lambda s, p: F.max(F.when((F.col("seed") == s) & (F.col("noise") == p), F.struct(all_of.alias("v"))))["v"]
    side = lambda p, name: F.concat(*(of(s, p) for s in SEEDS)).alias(name)
    width = sum(scores[m][1] for m in metrics)
    both = counts.groupBy("pair_id").agg(side(0.1, "x"), side(0.2, "y"))
    sums = written(G.resampled(both, "pair_id", "x", "y", width * len(SEEDS), REPLICATES, kind), "replicates")  # a row for each replicate
    parts, at = [], 0
    for seed in SEEDS:
        for m in metrics:
            score, n = scores[m]
            own = sums.select("rep", *(F.col(f"{x}{at + i}").alias(f"{x}{i}") for x in "ab" for i in range(n)))
            at += n
            r = G.p_values(own, score, n, kind)
            verdict = C.significance(F.col("delta"), F.col("p_value"), F.col("first") == F.col("second"))
            label = X.metric_name(F.lit({"chrF++": "chrF2++"}.get(m, m))).alias("metric")
            parts.append(r.select(label, F.lit(seed).alias("seed"), "replicates", F.round("delta", 6).alias("delta"), F.round("p_value", 9).alias("p_value"), verdict["significant"].alias("significant"), verdict["note"].alias("note")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrF++ and BLEU on resampled segments."""
    return _significance(spark, sf_dir, ["chrF++", "BLEU"], "bootstrap")


def paired_bootstrap_ter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _significance(spark, sf_dir, ["TER"], "bootstrap")


def approximate_randomisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrF++ and BLEU with the outputs of segments exchanged at random."""
    return _significance(spark, sf_dir, ["chrF++", "BLEU"], "randomised")


def approximate_randomisation_ter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _significance(spark, sf_dir, ["TER"], "randomised")


def metric_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scores of every cell of the grid in one pass; COMET needs a neural model and is always missing."""
    return suite(_counts(spark, sf_dir, SUITE), ["seed", "noise"])


SUITE = ("chrf", "bleu", "ref_words", "ter", "meteor")


def suite(counts: DataFrame, by: list[str]) -> DataFrame:
    """The scores of each group of segments, from their counts."""
    return counts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_sentences"), F.round(M.bleu_score(), 6).alias("bleu"), F.round(M.chrf_score(M.chrf_sums()), 6).alias("chrfpp"),
        F.round(100 * F.try_divide(F.sum("ter"), F.sum("ref_words")), 6).alias("ter"), F.round(100 * F.avg("meteor"), 6).alias("meteor"), F.lit(None).cast("double").alias("comet"),
    )


def best_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.best_row(chrfpp_by_noise(spark, sf_dir).where("noise > 0").select("seed", "noise", "chrfpp"), "chrfpp")


def ablation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last and least value and length of each record's entropies, as of a history of losses."""
    r = table(spark, sf_dir, "blt_marathi_patched").select("run_name", "sentence_index", "written_at", "entropy_per_byte")
    return C.history_rollup(r, "entropy_per_byte").drop("entropy_per_byte")


def formatted_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation as text: no deviation for one value, a dash for none."""
    s = seed_summary(spark, sf_dir)
    return s.select("noise", F.when(F.col("n") == 0, "—").when(F.col("n") == 1, F.format_string("%.2f", "mean")).otherwise(F.format_string("%.2f ± %.2f", "mean", "std")).alias("cell"))


def _cells_sql(cells: list[tuple[int, float]], tbl: str = "parallel_examples", key: str = "pair_id", text: str = "target") -> str:
    one = lambda s, p: f"SELECT {key}, {s} AS seed, {p}::DOUBLE AS noise, {text} AS ref, {_noise_sql(p, s, text, key)} AS hyp FROM {tbl} WHERE {text} IS NOT NULL"
    return " UNION ALL ".join(one(s, p) for s, p in cells)


def _w13(t: str) -> str:
    out = t
    for pattern, stand_in in M.SPLITTING:
        out = f"regexp_replace({out}, '{pattern}', '{stand_in.format(chr(92) + '1', chr(92) + '2')}', 'g')"
    return f"list_filter(regexp_split_to_array({out}, '{X.WHITE}+'), lambda w: w <> '')"


def _chrf_words_sql(t: str) -> str:
    p = "[!-/:-@\\[-`{-~]"
    ws = f"list_filter(regexp_split_to_array({t}, '{X.WHITE}+'), lambda w: w <> '')"
    return (
        f"flatten(list_transform({ws}, lambda w: CASE WHEN length(w) > 1 AND regexp_matches(w, '{p}$') THEN [w[:-2], w[-1]] WHEN length(w) > 1 AND regexp_matches(w, '^{p}') THEN [w[1], w[2:]] ELSE [w] END))"
    )


def _overlap_sql(x: str, orders: list[tuple[int, str, int]]) -> str:
    """Tables {x}k: pair_id, seed, noise, o, h, r, m: n-grams of each side and in both, from {x}h (pair_id, seed, noise, lists of units) and
    {x}r (pair_id, the same lists), for each (order's number, list, n)."""
    grams = lambda c, n: f"list_transform(range(len({c}) - {n - 1}), lambda i: hash({c}[i + 1:i + {n}]))"
    hq = " UNION ALL ".join(f"SELECT pair_id, seed, noise, {o} AS o, {grams(c, n)} AS v FROM {x}h" for o, c, n in orders)
    rq = " UNION ALL ".join(f"SELECT pair_id, {o} AS o, {grams(c, n)} AS v FROM {x}r" for o, c, n in orders)
    return (
        f"{x}hq AS MATERIALIZED ({hq}), {x}rq AS MATERIALIZED ({rq})"
        f", {x}hx AS (SELECT pair_id * 10 + o AS ro, seed * 10 + (noise * 10)::INT AS cell, v, count(*) AS n FROM (SELECT pair_id, seed, noise, o, unnest(v) AS v FROM {x}hq) GROUP BY ALL)"
        f", {x}rx AS (SELECT pair_id * 10 + o AS ro, v, count(*) AS n FROM (SELECT pair_id, o, unnest(v) AS v FROM {x}rq) GROUP BY ALL)"
        f", {x}mx AS (SELECT a.ro, a.cell, sum(least(a.n, b.n)) AS m FROM {x}hx a JOIN {x}rx b ON a.ro = b.ro AND a.v = b.v GROUP BY ALL)"
        f", {x}k AS MATERIALIZED (SELECT h.pair_id, h.seed, h.noise, h.o, len(h.v) AS h, len(r.v) AS r, coalesce(m, 0) AS m FROM {x}hq h JOIN {x}rq r ON r.pair_id = h.pair_id AND r.o = h.o"
        f" LEFT JOIN {x}mx ON {x}mx.ro = h.pair_id * 10 + h.o AND {x}mx.cell = h.seed * 10 + (h.noise * 10)::INT)"
    )


def _grams_sql(cells: list[tuple[int, float]]) -> str:
    """Tables g (cells) and k: pair_id, seed, noise, o (order), h, r, m."""
    chars = lambda c: f"regexp_extract_all(regexp_replace({c}, '{X.WHITE}+', '', 'g'), '(?s).')"
    orders = [*((o, "c", o) for o in range(1, 7)), (7, "w", 1), (8, "w", 2)]
    return (
        f"g AS MATERIALIZED ({_cells_sql(cells)}), ch AS MATERIALIZED (SELECT pair_id, seed, noise, {chars('hyp')} AS c, {_chrf_words_sql('hyp')} AS w FROM g)"
        f", cr AS MATERIALIZED (SELECT pair_id, {chars('ref')} AS c, {_chrf_words_sql('ref')} AS w FROM (SELECT DISTINCT pair_id, ref FROM g)), {_overlap_sql('c', orders)}, k AS (SELECT * FROM ck)"
    )


def _chrf_sql(source: str, by: str, out: str) -> str:
    """Adds table `out`: by, s (score) from a table with by, o, h, r, m."""
    return (
        f"{out}_o AS (SELECT {by}, o, sum(h) AS h, sum(r) AS r, sum(m) AS m FROM {source} GROUP BY {by}, o),"
        f" {out}_a AS (SELECT {by}, count(*) FILTER (WHERE h > 0 AND r > 0) AS n, sum(CASE WHEN h > 0 AND r > 0 THEN m / h ELSE 0 END) AS p, sum(CASE WHEN h > 0 AND r > 0 THEN m / r ELSE 0 END) AS q FROM {out}_o GROUP BY {by}),"
        f" {out} AS (SELECT {by}, CASE WHEN n = 0 OR p + q = 0 THEN 0.0 ELSE 100 * 5 * (p / n) * (q / n) / (4 * (p / n) + q / n) END AS s FROM {out}_a)"
    )


_BY = _grams_sql(CELLS) + ", " + _chrf_sql("k", "seed, noise", "cs")
_TWO = _grams_sql([(s, p) for s in SEEDS for p in (0.1, 0.2)])


def _bleu_grams_sql(cells: list[tuple[int, float]]) -> str:
    """Tables bk (pair_id, seed, noise, o, h, r, m) and lb (pair_id, seed, noise, hl, rl)."""
    return (
        f"gb AS MATERIALIZED ({_cells_sql(cells)}), bh AS MATERIALIZED (SELECT pair_id, seed, noise, {_w13('hyp')} AS w FROM gb)"
        f", br AS MATERIALIZED (SELECT pair_id, {_w13('ref')} AS w FROM (SELECT DISTINCT pair_id, ref FROM gb)), {_overlap_sql('b', [(o, 'w', o) for o in range(1, 5)])}"
        ", lb AS (SELECT bh.pair_id, seed, noise, len(bh.w) AS hl, len(br.w) AS rl FROM bh JOIN br ON br.pair_id = bh.pair_id)"
    )


def _bleu_sql(h: list[str], m: list[str], hl: str, rl: str) -> str:
    """The score of sums by order."""
    logs, zeros = [], "0"
    for x, y in zip(h, m):
        zeros = f"({zeros} + CASE WHEN {y} = 0 THEN 1 ELSE 0 END)"
        logs.append(f"CASE WHEN {y} = 0 THEN ln(100 / (pow(2.0, {zeros}) * {x})) ELSE ln(100 * {y} / {x}) END")
    return f"CASE WHEN {m[0]} = 0 OR {h[3]} = 0 THEN 0.0 ELSE CASE WHEN {hl} < {rl} THEN exp(1 - {rl} / {hl}) ELSE 1.0 END * exp(({' + '.join(logs)}) / 4) END"


_BLEU = _bleu_grams_sql(CELLS) + (
    ", wb AS (SELECT seed, noise, " + ", ".join(f"sum({x}) FILTER (WHERE o = {o}) AS {x}{o}" for x in "hm" for o in range(1, 5)) + " FROM bk GROUP BY 1, 2)"
    ", ll AS (SELECT seed, noise, sum(hl) AS hl, sum(rl) AS rl FROM lb GROUP BY 1, 2)"
    f", bl AS (SELECT seed, noise, {_bleu_sql(['h1', 'h2', 'h3', 'h4'], ['m1', 'm2', 'm3', 'm4'], 'hl', 'rl')} AS s FROM wb JOIN ll USING (seed, noise))"
)


def _wide_chrf_sql(x: str) -> str:
    used = [f"({x}h{o} > 0 AND {x}r{o} > 0)" for o in range(1, 9)]
    n, p, r = (
        "(" + " + ".join(c) + ")"
        for c in ([f"{u}::INT" for u in used], [f"CASE WHEN {u} THEN {x}m{o} / {x}h{o} ELSE 0.0 END" for o, u in enumerate(used, 1)], [f"CASE WHEN {u} THEN {x}m{o} / {x}r{o} ELSE 0.0 END" for o, u in enumerate(used, 1)])
    )
    return f"CASE WHEN {n} = 0 OR {p} + {r} = 0 THEN 0.0 ELSE 100 * 5 * ({p} / {n}) * ({r} / {n}) / (4 * ({p} / {n}) + {r} / {n}) END"


def _test_sql(kind: str) -> str:
    """The paired test on sums of counts, a column for each: replicates x pairs x columns."""
    cells = [(s, p) for s in SEEDS for p in (0.1, 0.2)]
    side = {"a": 0.1, "b": 0.2}
    wide_c = ", ".join(f"max({c}) FILTER (WHERE o = {o} AND noise = {p}) AS {x}{c}{o}" for x, p in side.items() for c in "hrm" for o in range(1, 9))
    wide_b = ", ".join(f"max({c}) FILTER (WHERE o = {o} AND noise = {p}) AS {x}n{c}{o}" for x, p in side.items() for c in "hm" for o in range(1, 5))
    wide_l = ", ".join(f"max({c}) FILTER (WHERE noise = {p}) AS {x}{c}" for x, p in side.items() for c in ("hl", "rl"))
    names = [f"{c}{o}" for c in "hrm" for o in range(1, 9)] + [f"n{c}{o}" for c in "hm" for o in range(1, 5)] + ["hl", "rl"]
    draw = _draws_sql("rep", "pair_id", "0") + "[1]"
    if kind == "bootstrap":
        steps, total, part = [], 0.0, 1.0
        for k in range(9):  # the distribution function of a Poisson variable of mean 1
            part = part / k if k else 1.0
            total += part
            steps.append(int(total * exp(-1) * 2147483647))
        weight = "CASE WHEN rep < 0 THEN 1 ELSE " + " + ".join(f"(d >= {t})::INT" for t in steps) + " END"
        sums = ", ".join(f"sum(w * {x}{n}) AS {x}{n}" for x in "ab" for n in names)
        off = "abs(d - mean)"
    else:
        weight = "CASE WHEN rep < 0 THEN 0 ELSE d % 2 END"
        sums = ", ".join(f"sum(CASE WHEN w = 1 THEN {y}{n} ELSE {x}{n} END) AS {x}{n}" for x, y in ("ab", "ba") for n in names)
        off = "abs(d)"
    bleu = lambda x: _bleu_sql([f"{x}nh{o}" for o in range(1, 5)], [f"{x}nm{o}" for o in range(1, 5)], f"{x}hl", f"{x}rl")
    return (
        f"WITH {_grams_sql(cells)}, {_bleu_grams_sql(cells)}, wc AS (SELECT pair_id, seed, {wide_c} FROM k GROUP BY 1, 2), wn AS (SELECT pair_id, seed, {wide_b} FROM bk GROUP BY 1, 2), wl AS (SELECT pair_id, seed, {wide_l} FROM lb GROUP BY 1, 2)"
        f", ww AS (SELECT * FROM wc JOIN wn USING (pair_id, seed) JOIN wl USING (pair_id, seed)), ids AS (SELECT DISTINCT pair_id FROM ww)"
        f", dr AS (SELECT rep, pair_id, {weight} AS w FROM (SELECT rep, pair_id, {draw} AS d FROM ids CROSS JOIN (SELECT unnest(range(-1, {REPLICATES})) AS rep)))"
        f", su AS (SELECT rep, seed, {sums} FROM dr JOIN ww USING (pair_id) GROUP BY 1, 2)"
        f", sc AS (SELECT rep, seed, 'chrF++' AS metric, {_wide_chrf_sql('a')} AS a, {_wide_chrf_sql('b')} AS b FROM su UNION ALL SELECT rep, seed, 'BLEU', {bleu('a')}, {bleu('b')} FROM su)"
        ", de AS (SELECT *, a - b AS d FROM sc), re AS (SELECT *, max(CASE WHEN rep = -1 THEN d END) OVER w AS real, avg(CASE WHEN rep >= 0 THEN d END) OVER w AS mean FROM de WINDOW w AS (PARTITION BY seed, metric))"
        f", pv AS (SELECT metric, seed, count(*) FILTER (WHERE rep >= 0) AS replicates, any_value(real) AS delta, (count(*) FILTER (WHERE rep >= 0 AND {off} > abs(real)) + 1) / (count(*) FILTER (WHERE rep >= 0) + 1) AS p, bool_or(rep = -1 AND a = b) AS same FROM re GROUP BY 1, 2)"
        " SELECT metric, seed, replicates, round(delta, 6) AS delta, round(p, 9) AS p_value, abs(delta) >= 1e-6 AND p < 0.05 AS significant, CASE WHEN same THEN 'identical output to the baseline' WHEN abs(delta) < 1e-6 THEN 'no measurable difference; p-value not meaningful' ELSE '' END AS note FROM pv"
    )


_TC = "CASE WHEN n < 2 THEN 0.0 ELSE " + "CASE n - 1 WHEN 1 THEN 12.706 WHEN 2 THEN 4.303 END * std / sqrt(n) END"
_SUM = f"{_BY}, ss AS (SELECT noise, count(*) AS n, avg(round(s, 7)) AS mean, coalesce(stddev_samp(round(s, 7)), 0) AS std FROM cs GROUP BY 1)"

SQL = {
    "chrfpp_by_noise": f"WITH {_BY} SELECT seed, noise, round(s, 7) AS chrfpp, (SELECT count(DISTINCT pair_id) FROM g) AS segments FROM cs",
    "bleu_by_noise": f"WITH {_BLEU} SELECT seed, noise, round(s, 7) AS bleu FROM bl",
    "length_delta": f"WITH g AS ({_cells_sql(CELLS, 'documents', 'doc_id', 'text')}) SELECT seed, noise, (length(hyp) - length(ref))::INT AS delta, count(*) AS n FROM g GROUP BY 1, 2, 3",
    "identical_outputs": f"WITH g AS ({_cells_sql(CELLS)}) SELECT seed, noise, bool_and(hyp = ref) AS identical FROM g GROUP BY 1, 2",
    "seed_summary": f"WITH {_SUM} SELECT noise, n, round(mean, 6) AS mean, round(std, 6) AS std, round(mean - {_TC}, 6) AS low, round(mean + {_TC}, 6) AS high FROM ss",
    "formatted_cells": f"WITH {_SUM} SELECT noise, printf('%.2f ± %.2f', round(mean, 6), round(std, 6)) AS cell FROM ss",
    "metric_pivot": f"WITH {_BY}, {_BLEU}, mr AS (SELECT CASE seed WHEN 42 THEN 'blt_lcm' WHEN 43 THEN 'bpe_lcm' ELSE 'base_lcm' END AS model, noise, bl.s + CASE WHEN seed = 42 AND noise = 0.1 THEN 1 ELSE 0 END AS bleu, cs.s + CASE WHEN seed = 42 AND noise = 0.1 THEN 1 ELSE 0 END AS chrf FROM cs JOIN bl USING (seed, noise) WHERE NOT (seed = 44 AND noise = 0.2)) SELECT noise, string_agg(model, ';' ORDER BY model) AS models_present, " + ", ".join(f"round(max({c}) FILTER (WHERE model = '{m}'), 6) AS {m}_{n}" for m in ("base_lcm", "blt_lcm", "bpe_lcm") for c, n in (("bleu", "bleu"), ("chrf", "chrfpp"))) + " FROM mr GROUP BY 1",
    "metric_curve": f"WITH {_BY}, {_BLEU}, mr AS (SELECT CASE seed WHEN 42 THEN 'blt_lcm' WHEN 43 THEN 'bpe_lcm' ELSE 'base_lcm' END AS model, noise, bl.s + CASE WHEN seed = 42 AND noise = 0.1 THEN 1 ELSE 0 END AS bleu, cs.s + CASE WHEN seed = 42 AND noise = 0.1 THEN 1 ELSE 0 END AS chrf FROM cs JOIN bl USING (seed, noise) WHERE NOT (seed = 44 AND noise = 0.2)) SELECT CASE model WHEN 'bpe_lcm' THEN 1 ELSE 2 END::INT AS place, model, noise, round(chrf, 6) AS value FROM mr WHERE model IN ('bpe_lcm', 'blt_lcm')",
    "missing_cells": "WITH want AS (SELECT seed, noise FROM (SELECT unnest([42, 43, 44]) AS seed) CROSS JOIN (SELECT unnest([0.0, 0.1, 0.2])::DOUBLE AS noise)), have AS (SELECT w.* FROM want w WHERE EXISTS (SELECT 1 FROM parallel_examples WHERE target IS NOT NULL) AND NOT (seed = 44 AND noise = 0.2)) SELECT printf('seed_%d@%.1f', seed, noise) AS cell FROM want ANTI JOIN have USING (seed, noise)",
    "noise_curve": f"WITH {_BY}, m AS (SELECT noise, avg(round(s, 7)) AS m FROM cs GROUP BY 1) SELECT noise, round(m, 6) AS chrfpp, round(max(CASE WHEN noise = 0 THEN m END) OVER () - m, 6) AS lost FROM m",
    "class_gain_bound": f"WITH {_TWO}, lab AS (SELECT pair_id, unnest({_labels_sql('target')}) AS class FROM parallel_examples WHERE target IS NOT NULL), f AS (SELECT blt_fertility, unnest(string_split(categories, '; ')) AS class FROM failure_sentences_100), lam AS (SELECT class, avg(blt_fertility) AS lam FROM f GROUP BY 1), kc AS (SELECT k.*, class FROM k JOIN lab USING (pair_id)), {_chrf_sql('kc', 'class, seed, noise', 'cc')}, two AS (SELECT class, seed, max(CASE WHEN noise = 0.2 THEN s END) AS a, max(CASE WHEN noise = 0.1 THEN s END) AS b FROM cc GROUP BY 1, 2)"
    " SELECT class, seed, round(a, 6) AS score_a, round(b, 6) AS score_b, round(b - a, 6) AS gain, round(CASE WHEN lam > 0 THEN pow(lam, -1.0) END, 6) AS factor, round(greatest(0.0, 100 - b) / nullif(greatest(0.0, 100 - a), 0), 6) AS error_ratio, greatest(0.0, 100 - b) <= CASE WHEN lam > 0 THEN pow(lam, -1.0) END * greatest(0.0, 100 - a) AS satisfied FROM two JOIN lam USING (class)",
    "best_cell": f"WITH {_BY} SELECT seed, noise, round(s, 7) AS chrfpp FROM cs WHERE noise > 0 ORDER BY round(s, 7) DESC, seed, noise LIMIT 1",
    "ablation_rollup": "SELECT run_name, sentence_index, written_at, entropy_per_byte[-1] AS final_loss, list_min(entropy_per_byte) AS best_loss, len(entropy_per_byte)::INT AS epochs FROM blt_marathi_patched",
    "approximate_randomisation": _test_sql("randomised"),
    "pearson_spearman": "WITH f AS (SELECT n_words::DOUBLE AS x, n_patches::DOUBLE AS y FROM failure_sentences_100 WHERE n_words IS NOT NULL AND n_patches IS NOT NULL), r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM f) SELECT count(*) AS n, round(corr(x, y), 7) AS pearson, round(corr(rx, ry), 7) AS spearman FROM r",
    "paired_bootstrap": _test_sql("bootstrap"),
}

SQL["bound_summary"] = f"SELECT count(*) AS classes, count(*) FILTER (WHERE satisfied) AS satisfied, round(avg(satisfied::INT), 9) AS share FROM ({SQL['class_gain_bound']})"

QUERIES = {
    f.__name__: f
    for f in (
        chrfpp_by_noise, bleu_by_noise, edit_metrics_by_noise, length_delta, identical_outputs, seed_summary, formatted_cells, metric_pivot, metric_curve, missing_cells, noise_curve, class_gain_bound, bound_summary,
        pearson_spearman, paired_bootstrap, paired_bootstrap_ter, approximate_randomisation, approximate_randomisation_ter, metric_suite, best_cell, ablation_rollup,
    )
}
