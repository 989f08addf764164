"""The queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread
from . import copies, forms, language, leak, mix, near, pii, ranks, tokens
from .workspace import written


_CORPORA = ("parallel_examples", "failure_sentences_100", "documents", "blt_marathi_patched")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in _CORPORA else df


def _texts(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, str, str, str, str]]:
    """(table, its name, id, text, label) of the texts whose language is wanted."""
    return [
        (_table(spark, sf_dir, "parallel_examples"), "parallel_examples", "pair_id", "target", "target_lang"),
        (_table(spark, sf_dir, "failure_sentences_100"), "failure_sentences_100", "failure_id", "text_preview", "preview_lang"),
    ]


def _fitted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, language.Filter]:
    panel = _table(spark, sf_dir, "language_panel")
    return panel, language.fitted(_table(spark, sf_dir, "language_samples"), panel)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of records with a missing or wrong label or with several languages."""
    panel, fit = _fitted(spark, sf_dir)
    a, b = (language.cases(df, tbl, record, text, label, panel, fit) for df, tbl, record, text, label in _texts(spark, sf_dir))
    return a.unionByName(b)


def p1_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of every text with its language and confidence."""
    _, fit = _fitted(spark, sf_dir)
    parts = [
        language.stretches(df, record, text, fit)
        .select(F.lit(tbl).alias("tbl"), "rec_id", F.posexplode("stretches").alias("stretch", "x"))
        .select("tbl", "rec_id", "stretch", "x.first_word", "x.n_words", "x.lang", F.round("x.confidence", 6).alias("confidence"))
        for df, tbl, record, text, _ in _texts(spark, sf_dir)
    ]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field values that differ from their consistent form."""
    pairs, previews = _table(spark, sf_dir, "parallel_examples"), _table(spark, sf_dir, "failure_sentences_100")
    parts = [
        (pairs, "parallel_examples", "pair_id", ["source", "target"]),
        (previews, "failure_sentences_100", "failure_id", ["text_preview"]),
    ]
    return forms.found([forms.changed(df, tbl, record, fields) for df, tbl, record, fields in parts])


def p2_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source, target and preview in the consistent form; null stays null."""
    pairs, previews = _table(spark, sf_dir, "parallel_examples"), _table(spark, sf_dir, "failure_sentences_100")
    return forms.rewritten(pairs, "parallel_examples", "pair_id", ["source", "target"]).unionByName(forms.rewritten(previews, "failure_sentences_100", "failure_id", ["text_preview"]))


def _leak_parts(spark: SparkSession, sf_dir: str) -> tuple:
    pairs, items = _table(spark, sf_dir, "parallel_examples"), _table(spark, sf_dir, "eval_nway")
    return pairs, "pair_id", ["source", "target"], items, "item_id", ["eng_latn", "mar_deva", "hin_deva"]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and the test items that leaked into them."""
    return leak.leaks(*_leak_parts(spark, sf_dir)).select(F.col("record").alias("pair_id"), "item_id").distinct()


def p3_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaked stretch: where it is, how long, and how much of its field it covers."""
    spans = leak.leaks(*_leak_parts(spark, sf_dir))
    return spans.select(F.col("record").alias("pair_id"), "field", "first_word", "n_words", F.round(F.col("n_words") / F.col("words"), 6).alias("coverage"), "item_id")


def p3_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs without what leaked into them."""
    return leak.cleaned(*_leak_parts(spark, sf_dir)).withColumnRenamed("record", "pair_id")


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(copies.keyed(_table(spark, sf_dir, "parallel_examples")), "copy-keys")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copies(_keys(spark, sf_dir))


def p5_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.collapsed(copies.keyed(_table(spark, sf_dir, "parallel_examples")))


def p5_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of 128 bits that different canonical forms share: no rows, but for a collision."""
    return copies.collisions(copies.keyed(_table(spark, sf_dir, "parallel_examples"))).select(F.hex("key").alias("key"), "forms")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.id_pairs(near.links(near.prepared(_table(spark, sf_dir, "parallel_examples"))))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair with its group of copies and near-duplicates."""
    sets = near.prepared(_table(spark, sf_dir, "parallel_examples"))
    return near.groups(sets, near.links(sets))


_MEASURES = (["num_bytes", "num_patches", "avg_patch_length"], ["patch_lengths"])


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of every run and of every run's days, off by no more than ranks.EPSILON of the values; the days' summaries combine to
    those of the run."""
    days = ranks.summarised(_table(spark, sf_dir, "blt_marathi_patched"), ["run_name", "shard_day"], *_MEASURES)
    runs = ranks.merged(days, ["run_name"])
    by_day = ranks.percentiles(days, ["run_name", "shard_day"])
    by_run = ranks.percentiles(runs, ["run_name"]).withColumn("shard_day", F.lit(None).cast("date"))
    return by_day.unionByName(by_run)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return tokens.encoded(_table(spark, sf_dir, "documents"))


def p7_ids_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document by the byte-level vocabulary of many languages."""
    return tokens.encoded(_table(spark, sf_dir, "documents"), vocabulary=tokens.VOCABULARY_OF_MANY_LANGUAGES)


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sized = written(tokens.sized(_table(spark, sf_dir, "documents"), ["doc_id", "source"]), "token-sizes")
    docs = sized.withColumn("members", F.array("source"))
    return mix.mixed(docs, _table(spark, sf_dir, "mix_targets"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of every mix, with how often each is taken."""
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that every mix reaches."""
    return _mixed(spark, sf_dir)[1]


def p8_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that every mix reaches if each distinct text counts once and belongs to all sources it occurs in."""
    sized = written(tokens.sized(_table(spark, sf_dir, "documents").withColumn("key", F.md5("text")), ["doc_id", "source", "key"]), "token-sizes")
    once = sized.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.collect_set("source").alias("members"), F.max("tokens").alias("tokens"))
    return mix.mixed(once, _table(spark, sf_dir, "mix_targets"))[1]


def _names(spark: SparkSession, sf_dir: str) -> pii.Names:
    people = _table(spark, sf_dir, "contributors")
    return pii.listed(people, ["given_name", "given_name_deva"], ["family_name", "family_name_deva"])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal information in every document."""
    return pii.found(_table(spark, sf_dir, "documents"), _names(spark, sf_dir))


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal information replaced."""
    return pii.replaced(_table(spark, sf_dir, "documents"), _names(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_found, p1_stretches, p2_found, p2_consistent, p3_found, p3_spans, p3_cleaned, p4_found, p4_groups, p5_found, p5_collapsed, p5_collisions)
    own += (p6_percentiles, p7_ids, p7_ids_multi, p8_mix, p8_shares, p8_overlap, p9_found, p9_redacted)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {}
