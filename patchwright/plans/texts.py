"""Sentences, splits, categories, fertility and regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import entropy as E
from ..operators import noise as N
from ..operators import order as O
from ..sources.shared import written
from ..sources.tables import spread, table

#: What the stand-ins for an analyzer and a tagger know: suffixes that come off, postpositions, verb endings, other function words.
SUFFIXES = ["च्या", "साठी", "बद्दल", "पासून", "पर्यंत", "खाली", "मागे", "जवळ", "समोर", "मुळे", "ला", "ने", "ची", "चे", "चा", "वर", "कडे", "शी", "तून", "त"]
POSTPOSITIONS = ["येथील", "तिथे", "इथे", "यांच्यामुळे", "यांनी"]
VERBS = ["ले", "आहे", "आहेत", "होते", "होता", "नाही", "वाटते"]
FUNCTION_WORDS = ["आणि", "व", "पण", "किंवा", "की", "हा", "ही", "हे", "तो", "ती", "ते", "मी", "आम्ही", "तुम्ही", "जर", "तर", "म्हणून", "खूप"]
CLASSES = ["compound", "noun_root", "verb_inflection", "postposition", "other"]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_docs(spark, sf_dir)).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))


def sentence_split_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sentences each of the three splitters finds."""
    n = lambda end, flat: F.size(X.sentences(F.col("text"), end, flat))
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", n(X.SENTENCE_END, True).alias("full"), n(r"[.\x{0964}]", False).alias("dots_dandas"), n(r"\.", False).alias("dots"))


def long_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of more than five characters, in id order, the first 500."""
    return _docs(spark, sf_dir).where(X.long_enough(F.col("text"))).orderBy("doc_id").limit(500).select("doc_id", X.preview(F.col("text"), 80).alias("preview"))


def pair_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with two sides that differ, each of more than two characters, by corpus."""
    pairs = table(spark, sf_dir, "parallel_examples")
    filled = lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    both = filled("source") & filled("target")
    keep = both & (F.trim("source") != F.trim("target")) & (F.length(F.trim("source")) > 2) & (F.length(F.trim("target")) > 2)
    return pairs.groupBy("corpus_key").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(both).alias("filled"), F.count_if(keep).alias("kept"))


def doc_regroup_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of all sentences in document order cut into groups of 20; a tail of one sentence is left out."""
    return regrouped(spread(_docs(spark, sf_dir)), 20).where("sentences >= 2")


def doc_regroup_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every tail kept, and no more than the first 500 groups."""
    return regrouped(spread(_docs(spark, sf_dir)), 20).where("grp < 500")


def regrouped(docs: DataFrame, size: int) -> DataFrame:
    """grp, sentences, documents, first_doc: the sentences of all documents by id, in groups of `size`.

    Positions come from running totals of sentences by document; a document adds its part to each group it reaches."""
    s = docs.withColumn("x", X.sentences(F.col("text"))).where("size(x) > 0").select("doc_id", F.size("x").alias("n"))
    placed = O.positions(written(s, "sentence-counts"), "doc_id", weight=F.col("n").cast("bigint"), out="first")
    groups = placed.select("doc_id", "first", "n", F.explode(F.sequence(F.floor(F.col("first") / size), F.floor((F.col("first") + F.col("n") - 1) / size))).alias("grp"))
    part = F.least(F.col("first") + F.col("n"), (F.col("grp") + 1) * size) - F.greatest(F.col("first"), F.col("grp") * size)
    return groups.groupBy("grp").agg(F.sum(part).alias("sentences"), F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc"))


def hash_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, exactly, by a seeded hash; the rank is found by buckets, then within the one that is cut."""
    return _fraction(_docs(spark, sf_dir).select("doc_id"), "doc_id", 0.25, 42)


def _fraction(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    h = df.withColumn("h", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))).withColumn("bucket", F.substring("h", 1, 3))
    sizes = h.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))  # 4096 rows at most
    upto = F.sum("n").over(Window.orderBy("bucket"))
    cuts = sizes.select("bucket", (upto - F.col("n")).alias("before"), upto.alias("upto"), F.floor(F.sum("n").over(Window.partitionBy()) * share).alias("wanted"))
    placed = h.join(F.broadcast(cuts.where("before < wanted")), "bucket")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("bucket").orderBy("h", key))
    cut = placed.where("upto > wanted").withColumn("rank", rank).where("rank <= wanted")  # only the bucket that is cut is sorted
    return placed.where("upto <= wanted").select(key).unionByName(cut.select(key))


def tail_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fifty documents by id are for evaluation."""
    return tail(_docs(spark, sf_dir), "doc_id", 50).select("doc_id")


def tail(df: DataFrame, key: str, k: int) -> DataFrame:
    """The last k rows by key; raises if that leaves none."""
    if df.limit(k + 1).count() <= k:
        raise ValueError(f"no more than {k} rows: nothing is left to train on")
    return df.orderBy(F.desc(key)).limit(k)


def positional_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each language are in the first 80 % by id, how many in the rest; the cut is found on ids alone."""
    d = _docs(spark, sf_dir).select("doc_id", "lang")
    cut = (d.count() * 8) // 10
    placed = O.positions(d, "doc_id").withColumn("train", F.col("position") < cut)
    return placed.groupBy("lang").agg(F.count_if("train").alias("train"), F.count_if(~F.col("train")).alias("test"))


def leakage_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs one of whose sides, trimmed, is a test text as a whole, and those items."""
    items = table(spark, sf_dir, "eval_nway").select("item_id", F.explode(F.array("eng_latn", "mar_deva", "hin_deva")).alias("text")).where("text is not null").select("item_id", F.trim("text").alias("text"))
    pairs = table(spark, sf_dir, "parallel_examples").select("pair_id", F.explode(F.array("source", "target")).alias("side")).select("pair_id", F.trim("side").alias("text"))
    return pairs.join(items, "text").select("pair_id", "item_id").distinct()


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "failure_sentences_100")


def text_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(_docs(spark, sf_dir)).where("text is not null")
    return d.select("doc_id", F.array_join(X.categories(F.col("text")), "; ").alias("labels"), X.script_count(F.col("text")).alias("devanagari"))


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of each category and their median delta."""
    f = _failures(spark, sf_dir).select("delta", F.explode(F.split("categories", "; ")).alias("category"))
    counts = f.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    medians = O.quantiles(f, ["category"], "delta", [0.5]).select("category", F.round(F.get("q", F.lit(0)), 8).alias("median_delta"))
    return counts.join(medians, "category", "left")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.least("fert_augmented", "fert_retrained")
    both = F.col("fert_augmented").isNotNull() & F.col("fert_retrained").isNotNull()
    return _failures(spark, sf_dir).withColumn("best", F.when(both, best)).withColumn("gain", F.round(F.col("blt_fertility") - F.col("best"), 9))


def top_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred largest losses against the better tokenizer, each text once."""
    w = Window.partitionBy(X.stripped(F.col("text_preview"))).orderBy(F.desc("gain"), "failure_id")
    first = _scored(spark, sf_dir).where("gain > 0 and text_preview is not null").withColumn("copy", F.row_number().over(w)).where("copy = 1")
    top = first.orderBy(F.desc("gain"), "failure_id").limit(100)
    source = F.when(F.col("fert_augmented") <= F.col("fert_retrained"), "augmented").otherwise("retrained")
    return top.select(F.row_number().over(Window.orderBy(F.desc("gain"), "failure_id")).alias("rank"), "failure_id", "gain", source.alias("source"), X.preview(F.col("text_preview"), 100).alias("preview"))


def win_tie_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each of three systems is strictly lowest, and ties; how often each of two is."""
    a, r, b = F.col("fert_augmented"), F.col("fert_retrained"), F.col("blt_fertility")
    s = _failures(spark, sf_dir).where("fert_augmented is not null and fert_retrained is not null and blt_fertility is not null")
    wins = s.agg(
        F.count(F.lit(1)).alias("n"), F.count_if((a < r) & (a < b)).alias("augmented"), F.count_if((r < a) & (r < b)).alias("retrained"), F.count_if((b < a) & (b < r)).alias("blt"),
        F.count_if(b < r).alias("blt_beats_retrained"), F.count_if(b > r).alias("retrained_beats_blt"),
    )
    return wins.withColumn("ties", F.col("n") - F.col("augmented") - F.col("retrained") - F.col("blt"))


def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_words")
    bucket = F.when(n < 5, "1-4").when(n < 10, "5-9").when(n < 20, "10-19").when(n < 40, "20-39").otherwise("40+")
    return _failures(spark, sf_dir).where("n_words > 0").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("blt_fertility"), 8).alias("mean"), F.round(F.avg((F.col("blt_fertility") <= 2).cast("int")), 8).alias("low_share"))


def fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches and stand-in tokens for each word of a preview; infinite without words."""
    w = X.words(F.col("text_preview"))
    tokens = F.aggregate(F.transform(w, lambda x: F.ceil(F.length(x) / 4)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    per = lambda x: F.when(F.size(w) > 0, x / F.size(w)).otherwise(F.lit(float("inf")))
    return _failures(spark, sf_dir).where("text_preview is not null").select("failure_id", F.size(w).alias("words"), tokens.alias("tokens"), per(tokens).alias("token_fertility"), per(F.col("n_patches")).alias("patch_fertility"))


def morphemes(word: Column) -> Column:
    """1, or 2 if the word is longer than a suffix it ends with by more than a character: a stand-in for an analyzer."""
    hit = F.lit(False)
    for s in SUFFIXES:
        hit = hit | (F.endswith(word, F.lit(s)) & (F.length(word) > len(s) + 1))
    return F.when(hit, 2).otherwise(1)


def word_class(upos: Column, word: Column, n: Column) -> Column:
    """The class of a word by its part of speech, its letters and its number of morphemes; the first that holds."""
    noun, several = upos.isin("NOUN", "PROPN"), n >= 2
    joined = F.contains(word, F.lit("्")) & (F.length(word) >= 6)
    return (
        F.when(several & (F.coalesce(noun, F.lit(False)) | joined), "compound").when(noun, "noun_root").when(upos.isin("VERB", "AUX"), "verb_inflection").when(upos == "ADP", "postposition").otherwise("other")
    )


def part_of_speech(word: Column) -> Column:
    """A stand-in for a tagger, whose tags any other column may replace."""
    verb = F.lit(False)
    for v in VERBS:
        verb = verb | F.endswith(word, F.lit(v))
    return F.when(word.isin(POSTPOSITIONS), "ADP").when(verb, "VERB").when(word.isin(FUNCTION_WORDS), "PRON").otherwise("NOUN")


def _class_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, word, n, upos, class of words in Devanagari, punctuation off."""
    d = spread(_docs(spark, sf_dir)).where("lang = 'mar_Deva'").select("doc_id", F.posexplode(X.words(F.col("text"))).alias("pos", "raw"))
    w = d.select("doc_id", "pos", F.regexp_replace("raw", r"[^\x{0900}-\x{0963}\x{0966}-\x{097F}]", "").alias("word")).where("word <> ''")
    tagged = w.withColumn("n", morphemes(F.col("word"))).withColumn("upos", part_of_speech(F.col("word")))
    return tagged.withColumn("class", word_class(F.col("upos"), F.col("word"), F.col("n")))


def class_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, morphemes, mean, population deviation, least and most of every class; zeros for one without words."""
    stats = _class_words(spark, sf_dir).groupBy("class").agg(
        F.count(F.lit(1)).alias("words"), F.sum("n").alias("morphemes"), F.round(F.avg("n"), 8).alias("mean"), F.round(F.stddev_pop("n"), 8).alias("std"), F.min("n").alias("least"), F.max("n").alias("most")
    )
    every = spark.createDataFrame([(c,) for c in CLASSES], "class string")
    return every.join(stats, "class", "left").na.fill(0)


def global_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _class_words(spark, sf_dir).agg(F.count(F.lit(1)).alias("words"), F.round(F.coalesce(F.sum("n"), F.lit(0)) / F.greatest(F.lit(1), F.count(F.lit(1))), 8).alias("fertility"))


def class_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five words of every class in reading order; the rank is cut before the shuffle."""
    w = Window.partitionBy("class").orderBy("doc_id", "pos")
    return _class_words(spark, sf_dir).withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("class", "rank", "word")


def capped_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by their number of morphemes, those of 6 and more together, in per cent of their class."""
    h = _class_words(spark, sf_dir).groupBy("class", F.least("n", F.lit(6)).alias("morphemes")).agg(F.count(F.lit(1)).alias("words"))
    return h.withColumn("percent", F.round(100 * F.col("words") / F.sum("words").over(Window.partitionBy("class")), 8))


def patch_vs_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches against stand-in tokens (pieces of up to four characters), summed by run."""
    r = table(spark, sf_dir, "blt_marathi_patched")
    tokens = F.aggregate(F.transform(X.words(F.col("marathi_text")), lambda x: F.ceil(F.length(x) / 4)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    t = r.select("run_name", "num_patches", tokens.alias("tokens")).where("num_patches is not null")
    saved = F.when(F.col("tokens") == 0, 0.0).otherwise(100 * (1 - F.col("num_patches") / F.col("tokens")))
    return t.groupBy("run_name").agg(F.sum("tokens").alias("tokens"), F.sum(F.col("num_patches") - F.col("tokens")).alias("delta"), F.round(F.avg(F.try_divide("num_patches", "tokens")), 8).alias("ratio"), F.round(F.avg(saved), 8).alias("savings"))


def class_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences, bytes and patches by category of the text (a sentence counts for each of its own), and over all sentences once."""
    r = table(spark, sf_dir, "blt_marathi_patched").where("num_patches is not null and num_bytes is not null").select("num_bytes", "num_patches", X.categories(F.col("marathi_text")).alias("labels"))
    both = r.select("num_bytes", "num_patches", F.explode(F.concat("labels", F.array(F.lit("overall")))).alias("class"))
    return both.groupBy("class").agg(F.count(F.lit(1)).alias("sentences"), F.sum("num_bytes").alias("bytes"), F.sum("num_patches").alias("patches"), F.round(F.try_divide(F.sum("num_bytes"), F.sum("num_patches")), 8).alias("ratio"))


def class_words_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document its words by class, as JSON with sorted keys."""
    c = _class_words(spark, sf_dir).groupBy("doc_id", "class").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("class", "n")))  # five classes at most
    return c.groupBy("doc_id").agg(F.to_json(F.map_from_entries(pairs)).alias("classes"))


def char_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with no, a tenth and a fifth of its characters struck."""
    return N.characters(spread(_docs(spark, sf_dir)), "doc_id", "text", {"noise_0": 0.0, "noise_10": 0.1, "noise_20": 0.2}, 42)


def token_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte ids of the documents with a tenth replaced by the unknown id 3: how many there are, how many were replaced, their sum."""
    ids = N.byte_ids(spread(_docs(spark, sf_dir)).where("text is not null"), "doc_id", "text", 0.1, 7)
    return ids.select("doc_id", F.size("ids").alias("n"), F.size(F.filter("ids", lambda t: t == 3)).alias("replaced"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, t: a + t).alias("total"))


def sentence_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeds of a sentence's noise by the three rules: of its document and place, of its place, of a string."""
    s = spread(_docs(spark, sf_dir)).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))
    return s.select("doc_id", "pos", X.sentence_seed(F.col("doc_id"), F.col("pos")).alias("by_document"), F.col("pos").cast("bigint").alias("by_place"), X.string_seed("noise", F.lit(42), F.lit("0.1"), F.col("pos")).alias("by_string"))


def byte_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the characters of every document begin in its bytes: how many, the last, and their sum."""
    o = E.character_offsets(spread(_docs(spark, sf_dir)).where("text <> ''"), "doc_id", "text")
    return o.select("doc_id", F.size("offsets").alias("n"), F.element_at("offsets", -1).alias("last"), F.aggregate("offsets", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


def redact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials masked in documents with five planted lines, and how many; the hash stands for the text."""
    planted = F.concat(F.col("text"), F.lit("\napi_key = abcdef123456\nhttps://me:secret@host/x\nghp_0123456789abcdefXYZ\nrun 0123456789ABCDEF0123456789abcdef01234567 of wandb\nsha 0123456789abcdef0123456789abcdef01234567 of git"))
    d = _docs(spark, sf_dir).where("text is not null").withColumn("t", planted)
    return d.select("doc_id", X.secrets(F.col("t")).alias("hits"), F.md5(X.redacted(F.col("t"))).alias("digest"))


def tail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.md5(X.last_lines(F.col("text"), 3)).alias("digest"))


def language_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of pairs resolved by the panel's aliases; a label with an underscore stands for itself, unknown ones give null."""
    panel = table(spark, sf_dir, "language_panel")
    names = panel.select("lang_code", "display_name", F.explode(F.concat(F.array("lang_code"), "aliases")).alias("name")).select("lang_code", "display_name", F.lower("name").alias("name"))
    pairs = table(spark, sf_dir, "parallel_examples").select(F.lower(F.trim("target_lang")).alias("name"))
    counts = pairs.groupBy("name").agg(F.count(F.lit(1)).alias("n"))  # labels are few; the join comes after the count
    return counts.join(names, "name", "left").select("name", "lang_code", "display_name", F.split_part("lang_code", F.lit("_"), F.lit(2)).alias("script"), "n")


_W = X.WHITE


def _strip_sql(col: str) -> str:
    return f"regexp_replace({col}, '^{_W}+|{_W}+$', '', 'g')"


_U = "[\\x{0900}-\\x{097F}]"
_RARE = X.RARE


def _kw(words: list[str], col: str) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({col}, '{w}') THEN 1 ELSE 0 END" for w in words) + ")"


def _words_sql(col: str) -> str:
    return f"list_filter(regexp_split_to_array({col}, '{_W}+'), lambda w: w <> '')"


def _labels_sql(col: str) -> str:
    legal, medical = _kw(X.LEGAL, col), _kw(X.MEDICAL, col)
    parts = [
        f"CASE WHEN regexp_matches({col}, '{_U}{{15,}}') THEN '{X.LABELS['compound']}' END",
        f"CASE WHEN regexp_matches({col}, '{_U}') AND regexp_matches({col}, '[A-Za-z]{{2,}}') THEN '{X.LABELS['mixed']}' END",
        f"CASE WHEN len(regexp_extract_all({col}, '{_RARE}')) >= 2 THEN '{X.LABELS['rare']}' END",
        f"CASE WHEN len({_words_sql(col)}) < 5 THEN '{X.LABELS['short']}' END",
        f"CASE WHEN {legal} >= 2 OR {medical} >= 2 THEN CASE WHEN {legal} >= {medical} THEN '{X.LABELS['legal']}' ELSE '{X.LABELS['medical']}' END END",
    ]
    found = f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"
    return f"CASE WHEN {col} IS NULL THEN NULL WHEN len({found}) > 0 THEN {found} ELSE ['Other'] END"


_TOKENS = "coalesce(list_sum(list_transform({w}, lambda x: ceil(length(x) / 4))), 0)::BIGINT"


def _sentences_sql(text: str, end: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({text}, '{end}'), lambda s: {_strip_sql('s')}), lambda s: s <> '')"


_SFULL = _sentences_sql("translate(text, chr(10), ' ')", X.SENTENCE_END)
_MORPH = "CASE WHEN " + " OR ".join(f"(ends_with(word, '{s}') AND length(word) > {len(s) + 1})" for s in SUFFIXES) + " THEN 2 ELSE 1 END"
_UPOS = (
    "CASE WHEN word IN ('येथील', 'तिथे', 'इथे', 'यांच्यामुळे', 'यांनी') THEN 'ADP' WHEN " + " OR ".join(f"ends_with(word, '{v}')" for v in VERBS)
    + " THEN 'VERB' WHEN word IN (" + ", ".join(f"'{w}'" for w in FUNCTION_WORDS) + ") THEN 'PRON' ELSE 'NOUN' END"
)
_CLASS = (
    "CASE WHEN upos IN ('NOUN', 'PROPN') AND n >= 2 THEN 'compound' WHEN n >= 2 AND contains(word, '्') AND length(word) >= 6 THEN 'compound' WHEN upos IN ('NOUN', 'PROPN') THEN 'noun_root'"
    " WHEN upos IN ('VERB', 'AUX') THEN 'verb_inflection' WHEN upos = 'ADP' THEN 'postposition' ELSE 'other' END"
)
_CW = (
    f"a AS (SELECT doc_id, {_words_sql('text')} AS w FROM documents WHERE lang = 'mar_Deva' AND text IS NOT NULL), b AS (SELECT doc_id, unnest(w) AS raw, unnest(range(len(w))) AS pos FROM a),"
    " c AS (SELECT doc_id, pos, regexp_replace(raw, '[^\\x{0900}-\\x{0963}\\x{0966}-\\x{097F}]', '', 'g') AS word FROM b),"
    f" m AS (SELECT *, {_MORPH} AS n, {_UPOS} AS upos FROM c WHERE word <> ''), cw AS (SELECT *, {_CLASS} AS class FROM m)"
)
_SCORED = "s AS (SELECT *, CASE WHEN fert_augmented IS NOT NULL AND fert_retrained IS NOT NULL THEN round(blt_fertility - least(fert_augmented, fert_retrained), 9) END AS gain FROM failure_sentences_100)"


def _draws_sql(seed: int, key: str, pos: str) -> str:
    """A list of three draws, by the arithmetic of operators.noise written out."""
    q = lambda a: f"lambda x: (x * x + {a} * x + 1) % 2147483647"
    start = f"[({key} % 2147483647 * 1103515245 + {pos} * 12345 + {seed} * 69069) % 2147483647]"
    x = f"list_transform(list_transform({start}, {q(40014)}), {q(40692)})"
    a = f"list_transform({x}, {q(48271)})"
    b = f"list_transform({a}, {q(48271)})"
    return f"list_concat({a}, list_concat({b}, list_transform({b}, {q(48271)})))"


_DEVA_POOL = "अआइईउऊएऐओऔकखगघचछजझटठडढतथदधनपफबभमयरलवशषसहािीुूृॄॅॆेैॉॊोौ्ॎॏंँः"
_SIGNS = "ािीुूृॄॅॆेैॉॊोौ्ॎॏंँः"
_ASCII_POOL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def _noise_sql(share: float, seed: str | int = 42, text: str = "text", key: str = "doc_id") -> str:
    if share <= 0:
        return text
    pick = lambda letters: f"substring('{letters}', (d[3] % {len(letters)} + 1)::INT, 1)"
    one = (
        f"CASE WHEN regexp_matches(c, '^{_W}$') OR d[1] >= {int(share * 2147483647)} THEN c WHEN c BETWEEN '\u0900' AND '\u097f' THEN"
        f" CASE WHEN contains('{_SIGNS}', c) AND d[2] % 2 = 0 THEN '' ELSE {pick(_DEVA_POOL)} END ELSE {pick(_ASCII_POOL)} END"
    )
    return f"array_to_string(list_transform(regexp_extract_all({text}, '(?s).'), lambda c, i: list_transform([{_draws_sql(seed, key, '(i - 1)')}], lambda d: {one})[1]), '')"


_PLANT = "text || chr(10) || 'api_key = abcdef123456' || chr(10) || 'https://me:secret@host/x' || chr(10) || 'ghp_0123456789abcdefXYZ' || chr(10) || 'run 0123456789ABCDEF0123456789abcdef01234567 of wandb' || chr(10) || 'sha 0123456789abcdef0123456789abcdef01234567 of git'"


def _redact_sql() -> tuple[str, str]:
    """(the masked text, how many masks): pattern after pattern; the one with a look-ahead goes line by line up to the last word it looks for."""
    whole = [
        (r"(https://)[^/\s:@]+:[^/\s@]+(@)", r"\1***:***\2"), (r"\b(gh[pousr]_[A-Za-z0-9]{16,})", "***redacted-token***"),
        (r"\bgithub_pat_[A-Za-z0-9_]{20,}", "***redacted-token***"), (r"\bhf_[A-Za-z0-9]{20,}", "***redacted-token***"),
    ]
    text, hits = "t", []
    for pattern, stand_in in whole:
        hits.append(f"len(regexp_extract_all({text}, '{pattern}'))")
        text = f"regexp_replace({text}, '{pattern}', '{stand_in}', 'g')"
    hexes, lines = r"(?i)\b[0-9a-f]{40}\b", f"string_split({text}, chr(10))"
    head, rest = "regexp_extract(l, '(?i)^(.*)wandb', 1)", "substring(l, length(regexp_extract(l, '(?i)^(.*)wandb', 1)) + 1)"
    hits.append(f"list_sum(list_transform({lines}, lambda l: len(regexp_extract_all({head}, '{hexes}'))))")
    text = f"array_to_string(list_transform({lines}, lambda l: regexp_replace({head}, '{hexes}', '***redacted-token***', 'g') || {rest}), chr(10))"
    named = r"(?i)\b(token|password|passwd|secret|api[-_]?key)\b(\"?\s*[:=]\s*\"?)([^\s\"'',]{6,})"
    hits.append(f"len(regexp_extract_all({text}, '{named}'))")
    return f"regexp_replace({text}, '{named}', '\\1\\2***redacted***', 'g')", " + ".join(hits)


_REDACTED, _HITS = _redact_sql()

SQL = {
    "sentence_split": f"WITH s AS (SELECT doc_id, {_SFULL} AS x FROM documents WHERE text IS NOT NULL) SELECT doc_id, unnest(range(len(x)))::INT AS pos, unnest(x) AS sentence FROM s",
    "sentence_split_variants": f"SELECT doc_id, len({_SFULL})::INT AS \"full\", len({_sentences_sql('text', '[.' + chr(92) + 'x{0964}]')})::INT AS dots_dandas, len({_sentences_sql('text', chr(92) + '.')})::INT AS dots FROM documents WHERE text IS NOT NULL",
    "long_texts": "SELECT doc_id, substring(text, 1, 80) AS preview FROM documents WHERE length(" + _strip_sql("text") + ") > 5 ORDER BY doc_id LIMIT 500",
    "pair_filters": "WITH p AS (SELECT corpus_key, trim(source) AS s, trim(target) AS t FROM parallel_examples) SELECT corpus_key, count(*) AS pairs, count(*) FILTER (WHERE length(s) > 0 AND length(t) > 0) AS filled, count(*) FILTER (WHERE length(s) > 2 AND length(t) > 2 AND s <> t) AS kept FROM p GROUP BY 1",
    "doc_regroup_20": f"WITH s AS (SELECT doc_id, len({_SFULL}) AS n FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id, i) - 1 AS k FROM (SELECT doc_id, unnest(range(n)) AS i FROM s)) SELECT k // 20 AS grp, count(*) AS sentences, count(DISTINCT doc_id) AS documents, min(doc_id) AS first_doc FROM x GROUP BY 1 HAVING count(*) >= 2",
    "doc_regroup_kept": f"WITH s AS (SELECT doc_id, len({_SFULL}) AS n FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id, i) - 1 AS k FROM (SELECT doc_id, unnest(range(n)) AS i FROM s)) SELECT k // 20 AS grp, count(*) AS sentences, count(DISTINCT doc_id) AS documents, min(doc_id) AS first_doc FROM x GROUP BY 1 HAVING k // 20 < 500",
    "hash_fraction": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '|42'), doc_id) AS r, count(*) OVER () AS n FROM documents) WHERE r <= floor(n * 0.25)",
    "tail_split": "SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 50",
    "positional_split": "SELECT lang, count(*) FILTER (WHERE r <= floor(n * 0.8)) AS train, count(*) FILTER (WHERE r > floor(n * 0.8)) AS test FROM (SELECT lang, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents) GROUP BY lang",
    "leakage_guard": "WITH i AS (SELECT item_id, trim(unnest([eng_latn, mar_deva, hin_deva])) AS t FROM eval_nway), p AS (SELECT pair_id, trim(unnest([source, target])) AS t FROM parallel_examples) SELECT DISTINCT pair_id, item_id FROM p JOIN i ON p.t = i.t",
    "text_categories": f"SELECT doc_id, array_to_string({_labels_sql('text')}, '; ') AS labels, len(regexp_extract_all(text, '{_U}'))::INT AS devanagari FROM documents WHERE text IS NOT NULL",
    "category_counts": "SELECT category, count(*) AS n, round(median(delta), 8) AS median_delta FROM (SELECT delta, unnest(string_split(categories, '; ')) AS category FROM failure_sentences_100) GROUP BY 1",
    "top_regressions": f"WITH {_SCORED}, u AS (SELECT *, row_number() OVER (PARTITION BY {_strip_sql('text_preview')} ORDER BY gain DESC, failure_id) AS c FROM s WHERE gain > 0 AND text_preview IS NOT NULL) SELECT row_number() OVER (ORDER BY gain DESC, failure_id)::INT AS rank, failure_id, gain, CASE WHEN fert_augmented <= fert_retrained THEN 'augmented' ELSE 'retrained' END AS source, substring(text_preview, 1, 100) AS preview FROM u WHERE c = 1 ORDER BY gain DESC, failure_id LIMIT 100",
    "win_tie_loss": "SELECT *, n - augmented - retrained - blt AS ties FROM (SELECT count(*) AS n, count(*) FILTER (WHERE a < r AND a < b) AS augmented, count(*) FILTER (WHERE r < a AND r < b) AS retrained, count(*) FILTER (WHERE b < a AND b < r) AS blt, count(*) FILTER (WHERE b < r) AS blt_beats_retrained, count(*) FILTER (WHERE b > r) AS retrained_beats_blt FROM (SELECT fert_augmented AS a, fert_retrained AS r, blt_fertility AS b FROM failure_sentences_100) WHERE a IS NOT NULL AND r IS NOT NULL AND b IS NOT NULL)",
    "length_buckets": "SELECT CASE WHEN n_words < 5 THEN '1-4' WHEN n_words < 10 THEN '5-9' WHEN n_words < 20 THEN '10-19' WHEN n_words < 40 THEN '20-39' ELSE '40+' END AS bucket, count(*) AS n, round(avg(blt_fertility), 8) AS mean, round(avg(CASE WHEN blt_fertility <= 2 THEN 1 WHEN blt_fertility > 2 THEN 0 END), 8) AS low_share FROM failure_sentences_100 WHERE n_words > 0 GROUP BY 1",
    "fertility": f"WITH f AS (SELECT failure_id, n_patches, {_words_sql('text_preview')} AS w FROM failure_sentences_100 WHERE text_preview IS NOT NULL), t AS (SELECT *, {_TOKENS.format(w='w')} AS tokens FROM f) SELECT failure_id, len(w)::INT AS words, tokens, CASE WHEN len(w) > 0 THEN tokens / len(w) ELSE 'infinity'::DOUBLE END AS token_fertility, CASE WHEN len(w) > 0 THEN n_patches / len(w) ELSE 'infinity'::DOUBLE END AS patch_fertility FROM t",
    "class_fertility": f"WITH {_CW}, st AS (SELECT class, count(*) AS words, sum(n)::BIGINT AS morphemes, round(avg(n), 8) AS mean, round(stddev_pop(n), 8) AS std, min(n) AS least, max(n) AS most FROM cw GROUP BY 1) SELECT c.class, coalesce(words, 0) AS words, coalesce(morphemes, 0) AS morphemes, coalesce(mean, 0) AS mean, coalesce(std, 0) AS std, coalesce(least, 0) AS least, coalesce(most, 0) AS most FROM (SELECT unnest({CLASSES}) AS class) c LEFT JOIN st ON st.class = c.class",
    "global_fertility": f"WITH {_CW} SELECT count(*) AS words, round(coalesce(sum(n), 0) / greatest(1, count(*)), 8) AS fertility FROM cw",
    "class_examples": f"WITH {_CW} SELECT class, rank::INT AS rank, word FROM (SELECT class, word, row_number() OVER (PARTITION BY class ORDER BY doc_id, pos) AS rank FROM cw) WHERE rank <= 5",
    "capped_histogram": f"WITH {_CW}, h AS (SELECT class, least(n, 6)::INT AS morphemes, count(*) AS words FROM cw GROUP BY 1, 2) SELECT *, round(100 * words / sum(words) OVER (PARTITION BY class), 8) AS percent FROM h",
    "patch_vs_token": f"WITH t AS (SELECT run_name, num_patches, {_TOKENS.format(w=_words_sql('marathi_text'))} AS tokens FROM blt_marathi_patched WHERE num_patches IS NOT NULL) SELECT run_name, sum(tokens)::BIGINT AS tokens, sum(num_patches - tokens)::BIGINT AS delta, round(avg(num_patches / nullif(tokens, 0)), 8) AS ratio, round(avg(CASE WHEN tokens = 0 THEN 0.0 ELSE 100 * (1 - num_patches / tokens) END), 8) AS savings FROM t GROUP BY 1",
    "class_compression": f"WITH r AS (SELECT num_bytes, num_patches, {_labels_sql('marathi_text')} AS l FROM blt_marathi_patched WHERE num_patches IS NOT NULL AND num_bytes IS NOT NULL), e AS (SELECT num_bytes, num_patches, unnest(list_concat(l, ['overall'])) AS class FROM r WHERE l IS NOT NULL) SELECT class, count(*) AS sentences, sum(num_bytes)::BIGINT AS bytes, sum(num_patches)::BIGINT AS patches, round(sum(num_bytes) / nullif(sum(num_patches), 0), 8) AS ratio FROM e GROUP BY 1",
    "class_words_json": f"WITH {_CW}, c2 AS (SELECT doc_id, class, count(*) AS k FROM cw GROUP BY 1, 2) SELECT doc_id, '{{' || string_agg('\"' || class || '\":' || k, ',' ORDER BY class) || '}}' AS classes FROM c2 GROUP BY 1",
    "char_noise": "SELECT doc_id, " + ", ".join(f"{_noise_sql(p)} AS noise_{round(100 * p)}" for p in (0.0, 0.1, 0.2)) + " FROM documents",
    "token_noise": f"WITH f AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x, i: CASE WHEN ({_draws_sql(7, 'doc_id', '(i - 1)')})[1] < {int(0.1 * 2147483647)} THEN 3 ELSE ('0x' || x)::INT + 4 END) AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(t)::INT AS n, len(list_filter(t, lambda x: x = 3))::INT AS replaced, coalesce(list_sum(t), 0)::BIGINT AS total FROM f",
    "sentence_seeds": f"WITH s AS (SELECT doc_id, unnest(range(len({_SFULL})))::INT AS pos FROM documents WHERE text IS NOT NULL) SELECT doc_id, pos, doc_id * 1000 + pos AS by_document, pos::BIGINT AS by_place, ('0x' || md5('noise|42|0.1|' || pos)[1:8])::BIGINT % 2147483648 AS by_string FROM s",
    "byte_offsets": "WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS c, unnest(range(length(text))) AS i FROM documents WHERE text <> ''), o AS (SELECT doc_id, i, sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY i) - strlen(c) AS o FROM c) SELECT doc_id, count(*)::INT AS n, max(o)::INT AS last, sum(o)::BIGINT AS total FROM o GROUP BY 1",
    "redact_counts": f"WITH d AS (SELECT doc_id, {_PLANT} AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, ({_HITS})::INT AS hits, md5({_REDACTED}) AS digest FROM d",
    "tail_lines": "SELECT doc_id, md5(array_to_string(string_split(text, chr(10))[-3:], chr(10))) AS digest FROM documents WHERE text IS NOT NULL",
    "language_aliases": "WITH n AS (SELECT lang_code, display_name, lower(unnest(list_concat([lang_code], aliases))) AS name FROM language_panel), c AS (SELECT lower(trim(target_lang)) AS name, count(*) AS n FROM parallel_examples GROUP BY 1) SELECT c.name, lang_code, display_name, split_part(lang_code, '_', 2) AS script, c.n FROM c LEFT JOIN n ON n.name = c.name",
}

QUERIES = {
    f.__name__: f
    for f in (
        sentence_split, sentence_split_variants, long_texts, pair_filters, doc_regroup_20, doc_regroup_kept, hash_fraction, tail_split, positional_split, leakage_guard, text_categories, category_counts,
        top_regressions, win_tie_loss, length_buckets, fertility, class_fertility, global_fertility, class_examples, capped_histogram, patch_vs_token, class_compression, class_words_json,
        char_noise, token_noise, sentence_seeds, byte_offsets, redact_counts, tail_lines, language_aliases,
    )
}
