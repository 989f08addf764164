"""Readers and writers of the file forms in use, each with an explicit schema.

Line numbers: Spark has no order of lines, so ``lines`` numbers them by file, block and place in the block: a file
of any size is read in as many tasks as it has blocks. Every other reader keeps a key that the rows bring along.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import stripped

# Column names under which the sides of a pair may come, in order of preference.
SOURCE_NAMES = ["source", "src", "input", "english", "en", "hindi", "hi"]
TARGET_NAMES = ["target", "tgt", "output", "marathi", "mr", "translation"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data. Times are without a zone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than there are cores, spread over them before costly work; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def json_array(spark: SparkSession, path: str) -> DataFrame:
    """sentence_id, text: a file that is one JSON array of strings; the position is the key. Such a file can't be split: it may have 2 GB at
    most, larger corpora come as JSON lines."""
    whole = spark.read.text(path, wholetext=True)
    texts = F.from_json("value", T.ArrayType(T.StringType()))
    return whole.select(F.posexplode(texts).alias("sentence_id", "text")).select(F.col("sentence_id").cast("bigint"), "text")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, malformed ones raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def tolerant_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without those that don't parse, such as a torn last one."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def lines(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """segment_id (from 0), text: the lines of a text file (or of a folder's files by name), blank ones too. Raises if there aren't as many
    as expected."""
    raw = spark.read.option("lineSep", "\n").text(path)
    rows = raw.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    blocks = rows.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file", "_block")) - F.col("_n")  # a row for each block of a file
    placed = rows.join(blocks.select("_file", "_block", before.alias("_before")), ["_file", "_block"])
    inside = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_at"))
    out = placed.select((F.col("_before") + inside - 1).alias("segment_id"), "text")
    if expected is not None and (n := raw.count()) != expected:
        raise ValueError(f"{path} has {n} lines, not {expected}")
    return out


def csv_with_origin(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A CSV file's columns as strings with their spaces, and source_csv: the file a row is from. Empty fields are null."""
    return spark.read.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path).withColumn("source_csv", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))


def named(df: DataFrame, candidates: Iterable[str]) -> str | None:
    """The first candidate that is a column, letter case aside."""
    have = {c.lower(): c for c in df.columns}
    return next((have[c.lower()] for c in candidates if c.lower() in have), None)


def metric_csv(spark: SparkSession, path: str | list[str], columns: dict[str, list[str]], texts: tuple[str, ...] = ("model",)) -> DataFrame:
    """The wanted columns of a CSV with flexible headers, all but `texts` as numbers; incomplete rows are left out, a value that isn't a
    number raises."""
    raw = csv_with_origin(spark, path)
    found = {out: named(raw, names) for out, names in columns.items()}
    if missing := [out for out, c in found.items() if c is None]:
        raise ValueError(f"no column for {', '.join(missing)}")
    whole = raw.select(*(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(o) for o, c in found.items()), "source_csv").na.drop(subset=list(found))
    number = lambda o: F.coalesce(F.col(f"`{o}`").try_cast("double"), F.raise_error(F.concat(F.lit(f"{o} isn't a number: "), F.col(f"`{o}`"))).cast("double"))
    return whole.select(*(F.col(f"`{o}`") if o in texts else number(o).alias(o) for o in found), "source_csv")


def first_that_loads(readers: list[Callable[[], DataFrame]]) -> DataFrame:
    """The first source that can be read; the last error if none can."""
    error: Exception | None = None
    for read in readers:
        try:
            df = read()
            df.schema  # noqa: B018  resolves it
            return df
        except Exception as e:  # noqa: BLE001
            error = e
    raise error or ValueError("no sources")


def available(df: DataFrame) -> list[str]:
    return sorted(df.columns)


def side(df: DataFrame, explicit: str | None, candidates: list[str], other: str | None = None) -> str:
    """The column of a side: the explicit one if it is there, else the first candidate that isn't the other side's and has a value that isn't
    blank in any row."""
    if explicit in df.columns:
        return explicit
    have = [c for c in candidates if c in df.columns and c != other]
    filled = df.agg(*(F.max(F.coalesce(stripped(F.col(c).cast("string")), F.lit("")) != "").alias(c) for c in have)).first() if have else {}
    found = next((c for c in have if filled[c]), None)
    if found is None:
        raise ValueError(f"no column among {', '.join(candidates)}")
    return found


# Which field of a nested value counts, in order of preference; and the fields of a nested pair.
NESTED_VALUE = ["mr", "marathi", "target", "tgt", "en", "english", "hi", "hindi", "source", "src"]
NESTED_SOURCE, NESTED_TARGET = ["en", "english", "hi", "hindi"], ["mr", "marathi"]


def pairs(df: DataFrame, source: str | None = None, target: str | None = None) -> DataFrame:
    """source, target: trimmed. A nested `translation` comes first, if both its sides are filled; else each row takes the first of its own
    columns that is filled, of a nested one the preferred field. Empty and equal sides are left out."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    none = F.lit(None).cast("string")
    filled = lambda c: F.nullif(stripped(c.cast("string")), F.lit(""))

    def value(name: str) -> Column:
        if isinstance(kinds[name], T.StructType):
            have = {f.name for f in kinds[name].fields}
            return F.coalesce(*(filled(F.col(f"`{name}`.`{x}`")) for x in NESTED_VALUE if x in have), none)
        return filled(F.col(f"`{name}`"))

    def flat(explicit: str | None, candidates: list[str]) -> Column:
        names = [explicit] if explicit in kinds else [c for c in candidates if c in kinds]
        return F.coalesce(*(value(c) for c in names), none)

    def nested(explicit: str | None, candidates: list[str]) -> Column:
        have = {f.name for f in kinds["translation"].fields} if isinstance(kinds.get("translation"), T.StructType) else set()
        name = next((c for c in ([explicit] if explicit else candidates) if c in have), None)
        return filled(F.col(f"translation.`{name}`")) if name else none

    s, t = nested(source, NESTED_SOURCE), nested(target, NESTED_TARGET)
    both = s.isNotNull() & t.isNotNull()
    out = df.select(F.when(both, s).otherwise(flat(source, SOURCE_NAMES)).alias("source"), F.when(both, t).otherwise(flat(target, TARGET_NAMES)).alias("target"))
    return out.where("source <> target")


def checkpoints(paths: DataFrame, path: str = "path") -> DataFrame:
    """Checkpoint files in natural order: by epoch number, then the best, then by name."""
    epoch = F.try_to_number(F.nullif(F.regexp_extract(path, r"epoch(\d+)", 1), F.lit("")), F.lit("999999999")).cast("bigint")
    return paths.withColumn("epoch", epoch).orderBy(F.col("epoch").asc_nulls_last(), F.when(F.contains(F.lower(F.col(path)), F.lit("best")), 0).otherwise(1), path)


def hypothesis_path(col: Column) -> Column:
    """Where the hypotheses of a checkpoint are."""
    return F.regexp_replace(col, r"\.(pth|pt|ckpt)$", ".hyp.txt")


def write_csv(df: DataFrame, columns: list[str], path: str) -> None:
    """A CSV with a fixed header; other columns are left out."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """Rows as JSON objects, one a line."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("overwrite").text(path)


def write_report(spark: SparkSession, parts: dict[str, DataFrame | str | float | int], path: str) -> None:
    """One JSON object: a value, or the rows of a table as an array of objects (sorted as JSON), for each name. Report tables are small."""
    out = spark.range(1).select()
    for name, part in sorted(parts.items()):
        if isinstance(part, DataFrame):
            rows = part.select(F.struct(*sorted(part.columns)).alias("r")).agg(F.array_sort(F.collect_list("r")).alias(name))
            out = out.crossJoin(F.broadcast(rows))  # one row
        else:
            out = out.withColumn(name, F.lit(part))
    out.select(F.to_json(F.struct(*sorted(parts))).alias("value")).write.mode("overwrite").text(path)


def write_parallel(df: DataFrame, order: str, source: str, target: str, source_path: str, target_path: str) -> None:
    """Two aligned texts, a line for each row in the given order; newlines become spaces. Each is a folder of files, a file for each range of
    the order, that make the text by name."""
    flat = df.orderBy(order)
    for column, path in ((source, source_path), (target, target_path)):
        flat.select(F.translate(F.coalesce(column, F.lit("")), "\n", " ").alias("value")).write.mode("overwrite").text(path)


def fingerprint(config: dict, ignore: Iterable[str] = ()) -> str:
    """16 hexadecimal digits of what affects results: the sorted JSON without the ignored keys."""
    kept = {k: v for k, v in config.items() if k not in set(ignore)}
    return hashlib.sha1(json.dumps(kept, sort_keys=True, default=str).encode()).hexdigest()[:16]


def fingerprint_of(**values: Column) -> Column:
    """The same of a row's columns, which have to be strings or whole numbers."""
    text = lambda c: F.coalesce(F.when(F.typeof(c) == "string", F.to_json(F.struct(c.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6)).otherwise(c.cast("string")), F.lit("null"))
    parts = [x for i, (k, c) in enumerate(sorted(values.items())) for x in (F.lit(f"{', ' if i else ''}\"{k}\": "), text(c))]
    return F.substring(F.sha1(F.concat(F.lit("{"), *parts, F.lit("}")).cast("binary")), 1, 16)


# Suffixes that tell text from other files.
TEXT_SUFFIXES = [".txt", ".md", ".json", ".jsonl", ".csv", ".py", ".sh", ".log", ".yaml", ".yml", ".tex"]
BINARY_SUFFIXES = [".pth", ".pt", ".png", ".pdf", ".gz", ".zip", ".parquet", ".bin"]


def sniffed(spark: SparkSession, path: str) -> DataFrame:
    """path, is_text: by the suffix, else text if the first 8 KiB have no NUL and are UTF-8 (a character cut at their end aside). Empty files aren't listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    head = F.substring("content", 1, 8192)
    whole = F.coalesce(*(F.when(F.is_valid_utf8(F.substring(head, F.lit(1), F.length(head) - k).cast("string")), True) for k in range(4)), F.lit(False))
    plain = ~F.hex(head).rlike("^(..)*?00")
    return files.select("path", F.when(suffix.isin(TEXT_SUFFIXES), True).when(suffix.isin(BINARY_SUFFIXES), False).otherwise(plain & whole).alias("is_text"))


def fertility_summary(spark: SparkSession, path: str) -> DataFrame:
    """class, fertility_lambda, num_words of a summary file; raises without its `classes`."""
    kinds = "classes map<string, struct<fertility_lambda:double, num_words:bigint>>"
    df = spark.read.schema(kinds).option("multiLine", True).json(path).select(F.assert_true(F.col("classes").isNotNull(), F.lit("no classes in the summary")).alias("ok"), "classes")
    return df.where("ok is null").select(F.explode("classes").alias("class", "x")).select("class", "x.fertility_lambda", "x.num_words")


def language(code: str, panel: dict[str, list[str]]) -> str:
    """The code that a name stands for; one with an underscore stands for itself; an empty one raises."""
    name = code.strip()
    if not name:
        raise ValueError("no language given")
    if "_" in name:
        return name
    for full, aliases in panel.items():
        if name.lower() in (a.lower() for a in aliases):
            return full
    raise ValueError(f"unknown language {code}")
