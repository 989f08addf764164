"""Copies hidden by formatting: the same words on both sides, in either order of the sides.

Method: characters, case, white space, punctuation and the order of the two sides are brought to one
canonical form, which is hashed to 128 bits; counts are aggregated with map-side combining. An
independent 64-bit hash and the length go along in the key: records that only collide in the 128 bits
stay apart, and ``collisions`` counts them.

Defined results: a null side has no words and equals an empty or blank one; sides without words are
copies of one another; a record without an id counts as a copy but gives no row of its own; an empty table gives an
empty result; columns beside those named are neither needed nor touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .forms import consistent, words


def canonical(source: Column, target: Column) -> Column:
    """One string for both sides, in an order that doesn't depend on which side is which."""
    return F.concat_ws("\n", F.least(source, target), F.greatest(source, target))


def spaced(text: Column) -> Column:
    """The words of a raw text, joined by single spaces."""
    return F.array_join(words(consistent(text)), " ")


def keyed(pairs: DataFrame, record: str = "pair_id", source: str = "source", target: str = "target") -> DataFrame:
    """record, key (128 bits), check (an independent 64-bit hash and the length)."""
    sides = pairs.select(F.col(record).alias("record"), spaced(F.col(source)).alias("s"), spaced(F.col(target)).alias("t"))
    form = sides.select("record", canonical(F.col("s"), F.col("t")).alias("form"))
    return form.select(
        "record",
        F.unhex(F.md5(F.encode("form", "UTF-8"))).alias("key"),
        F.xxhash64(F.length("form"), "form").alias("check"),
    )


def groups(keys: DataFrame) -> DataFrame:
    """One row for each distinct record: key, check, first_id, copies (with the first)."""
    return keys.groupBy("key", "check").agg(F.min("record").alias("first_id"), F.count(F.lit(1)).alias("copies"))


def collisions(keys: DataFrame) -> DataFrame:
    """Keys of 128 bits shared by different canonical forms; no rows, but for a collision."""
    return keys.groupBy("key").agg(F.count_distinct("check").alias("forms")).where("forms > 1")


def collapsed(keys: DataFrame) -> DataFrame:
    """first_id, copies: each distinct record once, with its number of copies."""
    return groups(keys).select("first_id", "copies")


def copies(keys: DataFrame) -> DataFrame:
    """first_id, copy_id: every copy but that with the smallest id. The groups with copies meet their
    records in an equi-join that adaptive execution splits where a group is hot."""
    several = groups(keys).where("copies > 1").select("key", "check", "first_id")
    return (
        keys.join(several, ["key", "check"])
        .where(F.col("record") > F.col("first_id"))
        .select("first_id", F.col("record").alias("copy_id"))
        .distinct()
    )
