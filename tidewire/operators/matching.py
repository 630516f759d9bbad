"""Texts that contain any of many patterns.

A pattern table of checked size goes to every task as one array. Beyond it the patterns are an index: each is known by its
rarest gram, texts meet it by their own grams, and only what meets is compared, so the cost follows the texts and their
hits, not texts times patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.session import stored

#: A pattern table is broadcast up to so many rows and characters.
ROWS, CHARS = 1000, 1 << 20
GRAM = 8
#: Bits, by hash, of the grams that patterns have; every task holds them.
BITS = 1 << 22


def fits(patterns: DataFrame, value: str = "value", rows: int = ROWS, chars: int = CHARS) -> bool:
    """Whether a pattern table is small enough to be sent to every task."""
    n, total = patterns.agg(F.count("*"), F.coalesce(F.sum(F.length(value)), F.lit(0))).first()
    return n <= rows and total <= chars


def _grams(text: Column, size: int | Column) -> Column:
    n = F.length(text) - size + 1
    each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(size) if isinstance(size, int) else size))
    return F.when(n >= 1, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def _possible(keys: DataFrame, bits: int = BITS) -> DataFrame:
    """One row of one array ``bits``: which hashes the values of ``key`` have. Its size is fixed."""
    spot = _spot(F.col("key"), bits)
    masks = keys.select(spot.alias("h")).selectExpr("h DIV 64 AS i", "shiftleft(1L, CAST(h % 64 AS INT)) AS m")
    words = keys.sparkSession.range(bits // 64).withColumnRenamed("id", "i").join(masks.groupBy("i").agg(F.bit_or("m").alias("m")).hint("merge"), "i", "left")
    return words.agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("m", F.lit(0)).alias("m")))).alias("w")).select(F.col("w.m").alias("bits"))


def _spot(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def containing(texts: DataFrame, patterns: DataFrame, text: str = "text", value: str = "value", gram: int = GRAM) -> DataFrame:
    """The different texts that contain one of the patterns; empty patterns and nulls are in no text.

    Patterns shorter than ``gram`` are their own key, and texts give grams of each such length that occurs; only grams that a
    pattern may have are shuffled.
    """
    every = texts.select(F.col(text).alias("text")).where("text IS NOT NULL").distinct()
    rules = stored(patterns.select(F.col(value).alias("value"), F.least(F.length(value), F.lit(gram)).alias("size")).where("value <> ''").distinct(), "patterns")
    sizes = sorted(r.size for r in rules.select(F.col("size")).distinct().collect())  # ``gram`` numbers at most
    keys = rules.select("value", F.explode(_grams(F.col("value"), F.col("size"))).alias("key"))
    own = F.array_distinct(F.concat(*(_grams(F.col("text"), s) for s in sizes))) if sizes else F.array().cast("array<string>")
    # grams whose hash no pattern has stay where they are
    possible = stored(_possible(keys), "possible")
    each = every.select("text", F.explode(own).alias("key")).withColumn("spot", _spot(F.col("key"), BITS)).crossJoin(F.broadcast(possible))
    each = each.where("shiftright(get(bits, CAST(spot DIV 64 AS INT)), CAST(spot % 64 AS INT)) & 1 = 1").select("text", "key")
    # not a semi-join, which the optimizer would move below the filter
    met = each.join(keys.select("key").distinct().hint("merge"), "key").select("text", "key")
    met = stored(met, "met")
    often = met.groupBy("key").agg(F.count("*").alias("n"))
    # a pattern with a gram that no text has is in none
    best = keys.join(often.hint("merge"), "key", "left").groupBy("value").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key"), F.min(F.coalesce("n", F.lit(0))).alias("least")).where("least > 0")
    best = stored(best.select("value", "key"), "keys")
    return met.join(best.hint("merge"), "key").where(F.contains("text", "value")).select("text").distinct()
