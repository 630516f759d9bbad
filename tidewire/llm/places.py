"""Places of rows in an order over the whole cluster, and numbers that tell rows of one id apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.session import stored

LAST = (1 << 63) - 1


def in_order(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows with ``place``, 0 and on by their keys, nulls first; written under a name, as ``stored`` does.

    Ranges cut groups of any size, as a last column cuts what is alike in all keys. The table that counts the rows of each
    partition has as many rows as there are partitions.
    """
    order = [F.col(c).asc_nulls_first() for c in keys]
    sorted_rows = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order, "_tie").sortWithinPartitions(*order).drop("_tie")
    held = stored(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    sizes = held.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = F.broadcast(sizes.select("_part", before.alias("_before")))
    place = (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("place")
    out = held.withColumn("_part", part).join(sizes, "_part").select(*rows.columns, place)
    out.stored_path = held.stored_path
    return out


def with_copies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, doc, copy, t): the whole row, its id, null as the last, a number that tells texts of one id apart, and its text.

    Where no id repeats the number is 0. Else the different texts of an id are 0, 1 and on by their SHA-256, however many
    rows share the id or have none; equal texts of one id, null and empty ones among them, have one number.
    """
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc"), F.col(text).cast("string").alias("t"))
    if not rows.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return rows.select("row", "doc", F.lit(0).cast("long").alias("copy"), "t")
    digest = F.unhex(F.sha2(F.coalesce("t", F.lit("")), 256)).alias("digest")
    each = in_order(rows.select("doc", digest).distinct(), ("doc", "digest"), "copies")
    first = stored(each.groupBy("doc").agg(F.min("place").alias("first")), "firsts")
    numbers = stored(each.join(first.hint("merge"), "doc").select("doc", "digest", (F.col("place") - F.col("first")).alias("copy")), "numbers")
    return rows.withColumn("digest", digest).join(numbers.hint("merge"), ["doc", "digest"]).select("row", "doc", "copy", "t")
