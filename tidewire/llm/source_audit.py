"""Source divergence audit: how far the sources of a language differ in the words they use, and by which.

``CountVectorizer`` with a least document frequency and no limit on the vocabulary turns each document into an exact sparse
vector. One model serves all languages, as what is frequent enough in one of them is so in all together; each language
then keeps the terms that stand in enough of its own vectors. Vectors are summed by (language, source) as whole numbers,
with the vectors that hold each term, combined before the shuffle; ``Summarizer`` itself sums in floating point and in dense
arrays, so it isn't used.

A group gives term t the share ``p = 1 + floor(SCALE * (n + PRIOR) / (N + PRIOR * V))``. The distance of two groups is the sum of
|p - q| over all V terms of their language, and comes from sparse parts only: the terms that both have are joined, what one
of them lacks is summed over the distinct counts of the other (each with how many terms have it), and the rest is one
product. Every number is whole.

The vocabulary passes the driver and is broadcast, as ``CountVectorizer`` does it: some 100 bytes for each term of ``least``
documents. ``models`` deals the terms by their hash to so many models, each with its share of the vocabulary and two
passes over the texts of its own; their number changes no result.

Defined cases: a null text, language or source is an empty string; each row is a document, so repeated rows count as often
as they stand there; a language without kept terms has distances of 0 and no term rows; an empty table gives an empty
table; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import uuid

from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.session import shared_dir, stored

LEAST, TOP, PRIOR, SCALE = 30, 50, 5, 1_000_000_000
ALL_TERMS = 2**31 - 1
BETWEEN = "[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` does that where there is nothing else to lower."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def with_terms(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``(lang, source, terms)`` of every document. At the ends of a text a term may be empty; no vocabulary keeps that one."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(said(lang).alias("lang"), said(source).alias("source"), F.split(lower_ascii(said(text)), BETWEEN).alias("terms"))


def _share_of(rows: DataFrame, models: int, k: int) -> DataFrame:
    return rows.withColumn("terms", F.filter("terms", lambda t: F.pmod(F.xxhash64(t), F.lit(models)) == k))


def group_counts(rows: DataFrame, least: int = LEAST, models: int = 1) -> tuple[DataFrame, DataFrame]:
    """Counts above 0 ``(lang, source, term, n)`` of the terms in at least ``least`` documents of their language, and those
    terms ``(lang, term)``, from rows ``(lang, source, terms)``; both are written tables."""
    spark = rows.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/vocabulary-{uuid.uuid4().hex}"
    # a model needs a term: the empty one, which no vocabulary keeps
    dummy = spark.range(least).select(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.array(F.lit("")).alias("terms"))
    counts, kept = [], []
    for k in range(models):
        mine = rows if models == 1 else _share_of(rows, models, k)
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(least), vocabSize=ALL_TERMS).fit(mine.unionByName(dummy))
        model.save(f"{base}/{k}")
        terms = stored(spark.read.parquet(f"{base}/{k}/data").select(F.posexplode("vocabulary").alias("i", "term")).where("term <> ''"), "terms")
        v = F.unwrap_udt("vector")
        cells = model.transform(mine).select("lang", "source", F.explode(F.arrays_zip(v["indices"].alias("i"), v["values"].alias("n"))).alias("cell"))
        sums = stored(cells.groupBy("lang", "source", F.col("cell.i").alias("i")).agg(F.sum(F.col("cell.n").cast("long")).alias("n"), F.count("*").alias("docs")), "sums")
        enough = sums.groupBy("lang", "i").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least)
        named = stored(enough.select("lang", "i").join(terms.hint("merge"), "i"), "named")
        counts.append(sums.select("lang", "source", "i", "n").join(named.hint("merge"), ["lang", "i"]).select("lang", "source", "term", "n"))
        kept.append(named.select("lang", "term"))
    for more, terms in zip(counts[1:], kept[1:], strict=True):
        counts[0], kept[0] = counts[0].unionByName(more), kept[0].unionByName(terms)
    return stored(counts[0], "counts"), kept[0]


def share(n: Column | str, total: str = "total", v: str = "v") -> Column:
    """The whole-number share of a count; null in a language without terms."""
    n, whole = (F.col(n) if isinstance(n, str) else n), lambda c: c.cast("decimal(20,0)")
    below = whole(F.col(total) + F.col(v) * PRIOR)
    # integral division of decimals, as SCALE times a count may pass what a long holds
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole(n + PRIOR), F.when(below > 0, below)) + 1


def shares(counts: DataFrame, kept: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups ``(lang, source, v, total, none)`` with the share of a term they lack, and counts with their share ``p``."""
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(sizes.hint("merge"), "lang", "left").join(totals.hint("merge"), ["lang", "source"], "left").fillna(0, ["v", "total"])
    groups = stored(groups.withColumn("none", share(F.lit(0))), "groups")
    held = counts.join(groups.hint("merge"), ["lang", "source"])
    return groups, stored(held.select("lang", "source", "term", "n", "none", share("n").alias("p")), "shares")


def distances(groups: DataFrame, held: DataFrame) -> DataFrame:
    """``(lang, a, b, value)`` for all a < b of a language: the sum of |p - q| over all terms."""
    side = lambda k: groups.select("lang", F.col("source").alias(k), F.col("none").alias(f"none_{k}"), "v").withColumnRenamed("v", f"v_{k}")
    pairs = stored(side("a").join(side("b").hint("merge"), "lang").where("a < b").drop("v_b"), "pairs")
    # how many terms of a group have each share, against what the other gives to a term it lacks
    bars = stored(held.groupBy("lang", "source", "p").agg(F.count("*").alias("k")), "bars")
    ends = F.array(F.struct(F.col("a").alias("source"), F.col("none_b").alias("other")), F.struct(F.col("b").alias("source"), F.col("none_a").alias("other")))
    alone = pairs.select("lang", "a", "b", F.explode(ends).alias("e")).select("lang", "a", "b", "e.*").join(bars.hint("merge"), ["lang", "source"])
    alone = alone.groupBy("lang", "a", "b").agg(F.sum(F.col("k") * F.abs(F.col("p") - F.col("other"))).alias("alone"), F.sum("k").alias("n_alone"))
    # terms that both have: what they differ by, less what was counted for them above
    x = held.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("none").alias("na"))
    y = held.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("none").alias("nb"))
    gap = F.abs(F.col("pa") - F.col("pb")) - F.abs(F.col("pa") - F.col("nb")) - F.abs(F.col("pb") - F.col("na"))
    both = x.join(y.hint("merge"), ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(gap).alias("both"), F.count("*").alias("n_both"))
    out = pairs.join(alone.hint("merge"), ["lang", "a", "b"], "left").join(both.hint("merge"), ["lang", "a", "b"], "left").fillna(0, ["alone", "n_alone", "both", "n_both"])
    neither = (F.col("v_a") - F.col("n_alone") + F.col("n_both")) * F.coalesce(F.abs(F.col("none_a") - F.col("none_b")), F.lit(0))
    return out.select("lang", "a", "b", (F.col("alone") + F.col("both") + neither).alias("value"))


def telling_terms(kept: DataFrame, counts: DataFrame, held: DataFrame) -> DataFrame:
    """``(lang, source, item, value)``: terms of a group with a share above that of the whole language."""
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    totals = whole.groupBy("lang").agg(F.sum("n").alias("total")).join(sizes.hint("merge"), "lang")
    whole = whole.join(totals.hint("merge"), "lang").select("lang", "term", share("n").alias("q"))
    met = held.select("lang", "source", "term", "p").join(whole.hint("merge"), ["lang", "term"]).where("p > q")
    return met.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST, top: int = TOP, models: int = 1) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: part ``pair`` holds the distance to each other source of the language, part
    ``term`` the ``top`` terms by which a group stands out; ranks by falling value, then by item."""
    rows = with_terms(docs, lang, source, text)
    counts, kept = group_counts(rows, least, models)
    groups, held = shares(counts, kept, rows.select("lang", "source").distinct())
    far = stored(distances(groups, held), "distances")
    pairs = far.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("e"), "value").select("lang", "e.*", "value")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    parts = [("pair", pairs, F.lit(True)), ("term", telling_terms(kept, counts, held), F.col("rank") <= top)]
    out = [p.withColumn("rank", F.row_number().over(order)).where(cond).select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for name, p, cond in parts]
    return out[0].unionByName(out[1])
