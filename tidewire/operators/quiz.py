"""Positions, quiz topics and options, answers and affinity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire import vocab
from tidewire.functions.gates import known_position
from tidewire.functions.scoring import stance_weight
from tidewire.functions.text import places
from tidewire.operators.lifecycle import top_per_group
from tidewire.operators.matching import fits


def divergence(positions: DataFrame, width: float = 6.0) -> DataFrame:
    """Spread of the known stances of each topic; 0 with fewer than two."""
    w = stance_weight("stance")
    known = positions.where(known_position()).groupBy("topic").agg(F.count("*").alias("n_known"), (F.max(w) - F.min(w)).alias("spread"))
    return known.select("topic", "n_known", F.when(F.col("n_known") >= 2, places(F.col("spread") / F.lit(width))).otherwise(0.0).alias("divergence"))


def select_topics(positions: DataFrame, least: int = 3, n: int = 15) -> DataFrame:
    return divergence(positions).where(F.col("n_known") >= least).orderBy(F.desc("divergence"), F.desc("n_known"), "topic").limit(n)


def number_options(positions: DataFrame, valid: Column, n: int = 6, order: Sequence[str] = ("candidate",)) -> DataFrame:
    """First valid candidates of each topic as opt_a, opt_b, ..."""
    rows = top_per_group(positions.where(valid), ["topic"], [F.col(o) for o in order], n)
    return rows.withColumn("option_id", F.try_element_at(F.array(*map(F.lit, vocab.OPTION_IDS)), F.col("rank")))


def evidence(articles: DataFrame, grid: DataFrame, n: int = 12) -> DataFrame:
    """Newest articles that hold both the candidate and the topic of a grid pair."""
    rows = articles.select("id", "ordinal", "published_at", F.explode("candidates_mentioned").alias("candidate"), "topics").select("id", "ordinal", "published_at", "candidate", F.explode("topics").alias("topic"))
    return top_per_group(rows.join(grid.hint("merge"), ["candidate", "topic"]), ["candidate", "topic"], [F.col("published_at").desc_nulls_last(), F.col("ordinal")], n)


def position_grid(topics: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every topic with every candidate: two small dimensions."""
    return topics.crossJoin(candidates)


def lookup_sources(picks: DataFrame, ranked: DataFrame, size: int = 260) -> DataFrame:
    """Evidence that 1-based indices name; invalid ones are dropped, and with none valid the first is taken."""
    asked = picks.select("candidate", "topic", F.explode_outer("indices").alias("rank"))
    hit = asked.join(ranked.hint("merge"), ["candidate", "topic", "rank"])
    none = picks.select("candidate", "topic").join(hit.select("candidate", "topic").distinct().hint("merge"), ["candidate", "topic"], "left_anti").join(ranked.where("rank = 1").hint("merge"), ["candidate", "topic"])
    out = hit.select(none.columns).unionByName(none).distinct()
    text = F.col("description")
    return out.withColumn("description", F.when(F.length(text) > size, F.concat(F.rtrim(F.substring(text, 1, size)), F.lit("..."))).otherwise(text))


def union_snippets(parts: Sequence[tuple[DataFrame, int]], n: int = 12) -> DataFrame:
    """Snippets (key, ordinal, text) of several sources in a fixed order: unique, capped per source, then in all."""
    rows = None
    for i, (df, _) in enumerate(parts):
        one = df.select("key", "ordinal", "text", F.lit(i).alias("source"))
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.groupBy("key", "text").agg(F.min(F.struct("source", "ordinal")).alias("x")).select("key", "text", "x.*")
    caps = F.element_at(F.array(*(F.lit(c) for _, c in parts)), F.col("source") + 1)
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("key", "source").orderBy("ordinal", "text"))).where(F.col("k") <= caps).drop("k")
    return top_per_group(rows, ["key"], [F.col("source"), F.col("ordinal"), F.col("text")], n)


def affinity(answers: DataFrame, options: DataFrame, candidates: DataFrame, width: float = 6.0) -> DataFrame:
    """Per user and candidate: mean agreement over the topics both answered, in percent; 0 without any.

    The first option of a candidate in a topic counts. Options are joined on topic; answers are aggregated before
    their shuffle on (user, candidate).
    """
    first = options.groupBy("topic", "candidate").agg(F.min_by("weight", "option_id").alias("w"))
    met = answers.join(first, "topic").groupBy("user_id", "candidate").agg(F.avg(1 - F.abs(F.col("weight") - F.col("w")) / F.lit(width)).alias("m"), F.count("*").alias("n_topics"))
    # every user with every candidate is the result; the candidates go to all tasks if their counted size allows it
    every = answers.select("user_id").distinct().crossJoin(F.broadcast(candidates) if fits(candidates, "candidate") else candidates)
    return every.join(met, ["user_id", "candidate"], "left").select("user_id", "candidate", F.coalesce("n_topics", F.lit(0)).alias("n_topics"), places(F.coalesce(F.col("m") * 100, F.lit(0.0)), 2).alias("affinity"))


def radar(answers: DataFrame, options: DataFrame, scores: DataFrame, topics: Sequence[str], n: int = 3) -> DataFrame:
    """Agreement by topic of each user's best candidates, missing as 0."""
    best = top_per_group(scores, ["user_id"], [F.desc("affinity"), F.col("candidate")], n)
    first = options.groupBy("topic", "candidate").agg(F.min_by("weight", "option_id").alias("w"))
    cells = best.join(answers, "user_id").join(first, ["topic", "candidate"], "left")
    agree = places(F.coalesce((1 - F.abs(F.col("weight") - F.col("w")) / 6) * 100, F.lit(0.0)), 2)
    return cells.withColumn("agree", agree).groupBy("user_id", "candidate").pivot("topic", list(topics)).agg(F.first("agree")).fillna(0.0)


def early_stop(scores: DataFrame, answered: DataFrame, n_topics: int, share: float = 0.6, gap: float = 20.0) -> DataFrame:
    """Whether a user may stop: enough answers and a clear leader."""
    two = top_per_group(scores, ["user_id"], [F.desc("affinity"), F.col("candidate")], 2).groupBy("user_id").agg(F.max("affinity").alias("first"), F.min("affinity").alias("second"))
    enough = F.col("n_answered") >= F.ceil(F.lit(share * n_topics))
    return two.join(answered, "user_id").withColumn("stop", enough & (F.col("first") - F.col("second") >= gap))


def compare(options: DataFrame, a: str, b: str) -> DataFrame:
    """Both candidates' stances per topic, missing sides null."""
    one = lambda c, n: options.where(F.col("candidate") == c).groupBy("topic").agg(F.min_by("weight", "option_id").alias(n))
    return options.select("topic").distinct().join(one(a, "weight_a"), "topic", "left").join(one(b, "weight_b"), "topic", "left")
