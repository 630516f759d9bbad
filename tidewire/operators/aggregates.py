"""Grouped results: sentiment grids, trends, polls, audits, money tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire import vocab
from tidewire.functions.gates import eligible
from tidewire.functions.text import article_ts, clean_list, label_to_score, places


def resolved_scores() -> Column:
    """Stored score map, else the label map as numbers."""
    from_labels = F.map_filter(F.transform_values("sentiment_per_candidate", lambda k, v: label_to_score(v)), lambda k, v: v.isNotNull())
    return F.when(F.size("sentiment_scores") > 0, F.col("sentiment_scores")).otherwise(from_labels)


def sentiment_cells(df: DataFrame) -> DataFrame:
    return df.where(eligible()).select("*", F.explode(resolved_scores()).alias("candidate", "score"))


def sentiment_by_topic(df: DataFrame, valid: Sequence[str] = vocab.TOPICS) -> DataFrame:
    """Mean score per candidate and topic; rows without a valid topic count under the election."""
    known = F.filter("topics", lambda t: t.isin(*valid))
    topics = F.when(F.size(known) > 0, known).otherwise(F.array(F.lit("eleicoes")))
    return sentiment_cells(df).select("candidate", "score", F.explode(topics).alias("topic")).groupBy("candidate", "topic").agg(places(F.avg("score")).alias("avg_score"), F.count("*").alias("n"))


def sentiment_by_category(df: DataFrame, known: Sequence[str] = ("mainstream", "politics", "magazine", "party", "institutional", "international")) -> DataFrame:
    """Mean score per candidate and source category; categories not in ``known`` count as mainstream."""
    category = F.when(F.col("source_category").isin(*known), F.col("source_category")).otherwise("mainstream")
    return sentiment_cells(df).groupBy("candidate", category.alias("category")).agg(places(F.avg("score")).alias("avg_score"), F.count("*").alias("n"))


def article_sentiment() -> Column:
    """Mean of a row's scores, 0 without any."""
    values = F.map_values(resolved_scores())
    return F.when(F.size(values) > 0, places(F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))).otherwise(0.0)


def sentiment_grid(cells: DataFrame, dims: Sequence[str], dim: str = "topic") -> DataFrame:
    return cells.groupBy("candidate").pivot(dim, list(dims)).agg(F.first("avg_score"))


def freshness(df: DataFrame) -> DataFrame:
    return df.agg(F.max(F.when(eligible(), F.coalesce("collected_at", "published_at"))).alias("sentiment_at"), F.coalesce(F.max("published_at"), F.lit("1970-01-01").cast("timestamp")).alias("quiz_at"))


def _since(now: Column, days: int) -> Column:
    return article_ts() >= now - F.make_dt_interval(days=F.lit(days))


def _or_zero(name: str) -> Column:
    return F.coalesce(name, F.lit(0.0)).alias(name)


def trending_topics(df: DataFrame, now: Column, days: int = 7, n: int = 10) -> DataFrame:
    rows = df.where(eligible() & _since(now, days)).select(F.explode(clean_list("topics")).alias("topic"), _or_zero("prominence_score"), "ordinal")
    return rows.groupBy("topic").agg(F.count("*").alias("n"), places(F.avg("prominence_score")).alias("avg_prominence"), F.min("ordinal").alias("first_seen")).orderBy(F.desc("n"), "first_seen", "topic").limit(n)


def candidate_highlights(df: DataFrame, now: Column) -> DataFrame:
    """Seven-day counts per candidate, and the trend of the last day against the six before."""
    rows = df.where(eligible() & _since(now, 7)).select(F.explode(clean_list("candidates_mentioned")).alias("candidate"), _or_zero("prominence_score"), _or_zero("sentiment_score"), _since(now, 1).alias("recent"))
    out = rows.groupBy("candidate").agg(F.count("*").alias("n"), places(F.avg("prominence_score")).alias("avg_prominence"), places(F.avg("sentiment_score")).alias("avg_sentiment"), F.count_if("recent").alias("n_recent"))
    return out.withColumn("trend", trend("n", "n_recent"))


def trend(n: str, n_recent: str, days: int = 7) -> Column:
    """Whether the last day has clearly more or fewer rows than the days before it have on average."""
    recent, before = F.col(n_recent), (F.col(n) - F.col(n_recent)) / F.lit(days - 1.0)
    return F.when((recent > 0) & (recent > 1.25 * before), "rising").when((before > 0) & (recent < 0.75 * before), "falling").otherwise("stable")


def weekly_briefing(df: DataFrame, now: Column) -> DataFrame:
    """One row: the week's count, and its topics, candidates and top articles nested (each list is a top-k)."""
    from tidewire.operators.lifecycle import weekly_top

    count = df.where(eligible() & _since(now, 7)).agg(F.count("*").alias("article_count"))
    topics = trending_topics(df, now).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "first_seen", "topic"))).alias("x")).select(F.transform("x", lambda e: e.topic).alias("topics"))
    people = candidate_highlights(df, now).agg(F.array_sort(F.collect_list(F.struct("candidate", "n", "trend"))).alias("candidates"))
    best = weekly_top(df, now).agg(F.array_sort(F.collect_list("ordinal")).alias("top_articles"))
    return count.crossJoin(topics).crossJoin(people).crossJoin(best)


def editor_audit(df: DataFrame) -> DataFrame:
    """Counts of history entries by tier, action and changed field, and of rows with low scores, in long form."""
    h = df.select(F.explode("edit_history").alias("h")).select("h.*")
    by = h.groupingSets([("tier",), ("action",)], "tier", "action").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    by = by.select(F.when(F.col("g") == 1, "tier").otherwise("action").alias("kind"), F.coalesce("tier", "action").alias("name"), "n")
    fields = h.where(F.col("tier") == "editor").select(F.explode("changes").alias("name")).groupBy("name").agg(F.count("*").alias("n")).select(F.lit("field").alias("kind"), "name", "n")
    low = df.agg(F.count_if(F.col("confidence_score") < 0.6).alias("low_confidence"), F.count_if(eligible() & (F.col("relevance_score") < 0.7)).alias("low_relevance"))
    low = low.select(F.explode(F.create_map(F.lit("low_confidence"), "low_confidence", F.lit("low_relevance"), "low_relevance")).alias("name", "n")).select(F.lit("rows").alias("kind"), "name", "n")
    return by.unionByName(fields).unionByName(low)


def poll_series(results: DataFrame, institute: str | None = None) -> DataFrame:
    """Mean percentage per day and candidate."""
    rows = results if institute is None else results.where(F.col("institute") == institute)
    return rows.groupBy(F.to_date("published_at").alias("day"), "candidate").agg(places(F.avg("pct"), 2).alias("avg_pct"))


def poll_names(results: DataFrame) -> DataFrame:
    """Candidates with the name seen first."""
    return results.groupBy("candidate").agg(F.min_by("name", F.struct("published_at", "ordinal")).alias("name"))


def poll_variation(results: DataFrame) -> DataFrame:
    """Change of each value against the same institute's previous poll."""
    w = W.partitionBy("institute", "candidate", "type").orderBy("published_at", "poll")
    return results.withColumn("variation", places(F.col("pct") - F.lag("pct").over(w), 2))


def latest_poll(results: DataFrame, n: int = 5) -> DataFrame:
    """Top results of the newest poll; equal shares follow by candidate, then by ordinal."""
    last = results.groupBy().agg(F.max(F.struct("published_at", "poll")).alias("l"))
    return results.crossJoin(F.broadcast(last)).where((F.col("poll") == F.col("l.poll")) & (F.col("published_at") == F.col("l.published_at"))).withColumn("pct", F.greatest(F.lit(0.0), F.least(F.lit(100.0), "pct"))).drop("l").orderBy(F.desc("pct"), "candidate", "ordinal").limit(n)


def relevance_histogram(df: DataFrame, score: str = "relevance_score") -> DataFrame:
    low = F.least(F.floor(F.col(score) * 10 + 1e-9), F.lit(10)).cast("int")
    return df.where(F.col(score).isNotNull()).groupBy(low.alias("bucket")).agg(F.count("*").alias("n")).withColumn("label", F.concat((F.col("bucket") / 10).cast("decimal(3,1)").cast("string"), F.lit("-"), (F.least(F.col("bucket") + 1, F.lit(10)) / 10).cast("decimal(3,1)").cast("string")))


def cleanup_summary(df: DataFrame) -> DataFrame:
    """Totals of a clean-up: status before (``status``), demoted, duplicate_of."""
    was = F.col("status") == "irrelevant"
    return df.agg(F.count("*").alias("total"), F.count_if(was).alias("already"), F.count_if(~was & F.col("demoted")).alias("by_relevance"), F.count_if(~was & ~F.col("demoted") & F.col("duplicate_of").isNotNull()).alias("by_duplicate"), F.count_distinct("narrative_cluster_id").alias("clusters"))


def archive_summary(tiered: DataFrame) -> DataFrame:
    return tiered.groupBy("tier").agg(F.count("*").alias("n"), F.sum(F.when(F.col("tier") == "hot", 0).otherwise(F.octet_length(F.coalesce("content", F.lit(""))))).cast("long").alias("bytes_saved"))


def error_rollup(errors: DataFrame, now: Column) -> DataFrame:
    """Errors by tier and in all: total, in the last day, latest."""
    recent = F.col("at") >= now - F.make_dt_interval(days=F.lit(1))
    return errors.rollup("tier").agg(F.count("*").alias("total"), F.count_if(recent).alias("last_day"), F.max("at").alias("latest"))


def zero_relevance(df: DataFrame, n: int = 20) -> DataFrame:
    """Published rows without a relevance score: their number and the first ids."""
    bad = df.where(eligible() & (F.coalesce("relevance_score", F.lit(0.0)) <= 0))
    ids = bad.orderBy("ordinal").limit(n).agg(F.array_sort(F.collect_list("ordinal")).alias("first_rows"))
    return bad.agg(F.count("*").alias("n")).crossJoin(ids)


def run_rollup(runs: DataFrame) -> DataFrame:
    """Passes, rate and durations by provider and by task."""
    out = runs.groupingSets([("provider",), ("task",)], "provider", "task").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if("ok").alias("passed"), F.min(F.when(F.col("ok"), F.col("duration"))).alias("min_s"), F.max(F.when(F.col("ok"), F.col("duration"))).alias("max_s"))
    return out.select(F.when(F.col("g") == 1, "provider").otherwise("task").alias("kind"), F.coalesce("provider", "task").alias("name"), "n", "passed", places(F.col("passed") / F.col("n")).alias("rate"), "min_s", "max_s")


def usage(calls: DataFrame, most: int) -> DataFrame:
    """Calls per provider and day, and whether the day's limit is used up."""
    return calls.groupBy("provider", F.to_date("at").alias("day")).agg(F.count_if("ok").alias("n")).withColumn("exhausted", F.col("n") >= most)


def donor_summary(d: DataFrame) -> DataFrame:
    """Per candidate: number and amount, in all and by type of donor."""
    money = lambda c: F.sum(c).cast("decimal(28,2)")
    kind = lambda k: F.when(F.col("donor_type") == k, F.col("amount"))
    return d.groupBy("candidate").agg(F.count("*").alias("n"), money("amount").alias("amount"), F.count(kind("PF")).alias("n_pf"), money(kind("PF")).alias("amount_pf"), F.count(kind("PJ")).alias("n_pj"), money(kind("PJ")).alias("amount_pj"))


def sector_breakdown(d: DataFrame) -> DataFrame:
    """Company donations by candidate and sector, and each candidate's total."""
    pj = d.where(F.col("donor_type") == "PJ")
    return pj.rollup("candidate", "sector").agg(F.sum("amount").cast("decimal(28,2)").alias("amount"), F.count_distinct("donor").alias("donors")).where("candidate IS NOT NULL")


def totals_by_candidate(d: DataFrame, amounts: Sequence[str]) -> DataFrame:
    return d.groupBy("candidate").agg(F.count("*").alias("n"), *(F.sum(a).cast("decimal(28,2)").alias(a) for a in amounts))


def transparency(amendments: DataFrame, flags: DataFrame, order: str = "paid") -> DataFrame:
    """One row per candidate of ``flags`` with the sums of amendments, by any column."""
    return flags.join(amendments, "candidate", "left").fillna(0, subset=["n"]).orderBy(F.col(order).desc_nulls_last(), "candidate")


def coverage(positions: DataFrame) -> DataFrame:
    """Share of unknown positions by topic and in all (topic null)."""
    unknown = F.coalesce("stance", F.lit("unknown")) == "unknown"
    return positions.rollup("topic").agg(F.count("*").alias("n"), places(F.avg(unknown.cast("int"))).alias("unknown_share")).withColumn("needs_seeding", F.col("unknown_share") > 0.5)


