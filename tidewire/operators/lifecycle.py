"""Deduplication by key, merges, status changes, tiered retention and rankings.

Every table carries an ingest ordinal (``ordinal``); it decides which of equal rows is first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire import vocab
from tidewire.functions.gates import eligible
from tidewire.functions.text import article_ts, col, mapping


def keep_first(df: DataFrame, key: str = "id", ordinal: str = "ordinal") -> DataFrame:
    """First row of each key; rows with a null key all stay. One shuffle, combined before it by the window's top-1."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(ordinal))
    first = df.where(F.col(key).isNotNull()).withColumn("_n", rank).where("_n = 1").drop("_n")
    return first.unionByName(df.where(F.col(key).isNull()))


def new_rows(incoming: DataFrame, stored: DataFrame, key: str = "id", ordinal: str = "ordinal") -> DataFrame:
    """Incoming rows whose key is not stored yet, the first of each key."""
    return keep_first(incoming.where(F.col(key).isNotNull()), key, ordinal).join(stored.select(key), key, "left_anti")


def merge_lists(ours: DataFrame, theirs: DataFrame, key: str = "id", ordinal: str = "ordinal") -> DataFrame:
    """All of ours, then those of theirs with a new, non-empty key."""
    extra = theirs.where(F.coalesce(F.col(key), F.lit("")) != "").join(ours.select(key), key, "left_anti")
    return ours.unionByName(keep_first(extra, key, ordinal).select(ours.columns))


def merge_maps(ours: DataFrame, theirs: DataFrame, key: str, value: str) -> DataFrame:
    """Key-value tables; theirs overrides."""
    t = theirs.select(key, F.col(value).alias("_theirs"))
    return ours.join(t, key, "full").select(key, F.coalesce("_theirs", value).alias(value))


def accumulate_rules(rules: DataFrame, found: DataFrame) -> DataFrame:
    """Rule table with new rows of ``found`` (rule_kind, value)."""
    return rules.select("rule_kind", "value").union(found.select("rule_kind", "value")).distinct()


def retention_tier(now: Column, hot: int = 7, curated: int = 14, warm: int = 30) -> Column:
    """hot, warm or cold by days since publication; rows without that time are hot, whenever they were collected."""
    age = lambda d: F.col("published_at") >= now - F.make_dt_interval(days=F.lit(d))
    return F.when(F.col("published_at").isNull() | age(hot) | ((F.col("status") == "curated") & age(curated)), "hot").when(age(warm), "warm").otherwise("cold")


def apply_retention(df: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that remain, with the content of warm rows dropped; cold rows with their archive month)."""
    tiered = df.withColumn("tier", retention_tier(now))
    stay = tiered.where("tier <> 'cold'").withColumn("content", F.when(F.col("tier") == "hot", F.col("content")))
    return stay, tiered.where("tier = 'cold'").withColumn("archive_month", F.date_format("published_at", "yyyy-MM"))


def promote(df: DataFrame, now: Column, above: float = 0.8) -> DataFrame:
    """Validated rows of high prominence become curated, with a history entry; ``promoted`` tells which."""
    up = (F.col("status") == "validated") & (F.col("prominence_score") > above)
    entry = F.struct(F.lit("curator").alias("tier"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), F.lit("rules").alias("provider"), F.lit("promote").alias("action"), F.array(F.lit("status")).alias("changes"))
    return df.withColumn("promoted", up).withColumns({"edit_history": F.when(up, F.concat(F.coalesce("edit_history", F.slice(F.array(entry), 1, 0)), F.array(entry))).otherwise(F.col("edit_history")), "status": F.when(up, "curated").otherwise(F.col("status"))})


def unpublish(df: DataFrame, targets: DataFrame, target: str = "target") -> DataFrame:
    """Rows whose id or url (any case) is a target become irrelevant; ``unpublished`` tells which."""
    t = targets.select(F.lower(F.trim(target)).alias("_t"), F.lit(True).alias("_hit")).distinct()
    out = df.join(t, F.lower("id") == F.col("_t"), "left").withColumnRenamed("_hit", "_a").drop("_t")
    out = out.join(t, F.lower("url") == F.col("_t"), "left").withColumn("unpublished", F.coalesce("_a", "_hit", F.lit(False))).drop("_a", "_hit", "_t")
    return out.withColumns({"status": F.when(F.col("unpublished"), "irrelevant").otherwise(F.col("status")), "relevance_score": F.when(F.col("unpublished"), 0.0).otherwise(F.col("relevance_score"))})


def triage(df: DataFrame, limit: int) -> DataFrame:
    """Add ``outcome`` to gated rows (gate, block_reason, integrity): dropped_irrelevant, blocked, off_topic, rejected,
    annotate, or waiting for rows past the place of the last annotated one. The place is a top-k, not a window."""
    first = F.when(F.col("status") == "irrelevant", "dropped_irrelevant").when(F.col("block_reason").isNotNull(), "blocked").when(~F.col("gate"), "off_topic").when(F.col("integrity").isNotNull(), "rejected").otherwise("annotate")
    out = df.withColumn("outcome", first)
    last = out.where("outcome = 'annotate'").orderBy("ordinal").limit(limit).agg(F.max("ordinal").alias("_last"), F.count("*").alias("_n"))
    late = (F.col("_n") == limit) & (F.col("ordinal") > F.col("_last")) & F.col("outcome").isin("annotate", "rejected")
    return out.crossJoin(F.broadcast(last)).withColumn("outcome", F.when(late, "waiting").otherwise(F.col("outcome"))).drop("_last", "_n")


def newest(df: DataFrame, n: int = 500, time: str = "published_at", ordinal: str = "ordinal") -> DataFrame:
    """First ``n`` by time, rows without one last (a top-k per partition, then one merge)."""
    return df.orderBy(F.col(time).desc_nulls_last(), ordinal).limit(n)


def feed_order() -> list[Column]:
    return [(F.col("status") == "curated").desc(), F.coalesce("prominence_score", F.lit(0.0)).desc(), article_ts().desc_nulls_last(), F.col("ordinal").asc()]


def curated_feed(df: DataFrame, now: Column, hours: int = 24, n: int = 80) -> DataFrame:
    """Eligible rows of the last hours, or all eligible rows if there is none, in feed order."""
    rows = df.where(eligible())
    fresh = article_ts() >= now - F.make_dt_interval(hours=F.lit(hours))
    any_fresh = rows.agg(F.coalesce(F.max(fresh), F.lit(False)).alias("_any"))
    return rows.crossJoin(F.broadcast(any_fresh)).where(fresh | ~F.col("_any")).drop("_any").orderBy(*feed_order()).limit(n)


def weekly_top(df: DataFrame, now: Column, days: int = 7, n: int = 10) -> DataFrame:
    return df.where(eligible() & (article_ts() >= now - F.make_dt_interval(days=F.lit(days)))).orderBy(*feed_order()).limit(n)


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows of each group with their rank; Spark cuts each partition's groups before the shuffle."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


def canonical_order(cluster: str = "narrative_cluster_id") -> Column:
    """Struct whose least value marks the row that stands for its cluster."""
    category = F.coalesce(F.try_element_at(mapping(vocab.CATEGORY_ORDER), F.lower("source_category")), F.lit(99))
    return F.struct((F.col("status") != "curated").alias("a"), category.alias("b"), (F.coalesce(F.trim("summaries.pt"), F.lit("")) == "").alias("c"), (-F.length(F.coalesce("content", F.lit("")))).alias("d"), F.coalesce(F.date_format("collected_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("e"), F.col("ordinal").alias("f"))


def decide_clusters(df: DataFrame, clusters: DataFrame) -> DataFrame:
    """Attach clusters (id, narrative_cluster_id): the canonical row keeps its status, others become irrelevant with
    ``duplicate_of``, except curated ones."""
    rows = df.drop("narrative_cluster_id")
    # the order stands for the content, and only clustered rows meet by cluster, so neither texts nor nulls are shuffled there
    members = rows.select("id", canonical_order().alias("order")).join(clusters.hint("merge"), "id")
    best = members.where("narrative_cluster_id IS NOT NULL").groupBy(F.struct("narrative_cluster_id").alias("k")).agg(F.min_by("id", "order").alias("canonical")).select("k.narrative_cluster_id", "canonical")
    decided = clusters.join(best.hint("merge"), "narrative_cluster_id", "left")
    rows = rows.join(decided.hint("merge"), "id", "left")
    other = F.col("canonical").isNotNull() & (F.col("id") != F.col("canonical"))
    return rows.withColumns({"duplicate_of": F.when(other, F.col("canonical")), "status": F.when(other & (F.col("status") != "curated"), "irrelevant").otherwise(F.col("status"))}).drop("canonical")


def page(df: DataFrame, order: Sequence[Column], number: int, size: int = 20) -> DataFrame:
    """One page of an ordered table, counted from 0."""
    return df.orderBy(*order).offset(number * size).limit(size)


def apply_annotations(df: DataFrame, notes: DataFrame) -> DataFrame:
    """Merge annotations (id, summary_pt, summary_en, topics, candidates, parse_error) into raw rows."""
    n = notes.select("id", *(F.col(c).alias(f"_{c}") for c in ("summary_pt", "summary_en", "topics", "candidates", "parse_error")), F.lit(True).alias("_noted"))
    out = df.join(n, "id", "left")
    hit = F.coalesce("_noted", F.lit(False)) & (F.col("status") == "raw")
    pt, en = F.coalesce("_summary_pt", "_summary_en", "title"), F.coalesce("_summary_en", "_summary_pt", "title")
    both = F.col("_summary_pt").isNotNull() & F.col("_summary_en").isNotNull()
    out = out.withColumns({
        "summaries": F.when(hit, F.struct(pt.alias("pt"), en.alias("en"))).otherwise(F.col("summaries")),
        "topics": F.when(hit, F.col("_topics")).otherwise(F.col("topics")),
        "candidates_mentioned": F.when(hit, F.col("_candidates")).otherwise(F.col("candidates_mentioned")),
        "confidence_score": F.when(hit, F.when(F.col("_parse_error"), 0.6).when(both, 1.0).otherwise(0.8)).otherwise(F.col("confidence_score")),
        "annotated": hit,
    })
    return out.drop(*(c for c in out.columns if c.startswith("_")))


def approve_drafts(base: DataFrame, drafts: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Copy the fields of approved drafts onto the base."""
    d = drafts.select(*keys, *(F.col(f).alias(f"_{f}") for f in fields), F.lit(True).alias("_ok"))
    out = base.join(d, list(keys), "left")
    return out.withColumns({f: F.when(F.col("_ok"), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}).drop("_ok", *(f"_{f}" for f in fields))


def diff_fields(base: DataFrame, draft: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per key and field that differ (null-safe), for keys on both sides."""
    d = draft.select(*keys, *(F.col(f).cast("string").alias(f"_{f}") for f in fields))
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("old"), F.col(f"_{f}").alias("new")) for f in fields))
    return base.join(d, list(keys)).select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.*").where("NOT old <=> new")


def fall_back(new: DataFrame, old: DataFrame, keys: Sequence[str], value: str, valid: Column) -> DataFrame:
    """Old table's keys with the new value where valid, else the old one."""
    n = new.where(valid).select(*keys, col(value).alias("_new"))
    return old.join(n, list(keys), "left").withColumn("from_new", F.col("_new").isNotNull()).withColumn(value, F.coalesce("_new", value)).drop("_new")
