"""Contracts of rows and tables, and pipeline health."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire import vocab


def violations(rules: Mapping[str, Column]) -> Column:
    """Names of the rules that a row breaks; a rule that is null counts as broken."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items())))


def article_rules() -> dict[str, Column]:
    return {
        "id": F.col("id").rlike("^[0-9a-f]{16}$"),
        "url": F.col("url").rlike("^https?://"),
        "title": F.length("title") > 0,
        "source": F.length("source") > 0,
        "published_at": F.col("published_at").isNotNull(),
        "category": F.col("source_category").isin(*vocab.CATEGORIES),
        "status": F.col("status").isin(*vocab.STATUSES),
        "relevance": F.coalesce(F.col("relevance_score").between(0, 1), F.lit(True)),
    }


def poll_rules(institutes: Sequence[str] = vocab.INSTITUTES) -> dict[str, Column]:
    return {
        "id": F.col("id").rlike("^[0-9a-f]{16}$"),
        "institute": F.col("institute").isin(*institutes),
        "published_at": F.col("published_at").isNotNull(),
        "type": F.col("type").isin("estimulada", "espontanea"),
        "results": F.size("results") > 0,
        "pct": F.forall("results", lambda r: r.pct.between(0, 100)),
    }


def quiz_rules() -> dict[str, Column]:
    return {"option_id": F.col("option_id").isin(*vocab.OPTION_IDS), "weight": F.col("weight").between(-3, 3), "text": F.length("text_pt") > 0, "options": F.col("n_options").between(2, 6)}


def checked(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add ``violations`` and ``first_error``; rows stay."""
    return df.withColumn("violations", violations(rules)).withColumn("first_error", F.get("violations", F.lit(0)))


def contract_counts(df: DataFrame) -> DataFrame:
    return df.select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def must_hold(df: DataFrame, rule: Column, message: str) -> DataFrame:
    """The table, or a failure of the job at the first row that breaks the rule."""
    return df.withColumn("_ok", F.assert_true(rule, message)).where("_ok IS NULL").drop("_ok")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that are missing or not unique."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNull() | (F.col("n") > 1))


def valid_poll_rows(results: DataFrame) -> DataFrame:
    return results.where(F.col("published_at").isNotNull() & (F.length("institute") > 0) & (F.length("candidate") > 0) & F.col("pct").between(0, 100) & ~F.isnan("pct"))


def freshness(outputs: DataFrame, limits: DataFrame, now: Column) -> DataFrame:
    """State of each expected output (name, minutes, required) from its newest time; a future time has age 0."""
    last = outputs.groupBy("name").agg(F.max("at").alias("at"), F.count("*").alias("rows"))
    out = limits.join(last, "name", "left")
    age = F.greatest(F.lit(0), F.floor((now.cast("long") - F.col("at").cast("timestamp").cast("long")) / 60)).cast("long")
    state = F.when(F.col("rows").isNull(), "missing").when(F.col("at").isNull(), "unknown").when(age > F.col("minutes"), "stale").otherwise("ok")
    return out.withColumns({"age_minutes": age, "state": state})


def overall(states: DataFrame, errors_last_day: DataFrame, zero_relevance: DataFrame, most: int = 25) -> DataFrame:
    """One row: error if a required output is missing, warning if stale, without scores or with many errors, else ok."""
    s = states.agg(F.count_if(F.col("required") & F.col("state").isin("missing", "unknown")).alias("missing"), F.count_if(F.col("state") == "stale").alias("stale"))
    out = s.crossJoin(errors_last_day.select(F.col("n").alias("errors"))).crossJoin(zero_relevance.select(F.col("n").alias("zero")))
    health = F.when(F.col("missing") > 0, "error").when((F.col("stale") > 0) | (F.col("zero") > 0) | (F.col("errors") >= most), "warning").otherwise("ok")
    return out.withColumn("health", health)


def sentiment_in_range(df: DataFrame) -> DataFrame:
    return must_hold(df, F.col("avg_score").between(-1, 1), "sentiment out of range")


