"""Composed jobs: the publishing pass, the narrative pass, the clean-up, and the flagship query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import gates as G
from tidewire.functions import scoring as M
from tidewire.operators import aggregates as A
from tidewire.operators import checks as V
from tidewire.operators import lifecycle as L
from tidewire.operators import similarity as K
from tidewire.plans import tables as T
from tidewire.session import stored


def consolidate(articles: DataFrame, rules: DataFrame, n: int = 500) -> DataFrame:
    """Keep-first by id, editorial rules, newest rows, contract check."""
    rows = G.block_reasons(L.keep_first(articles), rules).where("status <> 'irrelevant' AND block_reason IS NULL")
    return V.checked(L.newest(rows, n), V.article_rules())


def _clustered(rows: DataFrame, chosen: Column, reset: bool) -> DataFrame:
    """Cosine clusters (K1, K2) of the chosen rows and what is decided on them (K3). Other rows stay as they are; chosen
    ones without a cluster lose the one they had if ``reset``. Curated rows are neither demoted nor given a duplicate_of."""
    if "duplicate_of" not in rows.columns:
        rows = rows.withColumn("duplicate_of", F.lit(None).cast("string"))
    chosen = F.coalesce(chosen, F.lit(False))
    mine = rows.where(chosen).withColumnsRenamed({"duplicate_of": "_of", "narrative_cluster_id": "_cluster"})
    out = L.decide_clusters(mine.withColumn("narrative_cluster_id", F.lit(None).cast("string")), K.narrative_clusters(mine))
    new = F.when(F.col("status") != "curated", F.col("duplicate_of"))
    cluster = F.col("narrative_cluster_id") if reset else F.coalesce("narrative_cluster_id", "_cluster")
    out = out.withColumns({"duplicate_of": F.coalesce(new, "_of"), "narrative_cluster_id": cluster}).drop("_of", "_cluster")
    return out.select(*rows.columns).unionByName(rows.where(~chosen))


def narrative_pass(articles: DataFrame) -> DataFrame:
    """Cluster validated and curated rows only; those without a cluster are reset to null (K5)."""
    return _clustered(articles, F.col("status").isin("validated", "curated"), True)


def clean_up(articles: DataFrame) -> DataFrame:
    """Score all rows anew, demote what is not relevant (G4), then cluster what is left (K6). ``was`` is the status before,
    ``demoted`` whether relevance demotes the row; writing the result, or not, is up to the caller."""
    rows = articles.withColumn("was", F.col("status")).withColumn("summary_text", G.summary_text()).withColumn("relevance_signals", M.relevance_signals("summary_text")).withColumn("relevance_score", M.relevance_score())
    rows = rows.withColumn("demoted", F.coalesce(G.demoted("relevance_score", text="summary_text"), F.lit(False))).drop("summary_text")
    # written, as the clustering reads the rows several times and would score them anew each time
    rows = stored(rows.withColumn("status", F.when(F.col("demoted"), "irrelevant").otherwise(F.col("status"))), "scored")
    return _clustered(rows, F.coalesce("status", F.lit("")) != "irrelevant", False)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate, score, keep first and average the sentiment of articles by candidate and topic."""
    rows = G.relevance_gate(T.articles(spark, sf_dir), T.HIGH, T.CANDIDATE, T.CONTEXT, T.OFF, T.FOREIGN).withColumn("gate", G.whole("gate")).where("gate")
    rows = rows.withColumn("summary_text", G.summary_text()).withColumn("relevance_signals", M.relevance_signals("summary_text")).withColumn("relevance_score", M.relevance_score())
    return A.sentiment_by_topic(L.keep_first(rows)).orderBy("candidate", "topic")
