"""Scores: relevance signals, prominence, confidence, stances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire import vocab
from tidewire.functions.gates import eligible, keyword_hits, summary_text
from tidewire.functions.text import C, article_ts, clean_list, col, mapping, places, words


def relevance_signals(text: C | None = None) -> Column:
    """Struct of the four signals of an article row.

    ``text`` is a column that holds ``summary_text()``: else it is normalised again for each keyword.
    """
    cands, topics = clean_list("candidates_mentioned", lower=True), clean_list("topics", lower=True)
    text = summary_text() if text is None else text
    category = F.lower(F.trim("source_category"))
    candidate = F.when(F.size(cands) > 0, 0.4 + F.least(F.lit(0.2), F.size(cands) * 0.1)).otherwise(0.0)
    topic = F.when(F.array_contains(topics, "eleicoes"), 0.25).otherwise(0.0) + F.least(F.lit(0.15), F.size(F.array_intersect(topics, words(vocab.POLITICAL_TOPICS))) * 0.05)
    keyword = F.least(F.lit(0.15), (keyword_hits(text, vocab.HIGH_SIGNAL) + keyword_hits(text, vocab.CANDIDATE_WORDS)) * 0.05)
    source = F.when(category.isin("party", "institutional"), 0.10).when(category == "politics", 0.05).otherwise(0.0)
    return F.struct(*(places(c).alias(n) for n, c in (("candidate_signal", candidate), ("topic_signal", topic), ("keyword_signal", keyword), ("source_signal", source))))


def relevance_score(signals: str = "relevance_signals") -> Column:
    total = sum((F.col(f"{signals}.{n}") for n in ("topic_signal", "keyword_signal", "source_signal")), F.col(f"{signals}.candidate_signal"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), places(total)))


def prominence(now: Column) -> Column:
    """Weighted recency, confidence, relevance, source, mentions, topics and sentiment of an article row."""
    age = (now.cast("long") - article_ts().cast("long")) / 3600
    recency = F.when(article_ts().isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.greatest(age, F.lit(0.0)) / 36)))
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    confidence = clamp(F.coalesce("confidence_score", F.when(eligible(), 0.65).otherwise(0.4)))
    both = (F.coalesce(F.trim("summaries.pt"), F.lit("")) != "") & (F.coalesce(F.trim("summaries.en"), F.lit("")) != "")
    score = F.coalesce("relevance_score", F.lit(0.0))
    relevance = F.when((score <= 0) & eligible() & both, 0.65).otherwise(clamp(score))
    source = F.coalesce(F.try_element_at(mapping(vocab.CATEGORY_WEIGHT), F.col("source_category")), F.lit(vocab.OTHER_CATEGORY_WEIGHT))
    n = F.size(clean_list("candidates_mentioned"))
    t = F.size(clean_list("topics"))
    total = 0.34 * recency + 0.22 * confidence + 0.16 * relevance + 0.08 * source + 0.08 * F.least(F.lit(1.0), n / F.lit(3)) + 0.06 * F.least(F.lit(1.0), t / F.lit(4)) + 0.06 * clamp(F.abs(F.coalesce("sentiment_score", F.lit(0.0))))
    edited = F.coalesce(F.exists("edit_history", lambda e: (e.tier == "editor") & (e.action == "validated")), F.lit(False))
    total = total + F.when(F.trim("narrative_cluster_id") != "", 0.04).otherwise(0.0) + F.when(edited, 0.03).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), places(total)))


def confidence_ladder(pt: str = "summary_pt", en: str = "summary_en", error: str = "parse_error") -> Column:
    """1.0 for two real summaries, 0.6 after a parse error, else 0.8."""
    both = (F.coalesce(F.trim(pt), F.lit("")) != "") & (F.coalesce(F.trim(en), F.lit("")) != "")
    return F.when(F.col(error), 0.6).when(both, 1.0).otherwise(0.8)


def stance_weight(c: str | Column) -> Column:
    return F.try_element_at(mapping(vocab.STANCES), col(c))
