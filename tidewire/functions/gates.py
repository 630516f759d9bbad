"""Predicates: keyword counts, relevance gates, content checks, editorial rules, search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire import vocab
from tidewire.functions.text import C, clean_list, col, norm_text, split_words, words


def keyword_hits(text: C, keywords: Sequence[str]) -> Column:
    """Number of distinct keywords that the text contains."""
    t = col(text)
    return F.size(F.filter(words(keywords), lambda k: F.contains(t, k)))


def gate_counts(title: C = "title", content: C = "content") -> dict[str, Column]:
    """Hit counts of the five vocabularies, for ``withColumns``; the text is normalised once if materialised first."""
    t = F.trim(F.concat_ws(" ", norm_text(F.coalesce(col(title), F.lit(""))), F.substring(norm_text(F.coalesce(col(content), F.lit(""))), 1, 1500)))
    return {"gate_text": t}


def relevance_gate(df: DataFrame, high: Sequence[str] = vocab.HIGH_SIGNAL, candidate: Sequence[str] = vocab.CANDIDATE_WORDS, context: Sequence[str] = vocab.CONTEXT, off: Sequence[str] = vocab.OFF_TOPIC, foreign: Sequence[str] = vocab.INTERNATIONAL) -> DataFrame:
    """Add the five counts and ``gate``, whether a row goes on to annotation."""
    df = df.withColumns(gate_counts())
    hits = {"n_high": high, "n_candidate": candidate, "n_context": context, "n_off": off, "n_foreign": foreign}
    df = df.withColumns({k: keyword_hits("gate_text", v) for k, v in hits.items()})
    gate = F.expr("""CASE WHEN coalesce(trim(title), '') = '' THEN false
        WHEN n_foreign >= 2 AND n_context = 0 AND n_candidate = 0 AND n_high = 0 THEN false
        WHEN n_off >= 2 AND n_high = 0 AND n_candidate = 0 THEN false
        WHEN n_high >= 2 THEN true
        WHEN n_high >= 1 AND (n_candidate >= 1 OR n_context >= 1) THEN true
        WHEN n_candidate >= 1 AND n_off < 2 THEN true
        WHEN lower(trim(source_category)) IN ('party', 'institutional') AND n_high >= 1 THEN true
        ELSE false END""")
    return df.withColumn("gate", gate).drop("gate_text")


def whole(condition: C) -> Column:
    """A condition for a column that a filter then reads: it has a part that is not deterministic (and always true), so
    the optimizer keeps the filter above the columns it stands on instead of computing them again inside it."""
    return col(condition) & (F.monotonically_increasing_id() >= 0)


def summary_text() -> Column:
    return norm_text(F.concat_ws(" ", F.coalesce("summaries.pt", F.lit("")), F.coalesce("summaries.en", F.lit(""))))


def relevant_after(score: C = "relevance_score", context: Sequence[str] = vocab.CONTEXT, least: float = vocab.RELEVANT, text: C | None = None) -> Column:
    """Decision from annotated fields: any candidate, else the election topic with context, else the score.

    ``text`` is a column that holds ``summary_text()``: else it is normalised again for each keyword.
    """
    text = summary_text() if text is None else text
    election = F.array_contains(clean_list("topics", lower=True), "eleicoes")
    return F.when(F.size(clean_list("candidates_mentioned")) > 0, True).when(election, keyword_hits(text, context) > 0).otherwise(col(score) >= least)


def demoted(score: C = "relevance_score", least: float = vocab.RELEVANT, text: C | None = None) -> Column:
    """Rows that a batch clean-up makes irrelevant."""
    election = F.array_contains(clean_list("topics", lower=True), "eleicoes")
    return (F.col("status") != "curated") & ~relevant_after(score, least=least, text=text) & (F.size(clean_list("candidates_mentioned")) < 2) & ~election


def is_paywall(content: C, phrases: Sequence[str] = vocab.PAYWALL) -> Column:
    return keyword_hits(F.lower(F.substring(F.coalesce(col(content), F.lit("")), 1, 800)), phrases) >= 2


def clear_paywall(df: DataFrame, content: str = "content", phrases: Sequence[str] = vocab.PAYWALL) -> DataFrame:
    """Blank the content of paywalled rows; ``cleared`` tells which."""
    return df.withColumn("cleared", is_paywall(content, phrases)).withColumn(content, F.when(F.col("cleared"), F.lit("")).otherwise(F.col(content)))


def integrity(content: C, title: C, blocked: Sequence[str] = vocab.BLOCKED_PAGE) -> Column:
    """First reason why a content is unusable, or null."""
    s = F.trim(F.coalesce(col(content), F.lit("")))
    printable = F.length(F.regexp_replace(s, r"\p{C}", "")) / F.greatest(F.lit(1), F.length(s))
    return (
        F.when(s == "", "empty")
        .when(s == F.trim(F.coalesce(col(title), F.lit(""))), "equals_title")
        .when((F.length(s) < 120) & (F.size(split_words(s)) < 15), "too_short")
        .when(~s.rlike(r"\p{L}"), "no_letters")
        .when(~s.rlike("[.!?]"), "no_sentence")
        .when(printable < 0.8, "unprintable")
        .when(keyword_hits(F.lower(F.substring(s, 1, 600)), blocked) > 0, "blocked_page")
        .when(is_paywall(s), "paywall")
    )


def block_reasons(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``block_reason``: the first editorial rule (rule_kind, value) that fits a row, or null.

    Ids and sources are equi-joins. The substring rules are two arrays in every task while their table is small, which is
    counted first; beyond that the different urls and titles that contain one are found by an index of the rules.
    """
    from tidewire.operators.matching import containing, fits

    def of(kind: str) -> DataFrame:
        return rules.where(F.col("rule_kind") == kind).select("value").distinct()

    ids, sources = of("irrelevant_article_ids").select(F.col("value").alias("id"), F.lit(True).alias("_id")), of("blocked_sources").select(norm_text("value").alias("_src"), F.lit(True).alias("_source")).distinct()
    out = df.join(ids, "id", "left").join(sources, norm_text(F.col("source")) == F.col("_src"), "left")
    url, title = F.lower(F.coalesce("url", F.lit(""))), norm_text(F.coalesce("title", F.lit("")))
    urls, titles = of("blocked_url_substrings").select(F.lower("value").alias("value")).where("value <> ''"), of("blocked_title_keywords").select(norm_text("value").alias("value")).where("value <> ''")
    if fits(urls.unionByName(titles)):
        parts = urls.agg(F.collect_set("value").alias("_urls")).crossJoin(titles.agg(F.collect_set("value").alias("_titles")))
        out = out.crossJoin(F.broadcast(parts))
        in_url, in_title = F.exists("_urls", lambda u: F.contains(url, u)), F.exists("_titles", lambda t: F.contains(title, t))
    else:
        out = out.withColumns({"_url": url, "_title": title})
        hit = lambda name, found: found.select(F.col("text").alias(name), F.lit(True).alias(f"{name}_hit"))
        out = out.join(hit("_url", containing(out, urls, "_url")).hint("merge"), "_url", "left").join(hit("_title", containing(out, titles, "_title")).hint("merge"), "_title", "left")
        in_url, in_title = F.col("_url_hit"), F.col("_title_hit")
    reason = F.when(F.col("_id"), "id").when(F.col("_source"), "source").when(in_url, "url").when(in_title, "title")
    return out.withColumn("block_reason", reason).select(*df.columns, "block_reason")


def norm_rules(rules: DataFrame) -> DataFrame:
    """Rules trimmed and normalised by kind, unique."""
    v = F.trim("value")
    value = F.when(F.col("rule_kind") == "blocked_title_keywords", norm_text(v)).when(F.col("rule_kind").isin("blocked_url_substrings", "irrelevant_article_ids"), F.lower(v)).otherwise(v)
    return rules.select("rule_kind", value.alias("value")).where("value <> ''").distinct()


def needs_annotation() -> Column:
    return (F.col("status") == "raw") & (F.coalesce(F.trim("summaries.pt"), F.lit("")) == "") & (F.coalesce(F.trim("summaries.en"), F.lit("")) == "")


def eligible() -> Column:
    return F.col("status").isin("validated", "curated")


def search(df: DataFrame, query: str, fields: Sequence[str], order: Sequence[Column], most: int = 20) -> DataFrame:
    """Rows in which every term of the query is in one of the fields, newest first; none for a query without a term."""
    terms = query.lower().split()
    keep = F.lit(bool(terms))
    for term in terms:
        found = F.lit(False)
        for f in fields:
            found = found | F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))).contains(term)
        keep = keep & found
    return df.where(keep).orderBy(*order).limit(most)


def party_reference(text: C) -> Column:
    """Whole party names, or phrases of membership; ambiguous words count only beside a party marker."""
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"\s+", " "))
    names = lambda terms: r"(?U)\b(?:" + "|".join(terms) + r")\b"
    plain = [p for p in vocab.PARTY_TERMS if p not in vocab.AMBIGUOUS_PARTY_TERMS]
    said = t.rlike("(?U)" + "|".join(f"(?:{p})" for p in vocab.AFFILIATIONS))
    return said | t.rlike(names(plain)) | (t.rlike("(?U)" + vocab.PARTY_MARKER) & t.rlike(names(vocab.AMBIGUOUS_PARTY_TERMS)))


def option_failures(pt: C, en: C) -> Column:
    """Names of the quality checks that an option text fails."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"\s+", " "))
    p, e = flat(pt), flat(en)
    n = F.size(split_words(pt))
    begins = lambda t, openings: F.exists(words(openings), lambda o: F.startswith(t, o))
    broken = "(?U)" + "|".join(f"(?:{x})" for x in vocab.BROKEN)
    return F.array_compact(F.array(
        F.when((n < 15) | (n > 80), "length"),
        F.when(~begins(p, vocab.OPENINGS), "first_person"),
        F.when((keyword_hits(p, vocab.NAME_TERMS) > 0) | (keyword_hits(e, vocab.NAME_TERMS) > 0), "candidate_reference"),
        F.when(party_reference(pt) | party_reference(en), "party_reference"),
        F.when(keyword_hits(p, vocab.EVENT_TERMS) > 0, "news_event"),
        F.when(begins(p, vocab.BOILERPLATE_PT) | begins(e, vocab.BOILERPLATE_EN), "boilerplate"),
        F.when(p.rlike(broken) | e.rlike(broken), "broken_continuation"),
    ))


def position_ok(pt: C, en: C, rejected: Sequence[str] = ("null", "none")) -> Column:
    n = F.size(split_words(pt))
    p, e = F.trim(F.lower(col(pt))), F.trim(F.lower(col(en)))
    return F.coalesce((n >= 8) & (n <= 80) & ~p.isin(*rejected) & ~e.isin(*rejected), F.lit(False))


def known_position() -> Column:
    return F.col("position_type").isin(*vocab.KNOWN_TYPES) & F.col("stance").isin(*vocab.STANCES)


def unseeded() -> Column:
    return (F.coalesce("stance", F.lit("unknown")) == "unknown") & (F.coalesce("position_type", F.lit("unknown")) == "unknown")
