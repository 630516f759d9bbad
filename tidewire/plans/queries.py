"""Registered queries: each applies operators to whole tables; most have the same result in SQL.

A name begins with the ids of the operators of the survey that it exercises.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import vocab
from tidewire.functions import gates as G
from tidewire.functions import polls as P
from tidewire.functions import scoring as M
from tidewire.functions import text as X
from tidewire.operators import aggregates as A
from tidewire.operators import checks as V
from tidewire.operators import lifecycle as L
from tidewire.operators import options as O
from tidewire.operators import quiz as Z
from tidewire.operators import similarity as K
from tidewire.operators.first_wins import first_wins
from tidewire.plans import jobs
from tidewire.plans import tables as T
from tidewire.sources import annotations as N
from tidewire.sources import feeds as S
from tidewire.sources import pages as H

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NOW = f"TIMESTAMP '{T.NOW}'"
PLACES = "floor(({0}) * 10000 + 0.5 + 1e-6) / 10000"
ELIGIBLE = "status IN ('validated', 'curated')"


def query(sql: str | None = None, *tables: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            recursive = "RECURSIVE " if "WITH_RECURSIVE" in sql else ""
            body = sql.replace("WITH_RECURSIVE", "").strip()
            prefix = ", ".join(tables)
            ORACLES[f.__name__] = (f"WITH {recursive}{prefix}" + (", " if body.startswith("@") else " ") + body.lstrip("@")) if tables else body
        return f

    return add


def places(e: str, n: int = 4) -> str:
    return f"floor(({e}) * {10**n} + 0.5 + 1e-6) / {10**n}"


def lst(values) -> str:  # noqa: ANN001
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def norm(e: str) -> str:
    return f"trim(regexp_replace(translate(lower(regexp_replace(translate({e}, '{vocab.FOLD_FROM}', '{vocab.FOLD_TO}'), '[^\\x00-\\x7F]', '', 'g')), '_-', '  '), '\\s+', ' ', 'g'))"


def hits(text: str, keywords) -> str:  # noqa: ANN001
    return f"len(list_filter({lst(keywords)}, lambda k: contains({text}, k)))::INTEGER"


# ---- text functions ----


@query(f"""SELECT ordinal, {norm("title")} AS plain, lower(translate(title, '{vocab.FOLD_FROM}', '{vocab.FOLD_TO}')) AS no_marks,
  regexp_replace(trim(regexp_replace(lower(title), '\\s+', ' ', 'g')), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g') AS fingerprint FROM articles""", T.ARTICLES)
def f01_f02_f35_normal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.articles(spark, sf_dir).select("ordinal", X.norm_text("title").alias("plain"), X.norm_text_accents("title").alias("no_marks"), X.fingerprint("title").alias("fingerprint"))


@query("""SELECT ordinal, substr(sha256(url), 1, 16) AS article_id, substr(sha256(source || '_' || strftime(collected_at, '%Y-%m-%d')), 1, 16) AS poll_id,
  'cluster_' || substr(sha256(array_to_string(list_sort([url, title]), '')), 1, 8) AS cluster_id FROM articles""", T.ARTICLES)
def f03_f04_f05_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.articles(spark, sf_dir).select("ordinal", X.short_hash("url").alias("article_id"), X.poll_id("source", "collected_at").alias("poll_id"), X.cluster_id(F.array("url", "title")).alias("cluster_id"))


@query("SELECT ordinal, ts, strftime(collected_at, '%Y-%m-%dT%H:%M:%SZ')::TIMESTAMP AS parsed, NULL::TIMESTAMP AS bad FROM articles", T.ARTICLES)
def f06_f07_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = F.date_format("collected_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return T.articles(spark, sf_dir).select("ordinal", X.article_ts().alias("ts"), X.parse_ts(iso).alias("parsed"), X.parse_ts(F.concat(F.lit("x"), iso)).alias("bad"))


ALIAS_SQL = "CASE " + " ".join(f"WHEN {{0}} = '{a}' THEN '{v}'" for a, v in vocab.ALIASES.items()) + " END"


@query(f"""SELECT doc_id, n, CASE WHEN lower(trim(n)) IN ({", ".join(f"'{s}'" for s in vocab.SLUGS)}) THEN lower(trim(n)) ELSE {ALIAS_SQL.format(norm("n"))} END AS slug,
  array_to_string(list_transform(string_split(n, ' '), lambda w: upper(w[1]) || lower(substr(w, 2))), ' ') AS name
  FROM (SELECT doc_id, {lst([*vocab.ALIASES, "Lula", "Eduardo-Leite", "nobody"])}[doc_id % {len(vocab.ALIASES) + 3} + 1] AS n FROM documents)""")
def f08_f10_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.pick((*vocab.ALIASES, "Lula", "Eduardo-Leite", "nobody"), f"doc_id % {len(vocab.ALIASES) + 3}")
    return T.table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).select("doc_id", "n", X.canonical_candidate("n").alias("slug"), F.initcap("n").alias("name"))


def _first(e: str, aliases) -> str:  # noqa: ANN001
    return "coalesce(" + ", ".join([f"CASE WHEN {e} = '{a}' THEN '{v}' END" for a, v in aliases] + [f"CASE WHEN contains({e}, '{a}') THEN '{v}' END" for a, v in aliases]) + ")"


INSTITUTE_TEXTS = ("Datafolha", "Genial/Quaest ", "pesquisa  ATLAS intel", "CNT/MDA", "Vox", "meio/ideia 2026")
NAME_TEXTS = ("Lula", "o  presidente Lula", "Flávio Bolsonaro", "bolsonaro", "Ratinho Jr.", "Tarcísio")


@query(f"""SELECT event_id, CASE WHEN i IN ({", ".join(f"'{x}'" for x in vocab.INSTITUTES)}) THEN i ELSE coalesce({_first("lower(i)", vocab.INSTITUTE_ALIASES)}, i) END AS institute,
  {_first("lower(n)", vocab.POLL_ALIASES)} AS candidate FROM (SELECT event_id, trim(regexp_replace({lst(INSTITUTE_TEXTS)}[event_id % 6 + 1], '\\s+', ' ', 'g')) AS i,
  trim(regexp_replace({lst(NAME_TEXTS)}[user_id % 6 + 1], '\\s+', ' ', 'g')) AS n FROM events)""")
def f09_f11_poll_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "events").select("event_id", T.pick(INSTITUTE_TEXTS, "event_id % 6").alias("i"), T.pick(NAME_TEXTS, "user_id % 6").alias("n"))
    return rows.select("event_id", P.norm_institute("i").alias("institute"), P.poll_candidate("n").alias("candidate"))


@query("""SELECT event_id, CASE WHEN event_id % 3 < 2 THEN ts::DATE END AS day, (1000 + user_id)::INTEGER AS sample, (event_id % 12) / 10.0::DOUBLE + 1 AS margin,
  CASE WHEN user_id % 2 = 0 THEN 'espontanea' ELSE 'estimulada' END AS type, floor((event_id % 100)::DOUBLE * 100 + 0.5 + 1e-6) / 100 AS pct, 95.0::DOUBLE AS confidence,
  'BR-' || lpad((event_id % 10000)::VARCHAR, 4, '0') || '/2026' AS registration FROM events""")
def f12_to_f17_poll_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy/M/d")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "d-M-yyyy")).otherwise(F.lit("2024-13-45 e 01/02/2024"))
    text = F.concat(F.lit("Pesquisa de "), day, F.lit(", amostra de "), (1000 + F.col("user_id")).cast("string"), F.lit(" eleitores, margem de erro: "), F.regexp_replace(((F.col("event_id") % 12) / 10 + 1).cast("decimal(3,1)").cast("string"), "\\.", ","), F.lit(" p.p., nivel de confianca 95%, "), F.when(F.col("user_id") % 2 == 0, "Espontânea").otherwise("cartela"), F.lit(" BR-"), F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0"), F.lit("/2026"))
    rows = T.table(spark, sf_dir, "events").select("event_id", text.alias("t"), F.concat((F.col("event_id") % 100).cast("string"), F.lit(" %")).alias("p"))
    return rows.select("event_id", P.poll_date("t").alias("day"), P.sample_size("t").alias("sample"), P.margin_of_error("t").alias("margin"), P.poll_type("t").alias("type"), P.coerce_pct("p").alias("pct"), P.confidence_level("t").alias("confidence"), P.registration("t").alias("registration"))


@query(r"""SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')))::INTEGER AS n, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages""")
def f18_strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "pages").select("page_id", X.strip_html("html").alias("t")).select("page_id", F.length("t").alias("n"), F.md5("t").alias("digest"))


@query("""SELECT ordinal, array_to_string(list_filter(topics, lambda t: t IN ('eleicoes', 'saude')), ',') AS topics, array_to_string(candidates_mentioned, ',') AS candidates,
  len(candidates_mentioned)::INTEGER AS n_labels, len(stored_scores)::INTEGER AS n_scores FROM articles""", T.ARTICLES)
def f19_to_f23_lists_and_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    messy = F.flatten(F.transform("candidates_mentioned", lambda c: F.array(F.concat(F.lit(" "), c), c, F.lit(" "))))
    shouted = F.transform("topics", lambda t: F.concat(F.upper(t), F.lit("  ")))
    labels, scores = X.norm_labels("sentiment_per_candidate"), X.norm_scores(F.transform_values("sentiment_scores", lambda k, v: v.cast("string")))
    return T.articles(spark, sf_dir).select("ordinal", F.array_join(X.norm_topics(shouted, ("eleicoes", "saude")), ",").alias("topics"), F.array_join(X.canonical_candidates(X.clean_list(messy)), ",").alias("candidates"), F.size(labels).alias("n_labels"), F.size(scores).alias("n_scores"))


@query("""SELECT ordinal, CASE WHEN s >= 0.2 THEN 'positivo' WHEN s <= -0.2 THEN 'negativo' ELSE 'neutro' END AS label, CASE WHEN s > 0.3 THEN 'positive' WHEN s < -0.3 THEN 'negative' ELSE 'neutral' END AS band,
  CASE WHEN s >= 0.2 THEN 1.0::DOUBLE WHEN s <= -0.2 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS back, greatest(0.0::DOUBLE, least(1.0::DOUBLE, s)) AS clamped FROM (SELECT ordinal, sentiment_score AS s FROM articles)""", T.ARTICLES)
def f24_f25_f37_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("sentiment_score")
    return T.articles(spark, sf_dir).select("ordinal", X.score_to_label(s).alias("label"), X.display_band(s).alias("band"), X.label_to_score(X.score_to_label(s)).alias("back"), X.clamp01(s.cast("string")).alias("clamped"))


@query("""SELECT ordinal, coalesce(nullif(trim(summary_pt), ''), nullif(trim(summary_en), ''), nullif(trim(title), ''), '') AS pt, coalesce(nullif(trim(summary_en), ''), nullif(trim(summary_pt), ''), nullif(trim(title), ''), '') AS en,
  coalesce(confidence_score, 0.0) AS confidence FROM articles""", T.ARTICLES)
def f26_f41_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.norm_summaries("summaries.pt", "summaries.en", "title")
    return T.articles(spark, sf_dir).select("ordinal", s.pt.alias("pt"), s.en.alias("en"), X.zero_nulls("confidence_score")["confidence_score"].alias("confidence"))


@query("""SELECT event_id, props AS inner_json, regexp_extract(props, '"k": ([0-9]+)', 1)::INTEGER AS k, event_id % 4 = 3 AS was_broken FROM events""")
def f27_f28_f29_v07_annotation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    fence = F.when(F.col("event_id") % 4 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 4 == 3, F.concat(F.lit("Here it is: {broken "), "props", F.lit(" and so on"))).otherwise(F.col("props"))
    rows = T.table(spark, sf_dir, "events").select("event_id", "props", fence.alias("response"))
    out = N.parse_annotations(rows, "response", "struct<k:int>")
    return out.select("event_id", F.col("props").alias("inner_json"), F.col("parsed.k").alias("k"), (F.try_parse_json(X.fence_strip("response")).isNull()).alias("was_broken"))


@query("""SELECT event_id, event_type AS name, event_type || '?apikey=[REDACTED]&x=1' AS redacted FROM events""")
def f30_f31_partial_and_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"a": 1, "name": "'), "event_type", F.lit('", "b": [1,')).alias("j"), F.concat("event_type", F.lit("?apikey=ABCDEFGHIJKLMNOPQRSTUV&x=1")).alias("u"))
    return rows.select("event_id", N.partial_field(F.col("j"), "name").alias("name"), X.redact_secrets("u").alias("redacted"))


WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"


@query(f"""SELECT ordinal, CASE WHEN length(c) > 220 THEN rtrim(substr(c, 1, 220)) || '...' ELSE c END AS snippet, greatest(1, ceil(len(w) / 200.0))::INTEGER AS minutes,
  CASE WHEN len(w) <= 80 THEN trim(content) ELSE t || CASE WHEN regexp_matches(t, '[.!?]$') THEN '' ELSE '.' END END AS cut
  FROM (SELECT *, rtrim(array_to_string(w[1:80], ' '), ',;') AS t FROM (SELECT ordinal, content, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS c, {WORDS.format("content")} AS w FROM articles))""", T.ARTICLES)
def f32_f33_f36_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.articles(spark, sf_dir).select("ordinal", X.snippet("content", "summaries.pt", "title").alias("snippet"), X.reading_time("content").alias("minutes"), X.truncate_words("content").alias("cut"))


@query("""SELECT ordinal, trim(regexp_replace(regexp_replace('Apoia o candidato e ' || source, 'X', 'X'), '\\s+', ' ', 'g')) AS text FROM articles""", T.ARTICLES)
def f34_anonymise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.articles(spark, sf_dir).select("ordinal", X.anonymise(F.concat(F.lit("Apoia  Lula Eduardo Leite lula e "), "source"), ("lula", "eduardo leite")).alias("text"))


NAMES = {"a": ("the and", "de la"), "b": ("on the",), "c": ("entre", "eine")}


def _contains(e: str, words) -> str:  # noqa: ANN001
    return "(" + " OR ".join(f"contains({e}, '{w}')" for w in words) + ")"


@query(f"""SELECT ordinal, array_to_string(list_filter([{", ".join(f"CASE WHEN {_contains('p', w)} THEN '{k}' END" for k, w in NAMES.items())}], lambda x: x IS NOT NULL), ',') AS people,
  array_to_string(list_filter([{", ".join(f"CASE WHEN {_contains('lower(content)', w)} THEN '{k}' END" for k, w in NAMES.items())}], lambda x: x IS NOT NULL), ',') AS topics
  FROM (SELECT ordinal, content, lower(translate(content, '{vocab.FOLD_FROM}', '{vocab.FOLD_TO}')) AS p FROM articles)""", T.ARTICLES)
def f38_f39_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.articles(spark, sf_dir).select("ordinal", F.array_join(X.infer_candidates("content", NAMES), ",").alias("people"), F.array_join(X.classify_topics("content", NAMES), ",").alias("topics"))


@query(f"""SELECT ordinal, len(c)::INTEGER AS n, array_to_string(list_transform(c, lambda x: substr(x, 1, 500)), '|') AS paragraphs FROM (
  SELECT ordinal, (CASE WHEN len(h) > 0 THEN h ELSE p[1:10] END)[1:8] AS c FROM (SELECT ordinal, p, list_filter(p, lambda x: {_contains("lower(x)", ("from", "avec", "para"))}) AS h FROM (
  SELECT ordinal, list_filter(list_transform(regexp_split_to_array(replace(content, chr(10), chr(10) || chr(10)), '\\n\\s*\\n'), lambda x: trim(x)), lambda x: length(x) > 50) AS p FROM articles)))""", T.ARTICLES)
def f40_topic_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.topic_paragraphs(F.replace("content", F.lit("\n"), F.lit("\n\n")), ("from", "avec", "para"))
    return T.articles(spark, sf_dir).select("ordinal", c.alias("c")).select("ordinal", F.size("c").alias("n"), F.array_join("c", "|").alias("paragraphs"))


@query("""SELECT ordinal, trim(title) AS title, status, source_category, relevance_score, array_to_string(list_filter(topics, lambda t: t IN ('corrupcao', 'eleicoes', 'impostos', 'previdencia', 'privatizacao')), ',') AS topics,
  (('0x' || substr(sha256(source || ':' || status || ':favor:0'), 1, 8))::BIGINT % 4)::INTEGER AS variant FROM articles""", T.ARTICLES)
def f42_f43_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.articles(spark, sf_dir).withColumn("variant", X.variant("source", "status", F.lit("favor"), 0, 4)).withColumns(X.article_defaults())
    return out.select("ordinal", "title", "status", "source_category", "relevance_score", F.array_join("topics", ",").alias("topics"), "variant")


# ---- gates and scores ----

GATE_SQL = f"""gate AS (SELECT *, {hits("t", T.HIGH)} AS n_high, {hits("t", T.CANDIDATE)} AS n_candidate, {hits("t", T.CONTEXT)} AS n_context, {hits("t", T.OFF)} AS n_off, {hits("t", T.FOREIGN)} AS n_foreign
  FROM (SELECT *, trim({norm("title")} || ' ' || substr({norm("content")}, 1, 1500)) AS t FROM articles)),
gated AS (SELECT *, CASE WHEN coalesce(trim(title), '') = '' THEN false WHEN n_foreign >= 2 AND n_context = 0 AND n_candidate = 0 AND n_high = 0 THEN false WHEN n_off >= 2 AND n_high = 0 AND n_candidate = 0 THEN false
  WHEN n_high >= 2 THEN true WHEN n_high >= 1 AND (n_candidate >= 1 OR n_context >= 1) THEN true WHEN n_candidate >= 1 AND n_off < 2 THEN true WHEN source_category IN ('party', 'institutional') AND n_high >= 1 THEN true ELSE false END AS gate FROM gate)"""


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.relevance_gate(T.articles(spark, sf_dir), T.HIGH, T.CANDIDATE, T.CONTEXT, T.OFF, T.FOREIGN)


@query("SELECT ordinal, n_high, n_candidate, n_context, n_off, n_foreign, gate FROM gated", T.ARTICLES, GATE_SQL)
def g01_g02_relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("ordinal", "n_high", "n_candidate", "n_context", "n_off", "n_foreign", "gate")


SUMMARY = norm("coalesce(summary_pt, '') || ' ' || coalesce(summary_en, '')")
SIGNALS = f"""signals AS (SELECT *, CASE WHEN len(candidates_mentioned) > 0 THEN {places("0.4 + least(0.2, len(candidates_mentioned) * 0.1)")} ELSE 0 END AS candidate_signal,
  {places("CASE WHEN list_contains(topics, 'eleicoes') THEN 0.25 ELSE 0 END + least(0.15, len(list_intersect(topics, " + lst(vocab.POLITICAL_TOPICS) + ")) * 0.05)")} AS topic_signal,
  {places("least(0.15, (" + hits("st", vocab.HIGH_SIGNAL) + " + " + hits("st", vocab.CANDIDATE_WORDS) + ") * 0.05)")} AS keyword_signal,
  {places("CASE WHEN source_category IN ('party', 'institutional') THEN 0.10 WHEN source_category = 'politics' THEN 0.05 ELSE 0 END")} AS source_signal FROM (SELECT *, {SUMMARY} AS st FROM articles)),
scored AS (SELECT *, greatest(0.0, least(1.0, {places("candidate_signal + topic_signal + keyword_signal + source_signal")})) AS score FROM signals)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.articles(spark, sf_dir).withColumn("summary_text", G.summary_text()).withColumn("relevance_signals", M.relevance_signals("summary_text")).withColumn("score", M.relevance_score())


@query("SELECT ordinal, candidate_signal, topic_signal, keyword_signal, source_signal, score FROM scored", T.ARTICLES, SIGNALS)
def m01_m02_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("ordinal", "relevance_signals.*", "score")


RELEVANT = f"CASE WHEN len(candidates_mentioned) > 0 THEN true WHEN list_contains(topics, 'eleicoes') THEN {hits('st', vocab.CONTEXT)} > 0 ELSE score >= 0.3 END"


@query(f"""SELECT ordinal, {RELEVANT} AS relevant, status <> 'curated' AND NOT {RELEVANT} AND len(candidates_mentioned) < 2 AND NOT list_contains(topics, 'eleicoes') AS demoted FROM scored""", T.ARTICLES, SIGNALS)
def g03_g04_relevance_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("ordinal", G.relevant_after("score", text="summary_text").alias("relevant"), G.demoted("score", text="summary_text").alias("demoted"))


WALL = ("that", "there", "avec", "eine", "para")


@query(f"""SELECT ordinal, paywalled, CASE WHEN paywalled THEN 0 ELSE length(content) END::INTEGER AS n_left FROM (SELECT ordinal, content, {hits("lower(substr(content, 1, 800))", WALL)} >= 2 AS paywalled FROM articles)""", T.ARTICLES)
def g05_g06_paywall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.clear_paywall(T.articles(spark, sf_dir), phrases=WALL)
    return rows.select("ordinal", F.col("cleared").alias("paywalled"), F.length("content").alias("n_left"))


INTEGRITY = f"""integrity AS (SELECT *, CASE WHEN s = '' THEN 'empty' WHEN s = trim(title) THEN 'equals_title' WHEN length(s) < 120 AND len({WORDS.format("s")}) < 15 THEN 'too_short' WHEN NOT regexp_matches(s, '\\p{{L}}') THEN 'no_letters'
  WHEN NOT regexp_matches(s, '[.!?]') THEN 'no_sentence' WHEN length(regexp_replace(s, '\\p{{C}}', '', 'g')) / greatest(1, length(s)) < 0.8 THEN 'unprintable'
  WHEN {hits("lower(substr(s, 1, 600))", vocab.BLOCKED_PAGE)} > 0 THEN 'blocked_page' WHEN {hits("lower(substr(s, 1, 800))", vocab.PAYWALL)} >= 2 THEN 'paywall' END AS integrity FROM (SELECT *, trim(content) AS s FROM gated))"""


@query("SELECT ordinal, integrity FROM integrity", T.ARTICLES, GATE_SQL, INTEGRITY)
def g07_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.articles(spark, sf_dir).select("ordinal", G.integrity("content", "title").alias("integrity"))


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editorial rules taken from the documents themselves."""
    a = T.articles(spark, sf_dir)
    ids = a.where("ordinal % 50 = 0").select(F.lit("irrelevant_article_ids").alias("rule_kind"), F.col("id").alias("value"))
    sources = a.where("ordinal % 100 = 7").select(F.lit("blocked_sources").alias("rule_kind"), F.upper("source").alias("value"))
    urls = a.groupBy().agg(F.max("ordinal").alias("m")).select(F.lit("blocked_url_substrings").alias("rule_kind"), F.lit("src3.example.org/1").alias("value"))
    titles = urls.select(F.lit("blocked_title_keywords").alias("rule_kind"), F.lit("There-").alias("value"))
    return ids.union(sources).union(urls).union(titles)


RULES = f"""rules AS (SELECT 'irrelevant_article_ids' AS rule_kind, id AS value FROM articles WHERE ordinal % 50 = 0 UNION ALL SELECT 'blocked_sources', upper(source) FROM articles WHERE ordinal % 100 = 7
  UNION ALL SELECT 'blocked_url_substrings', 'src3.example.org/1' UNION ALL SELECT 'blocked_title_keywords', 'There-'),
blocked AS (SELECT *, CASE WHEN id IN (SELECT value FROM rules WHERE rule_kind = 'irrelevant_article_ids') THEN 'id' WHEN {norm("source")} IN (SELECT {norm("value")} FROM rules WHERE rule_kind = 'blocked_sources') THEN 'source'
  WHEN contains(lower(url), 'src3.example.org/1') THEN 'url' WHEN contains({norm("title")}, 'there') THEN 'title' END AS block_reason FROM articles)"""


@query("SELECT ordinal, block_reason, status <> 'irrelevant' AND block_reason IS NULL AS publishable FROM blocked", T.ARTICLES, RULES)
def g08_g12_j02_j03_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.block_reasons(T.articles(spark, sf_dir), _rules(spark, sf_dir))
    return out.select("ordinal", "block_reason", ((F.col("status") != "irrelevant") & F.col("block_reason").isNull()).alias("publishable"))


@query(f"""SELECT DISTINCT rule_kind, CASE rule_kind WHEN 'blocked_title_keywords' THEN {norm("value")} WHEN 'blocked_sources' THEN trim(value) ELSE lower(trim(value)) END AS value FROM
  (SELECT * FROM rules UNION ALL SELECT 'blocked_sources', source FROM articles WHERE status = 'irrelevant')""", T.ARTICLES, RULES)
def g09_g10_u04_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.articles(spark, sf_dir).where("status = 'irrelevant'").select(F.lit("blocked_sources").alias("rule_kind"), F.col("source").alias("value"))
    return G.norm_rules(L.accumulate_rules(_rules(spark, sf_dir), found))


@query("""SELECT ordinal, status = 'raw' AND coalesce(trim(summary_pt), '') = '' AND coalesce(trim(summary_en), '') = '' AS needs, status = 'irrelevant' AS hidden,
  status <> 'irrelevant' AND source_category = 'mainstream' AS in_feed, contains(title, 'the') OR contains(content, 'retion') AS found FROM articles""", T.ARTICLES)
def g11_g14_g15_g16_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.articles(spark, sf_dir).select("ordinal", G.needs_annotation().alias("needs"), (F.col("status") == "irrelevant").alias("hidden"), ((F.col("status") != "irrelevant") & (F.coalesce("source_category", F.lit("mainstream")) == "mainstream")).alias("in_feed"), (F.contains("title", F.lit("the")) | F.contains("content", F.lit("retion"))).alias("found"))


@query("""SELECT ordinal, title FROM articles WHERE (contains(lower(title), 'the') OR contains(lower(coalesce(summary_pt, '')), 'the')) AND (contains(lower(title), 'on') OR contains(lower(coalesce(summary_pt, '')), 'on'))
  ORDER BY published_at DESC NULLS LAST, ordinal LIMIT 20""", T.ARTICLES)
def g13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.search(T.articles(spark, sf_dir), "the ON", ("title", "summaries.pt"), (F.col("published_at").desc_nulls_last(), F.col("ordinal").asc())).select("ordinal", "title")


def _rx(words) -> str:  # noqa: ANN001
    return r"(^|[^\p{L}\p{N}_])(" + "|".join(words) + r")($|[^\p{L}\p{N}_])"


def _edges(pattern: str) -> str:
    """A pattern with word edges for an engine that knows them for ASCII only."""
    wide = pattern.replace(r"\b(\b[a-zéêãõ]{1,3}\b\s){3,}", r"(^|[^\p{L}\p{N}_])([a-zéêãõ]{1,3}\s){3,}")
    wide = re.sub(r"^\\b", lambda m: r"(^|[^\p{L}\p{N}_])", wide)
    wide = re.sub(r"\\b$", lambda m: r"($|[^\p{L}\p{N}_])", wide)
    return wide.replace(r"\b.*\b", r"($|[^\p{L}\p{N}_])(.*[^\p{L}\p{N}_])?").replace("'", "''")


def _party(e: str) -> str:
    plain = [p for p in vocab.PARTY_TERMS if p not in vocab.AMBIGUOUS_PARTY_TERMS]
    said = " OR ".join(f"regexp_matches({e}, '{_edges(p)}')" for p in vocab.AFFILIATIONS)
    return f"({said} OR regexp_matches({e}, '{_rx(plain)}') OR (regexp_matches({e}, '{_edges(vocab.PARTY_MARKER)}') AND regexp_matches({e}, '{_rx(vocab.AMBIGUOUS_PARTY_TERMS)}')))"


@query(f"""@t AS (SELECT ordinal, 'Defendo que ' || title AS t FROM articles),
p AS (SELECT ordinal, t, trim(regexp_replace(lower(t), '\\s+', ' ', 'g')) AS p, len({WORDS.format("t")}) AS n FROM t),
q AS (SELECT *, {_party("p")} AS party FROM p)
SELECT ordinal, array_to_string(list_filter([CASE WHEN n < 15 OR n > 80 THEN 'length' END, CASE WHEN {hits("p", vocab.NAME_TERMS)} > 0 THEN 'candidate_reference' END, CASE WHEN party THEN 'party_reference' END,
  CASE WHEN {hits("p", vocab.EVENT_TERMS)} > 0 THEN 'news_event' END, CASE WHEN {" OR ".join(f"regexp_matches(p, '{_edges(x)}')" for x in vocab.BROKEN)} THEN 'broken_continuation' END], lambda x: x IS NOT NULL), ',') AS failures, party, n >= 8 AND n <= 80 AS position_ok FROM q""", T.ARTICLES)
def g17_g18_g19_option_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.articles(spark, sf_dir).select("ordinal", F.concat(F.lit("Defendo que "), "title").alias("t"))
    return rows.select("ordinal", F.array_join(G.option_failures("t", "t"), ",").alias("failures"), G.party_reference("t").alias("party"), G.position_ok("t", "t").alias("position_ok"))


@query("SELECT topic, candidate, known, stance = 'unknown' AND position_type = 'unknown' AS unseeded, weight::INTEGER AS weight FROM weighted", T.POSITIONS)
def g20_g21_g22_m05_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.positions(spark, sf_dir).select("topic", "candidate", G.known_position().alias("known"), G.unseeded().alias("unseeded"), M.stance_weight("stance").alias("weight"))


AGE = f"(epoch({NOW}) - epoch(ts)) / 3600"
BOTH = "(coalesce(trim(summary_pt), '') <> '' AND coalesce(trim(summary_en), '') <> '')"
#: Rows with what articles may lack or repeat: scores, known categories and topics, clean names, cluster names.
ROUGH = """rough AS (SELECT * REPLACE (CASE WHEN ordinal % 7 > 0 THEN prominence_score END AS prominence_score, CASE WHEN ordinal % 9 > 0 THEN sentiment_score END AS sentiment_score,
  CASE WHEN ordinal % 4 = 0 THEN candidates_mentioned || [' lula ', '', 'lula'] ELSE candidates_mentioned END AS candidates_mentioned, CASE WHEN ordinal % 6 < 2 THEN topics || ['futebol', ' saude'] ELSE topics END AS topics,
  CASE ordinal % 8 WHEN 0 THEN 'blog' WHEN 1 THEN NULL WHEN 2 THEN 'POLITICS' ELSE source_category END AS source_category, CASE WHEN ordinal % 10 = 1 THEN ' ' ELSE narrative_cluster_id END AS narrative_cluster_id) FROM articles)"""
CLEAN = "list_distinct(list_filter(list_transform({0}, lambda x: trim(x)), lambda x: x <> ''))"


def _rough(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, o = T.articles(spark, sf_dir), F.col("ordinal")
    more = lambda c, cond, *values: F.when(cond, F.concat(c, F.array(*map(F.lit, values)))).otherwise(F.col(c))
    return a.withColumns({
        "prominence_score": F.when(o % 7 > 0, F.col("prominence_score")), "sentiment_score": F.when(o % 9 > 0, F.col("sentiment_score")),
        "candidates_mentioned": more("candidates_mentioned", o % 4 == 0, " lula ", "", "lula"), "topics": more("topics", o % 6 < 2, "futebol", " saude"),
        "source_category": F.when(o % 8 == 0, "blog").when(o % 8 == 1, None).when(o % 8 == 2, "POLITICS").otherwise(F.col("source_category")),
        "narrative_cluster_id": F.when(o % 10 == 1, " ").otherwise(F.col("narrative_cluster_id")),
    })


PROMINENCE = "0.34 * greatest(0.0, least(1.0, 1 - greatest(" + AGE + ", 0) / 36)) + 0.22 * coalesce(confidence_score, CASE WHEN " + ELIGIBLE + " THEN 0.65 ELSE 0.4 END) + 0.16 * CASE WHEN relevance_score <= 0 AND " + ELIGIBLE + " AND " + BOTH + " THEN 0.65 ELSE relevance_score END + 0.08 * CASE source_category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in vocab.CATEGORY_WEIGHT.items()) + " ELSE 0.6 END + 0.08 * least(1.0, len(" + CLEAN.format("candidates_mentioned") + ") / 3) + 0.06 * least(1.0, len(" + CLEAN.format("topics") + ") / 4) + 0.06 * abs(coalesce(sentiment_score, 0)) + CASE WHEN trim(narrative_cluster_id) <> '' THEN 0.04 ELSE 0 END + CASE WHEN edited AND tier = 'editor' AND action = 'validated' THEN 0.03 ELSE 0 END"


@query(f"SELECT ordinal, greatest(0.0, least(1.0, {places(PROMINENCE)}))::DOUBLE AS prominence, CASE WHEN ordinal % 10 = 0 THEN 0.6::DOUBLE WHEN {BOTH} THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM rough", T.ARTICLES, ROUGH)
def m03_m04_prominence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rough(spark, sf_dir).withColumn("parse_error", F.col("ordinal") % 10 == 0)
    return rows.select("ordinal", M.prominence(T.now()).alias("prominence"), M.confidence_ladder("summaries.pt", "summaries.en").alias("confidence"))


# ---- aggregates ----

SCORES = f"""cells AS (SELECT a.*, c.candidate, c.score FROM (SELECT *, unnest(CASE WHEN len(stored_scores) > 0 THEN stored_scores ELSE label_scores END) AS c FROM articles WHERE {ELIGIBLE}) a)"""


@query(f"""@t AS (SELECT candidate, score, unnest(CASE WHEN len(k) > 0 THEN k ELSE ['eleicoes'] END) AS topic FROM (SELECT *, list_filter(topics, lambda x: list_contains({lst(vocab.TOPICS)}, x)) AS k FROM cells))
SELECT candidate, topic, {places("avg(score)")} AS avg_score, count(*)::BIGINT AS n FROM t GROUP BY ALL""", T.ARTICLES, ROUGH, SCORES.replace("FROM articles", "FROM rough"))
def a01_a03_sentiment_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sentiment_in_range(A.sentiment_by_topic(_rough(spark, sf_dir)))


@query(f"""SELECT candidate, CASE WHEN source_category = 'social' THEN 'mainstream' ELSE source_category END AS category, {places("avg(score)")} AS avg_score, count(*)::BIGINT AS n FROM cells GROUP BY ALL""", T.ARTICLES, SCORES)
def a02_v03_sentiment_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sentiment_in_range(A.sentiment_by_category(T.articles(spark, sf_dir)))


@query(f"SELECT max(CASE WHEN {ELIGIBLE} THEN collected_at END) AS sentiment_at, max(published_at) AS quiz_at FROM articles", T.ARTICLES)
def a04_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.freshness(T.articles(spark, sf_dir))


@query(f"""SELECT ordinal, CASE WHEN len(s) > 0 THEN {places("list_avg(list_transform(s, lambda x: x.score))")} ELSE 0.0 END::DOUBLE AS sentiment FROM (SELECT ordinal, CASE WHEN len(stored_scores) > 0 THEN stored_scores ELSE label_scores END AS s FROM articles)""", T.ARTICLES)
def a05_article_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.articles(spark, sf_dir).select("ordinal", A.article_sentiment().alias("sentiment"))


WEEK = f"{ELIGIBLE} AND ts >= {NOW} - INTERVAL 7 DAY"


@query(f"""SELECT topic, count(*)::BIGINT AS n, {places("avg(coalesce(prominence_score, 0))")} AS avg_prominence, min(ordinal) AS first_seen FROM (SELECT *, unnest({CLEAN.format("topics")}) AS topic FROM rough WHERE {WEEK}) GROUP BY topic ORDER BY n DESC, first_seen, topic LIMIT 10""", T.ARTICLES, ROUGH)
def a06_trending_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.trending_topics(_rough(spark, sf_dir), T.now())


HIGHLIGHTS = f"""highlights AS (SELECT *, CASE WHEN n_recent > 0 AND n_recent > 1.25 * (n - n_recent) / 6.0 THEN 'rising' WHEN n - n_recent > 0 AND n_recent < 0.75 * (n - n_recent) / 6.0 THEN 'falling' ELSE 'stable' END AS trend FROM (
  SELECT candidate, count(*)::BIGINT AS n, {places("avg(coalesce(prominence_score, 0))")} AS avg_prominence, {places("avg(coalesce(sentiment_score, 0))")} AS avg_sentiment, count_if(ts >= {NOW} - INTERVAL 1 DAY)::BIGINT AS n_recent
  FROM (SELECT *, unnest({CLEAN.format("candidates_mentioned")}) AS candidate FROM rough WHERE {WEEK}) GROUP BY candidate))"""


@query("SELECT * FROM highlights", T.ARTICLES, ROUGH, HIGHLIGHTS)
def a07_t03_candidate_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.candidate_highlights(_rough(spark, sf_dir), T.now())


ORDER = "status = 'curated' DESC, coalesce(prominence_score, 0) DESC, ts DESC, ordinal"


@query(f"""@t AS (SELECT topic, count(*) AS n, min(ordinal) AS f FROM (SELECT *, unnest({CLEAN.format("topics")}) AS topic FROM rough WHERE {WEEK}) GROUP BY topic ORDER BY n DESC, f, topic LIMIT 10),
b AS (SELECT ordinal FROM rough WHERE {WEEK} ORDER BY {ORDER} LIMIT 10)
SELECT (SELECT count(*) FROM rough WHERE {WEEK})::BIGINT AS article_count, (SELECT string_agg(topic, ',' ORDER BY n DESC, f, topic) FROM t) AS topics,
  (SELECT string_agg(candidate || ':' || n || ':' || trend, ',' ORDER BY candidate) FROM highlights) AS candidates, (SELECT string_agg(ordinal::VARCHAR, ',' ORDER BY ordinal) FROM b) AS top_articles""", T.ARTICLES, ROUGH, HIGHLIGHTS)
def a08_w03_weekly_briefing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.weekly_briefing(_rough(spark, sf_dir), T.now())
    people = F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c.candidate, c.n.cast("string"), c.trend)), ",")
    return out.select("article_count", F.array_join("topics", ",").alias("topics"), people.alias("candidates"), F.array_join(F.transform("top_articles", lambda x: x.cast("string")), ",").alias("top_articles"))


@query(f"""@h AS (SELECT * FROM articles WHERE edited)
SELECT 'tier' AS kind, tier AS name, count(*)::BIGINT AS n FROM h GROUP BY tier UNION ALL SELECT 'action', action, count(*)::BIGINT FROM h GROUP BY action
UNION ALL SELECT 'field', f, count(*)::BIGINT FROM (SELECT unnest(CASE WHEN ordinal % 4 = 0 THEN ['status', 'title'] ELSE ['title'] END) AS f FROM h WHERE tier = 'editor') GROUP BY f
UNION ALL SELECT 'rows', 'low_confidence', count_if(confidence_score < 0.6)::BIGINT FROM articles UNION ALL SELECT 'rows', 'low_relevance', count_if({ELIGIBLE} AND relevance_score < 0.7)::BIGINT FROM articles""", T.ARTICLES)
def a09_editor_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.editor_audit(T.articles(spark, sf_dir))


@query(f"SELECT published_at::DATE AS day, candidate, {places('avg(pct)', 2)} AS avg_pct FROM polls GROUP BY ALL", T.POLLS)
def a10_v06_poll_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.poll_series(V.valid_poll_rows(T.poll_results(spark, sf_dir)))


@query("SELECT candidate, arg_min(name, ordinal) AS name, string_agg(DISTINCT institute, ',' ORDER BY institute) AS institutes FROM polls GROUP BY candidate", T.POLLS)
def a11_a12_poll_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.poll_results(spark, sf_dir)
    lists = p.groupBy("candidate").agg(F.array_join(F.array_sort(F.collect_set("institute")), ",").alias("institutes"))
    return A.poll_names(p).join(lists, "candidate")


DAILY = "daily AS (SELECT institute, type, published_at, poll, candidate, avg(pct) AS pct FROM polls GROUP BY ALL)"


@query(f"SELECT institute, type, published_at, candidate, {places('pct - lag(pct) OVER (PARTITION BY institute, candidate, type ORDER BY published_at, poll)', 2)} AS variation FROM daily", T.POLLS, DAILY)
def a13_poll_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = T.poll_results(spark, sf_dir).groupBy("institute", "type", "published_at", "poll", "candidate").agg(F.avg("pct").alias("pct"))
    return A.poll_variation(daily).select("institute", "type", "published_at", "candidate", "variation")


DIVERGENCE = f"divergence AS (SELECT topic, count(*)::BIGINT AS n_known, CASE WHEN count(*) >= 2 THEN {places('(max(weight) - min(weight)) / 6.0')} ELSE 0.0 END::DOUBLE AS divergence FROM weighted WHERE known GROUP BY topic)"


@query("SELECT * FROM divergence", T.POSITIONS, DIVERGENCE)
def a14_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.divergence(T.positions(spark, sf_dir))


def _scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = T.positions(spark, sf_dir)
    options = p.where(G.known_position()).select("topic", "candidate", M.stance_weight("stance").alias("weight"), F.lit("opt_a").alias("option_id"))
    a = T.answers(spark, sf_dir)
    return a, options, Z.affinity(a, options, p.select("candidate").distinct())


@query("SELECT user_id, candidate, n_topics::INTEGER AS n_topics, affinity FROM scores", T.POSITIONS, T.ANSWERS)
def a15_j08_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)[2].withColumn("n_topics", F.col("n_topics").cast("int"))


@query(f"""@best AS (SELECT user_id, candidate FROM scores QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY affinity DESC, candidate) <= 3),
cell AS (SELECT b.user_id, b.candidate, a.topic, coalesce({places("(1 - abs(a.weight - w) / 6.0::DOUBLE) * 100", 2)}, 0.0) AS agree FROM best b JOIN answers a USING (user_id) LEFT JOIN options o ON o.topic = a.topic AND o.candidate = b.candidate)
SELECT user_id, candidate, coalesce(max(CASE WHEN topic = 'Brand#11' THEN agree END), 0.0)::DOUBLE AS "Brand#11", coalesce(max(CASE WHEN topic = 'Brand#23' THEN agree END), 0.0)::DOUBLE AS "Brand#23" FROM cell GROUP BY ALL""", T.POSITIONS, T.ANSWERS)
def a16_radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, options, scores = _scores(spark, sf_dir)
    return Z.radar(a, options, scores, ("Brand#11", "Brand#23"))


@query("""@r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY affinity DESC, candidate) AS k FROM scores),
two AS (SELECT user_id, max(affinity) AS first, min(affinity) AS second FROM r WHERE k <= 2 GROUP BY user_id), n AS (SELECT user_id, count(*)::BIGINT AS n_answered FROM answers GROUP BY user_id)
SELECT user_id, first, second, n_answered, n_answered >= 15 AND first - second >= 20 AS stop FROM two JOIN n USING (user_id)""", T.POSITIONS, T.ANSWERS)
def a17_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _, scores = _scores(spark, sf_dir)
    return Z.early_stop(scores, a.groupBy("user_id").agg(F.count("*").alias("n_answered")), 25)


@query("SELECT least(floor(score * 10 + 1e-9), 10)::INTEGER AS bucket, count(*)::BIGINT AS n FROM scored GROUP BY 1", T.ARTICLES, SIGNALS)
def a18_relevance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.relevance_histogram(_scored(spark, sf_dir), "score").select("bucket", "n")


CLUSTERED = "narrative_cluster_id IS NOT NULL"
CANON = f"""canon AS (SELECT *, first_value(id) OVER (PARTITION BY narrative_cluster_id ORDER BY status <> 'curated', CASE source_category {" ".join(f"WHEN '{k}' THEN {v}" for k, v in vocab.CATEGORY_ORDER.items())} ELSE 99 END, coalesce(trim(summary_pt), '') = '', -length(content), collected_at, ordinal) AS first FROM articles WHERE {CLUSTERED}),
decided AS (SELECT a.*, CASE WHEN c.first <> a.id THEN c.first END AS duplicate_of, CASE WHEN c.first <> a.id AND a.status <> 'curated' THEN 'irrelevant' ELSE a.status END AS new_status FROM articles a LEFT JOIN canon c USING (id))"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = T.articles(spark, sf_dir)
    return L.decide_clusters(a, a.where("narrative_cluster_id IS NOT NULL").select("id", "narrative_cluster_id"))


@query("SELECT ordinal, new_status AS status, duplicate_of FROM decided", T.ARTICLES, CANON)
def w04_k03_canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("ordinal", "status", "duplicate_of")


@query(f"""@x AS (SELECT d.*, status <> 'curated' AND NOT ({RELEVANT}) AND len(candidates_mentioned) < 2 AND NOT list_contains(topics, 'eleicoes') AS demoted FROM (SELECT s.*, d.duplicate_of FROM scored s JOIN decided d USING (ordinal)) d)
SELECT count(*)::BIGINT AS total, count_if(status = 'irrelevant')::BIGINT AS already, count_if(status <> 'irrelevant' AND demoted)::BIGINT AS by_relevance, count_if(status <> 'irrelevant' AND NOT demoted AND duplicate_of IS NOT NULL)::BIGINT AS by_duplicate, count(DISTINCT narrative_cluster_id)::BIGINT AS clusters FROM x""", T.ARTICLES, SIGNALS, CANON)
def a19_k06_cleanup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).withColumn("demoted", G.demoted("score"))
    dup = _decided(spark, sf_dir).select("ordinal", "duplicate_of")
    return A.cleanup_summary(rows.join(dup, "ordinal"))


TIER = f"CASE WHEN published_at IS NULL OR published_at >= {NOW} - INTERVAL 1 DAY OR (status = 'curated' AND published_at >= {NOW} - INTERVAL 2 DAY) THEN 'hot' WHEN published_at >= {NOW} - INTERVAL 3 DAY THEN 'warm' ELSE 'cold' END"


@query(f"SELECT keep AS tier, count(*)::BIGINT AS n, sum(CASE WHEN keep = 'hot' THEN 0 ELSE strlen(content) END)::BIGINT AS bytes_saved FROM (SELECT *, {TIER} AS keep FROM articles) GROUP BY keep", T.ARTICLES)
def a20_u05_archive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.archive_summary(T.articles(spark, sf_dir).withColumn("tier", L.retention_tier(T.now(), 1, 2, 3)))


@query(f"""SELECT ordinal, keep AS tier, CASE WHEN keep = 'hot' THEN length(content) END::INTEGER AS n, CASE WHEN keep = 'cold' THEN strftime(published_at, '%Y-%m') END AS archive_month FROM (SELECT *, CASE WHEN published_at IS NULL OR published_at >= {NOW} - INTERVAL 7 DAY OR (status = 'curated' AND published_at >= {NOW} - INTERVAL 14 DAY) THEN 'hot' WHEN published_at >= {NOW} - INTERVAL 30 DAY THEN 'warm' ELSE 'cold' END AS keep FROM articles)""", T.ARTICLES)
def u06_s16_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    stay, cold = L.apply_retention(T.articles(spark, sf_dir).drop("tier"), T.now())
    month = F.lit(None).cast("string").alias("archive_month")
    return stay.select("ordinal", "tier", F.length("content").alias("n"), month).unionByName(cold.select("ordinal", "tier", F.lit(None).cast("int").alias("n"), "archive_month"))


@query("SELECT tier, count(*)::BIGINT AS total, count_if(at_ts >= TIMESTAMP '2024-01-29 00:00:00' - INTERVAL 1 DAY)::BIGINT AS last_day, max(at_ts) AS latest FROM runs GROUP BY ROLLUP (tier)", T.RUNS)
def a21_error_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.error_rollup(T.runs(spark, sf_dir), F.lit("2024-01-29 00:00:00").cast("timestamp"))


@query(f"SELECT (SELECT count(*) FROM articles WHERE {ELIGIBLE} AND relevance_score <= 0)::BIGINT AS n, (SELECT string_agg(ordinal::VARCHAR, ',' ORDER BY ordinal) FROM (SELECT ordinal FROM articles WHERE {ELIGIBLE} AND relevance_score <= 0 ORDER BY ordinal LIMIT 20)) AS first_rows", T.ARTICLES)
def a22_zero_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.zero_relevance(T.articles(spark, sf_dir)).select("n", F.array_join(F.transform("first_rows", lambda x: x.cast("string")), ",").alias("first_rows"))


@query(f"""@x AS (SELECT 'provider' AS kind, provider AS name, * FROM runs UNION ALL SELECT 'task', task, * FROM runs)
SELECT kind, name, count(*)::BIGINT AS n, count_if(ok)::BIGINT AS passed, {places("count_if(ok) / count(*)")} AS rate, min(CASE WHEN ok THEN duration END) AS min_s, max(CASE WHEN ok THEN duration END) AS max_s FROM x GROUP BY kind, name""", T.RUNS)
def a23_run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.run_rollup(T.runs(spark, sf_dir))


@query("SELECT provider, at_ts::DATE AS day, count_if(ok)::BIGINT AS n, count_if(ok) >= 60 AS exhausted FROM runs GROUP BY ALL", T.RUNS)
def a24_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.usage(T.runs(spark, sf_dir), 60)


@query("""SELECT candidate, count(*)::BIGINT AS n, sum(amount)::DECIMAL(28,2) AS amount, count(*) FILTER (donor_type = 'PF')::BIGINT AS n_pf, sum(amount) FILTER (donor_type = 'PF')::DECIMAL(28,2) AS amount_pf, count(*) FILTER (donor_type = 'PJ')::BIGINT AS n_pj, sum(amount) FILTER (donor_type = 'PJ')::DECIMAL(28,2) AS amount_pj FROM donations GROUP BY candidate""", T.DONATIONS)
def a25_donor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.donor_summary(T.donations(spark, sf_dir))


@query("SELECT candidate, sector, sum(amount)::DECIMAL(28,2) AS amount, count(DISTINCT donor)::BIGINT AS donors FROM donations WHERE donor_type = 'PJ' GROUP BY ROLLUP (candidate, sector) HAVING candidate IS NOT NULL", T.DONATIONS)
def a26_sector_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sector_breakdown(T.donations(spark, sf_dir))


@query("SELECT candidate, count(*)::BIGINT AS n, sum(committed)::DECIMAL(28,2) AS committed, sum(paid)::DECIMAL(28,2) AS paid FROM amendments GROUP BY candidate", T.AMENDMENTS)
def a27_a28_amendment_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.totals_by_candidate(T.amendments(spark, sf_dir), ("committed", "paid"))


@query("""SELECT n_name AS candidate, n_regionkey = 1 AS flagged, coalesce(t.n, 0)::BIGINT AS n, committed, paid FROM nation LEFT JOIN (SELECT candidate, count(*) AS n, sum(committed)::DECIMAL(28,2) AS committed, sum(paid)::DECIMAL(28,2) AS paid FROM amendments GROUP BY candidate) t ON t.candidate = n_name""", T.AMENDMENTS)
def a29_transparency(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = T.table(spark, sf_dir, "nation").select(F.col("n_name").alias("candidate"), (F.col("n_regionkey") == 1).alias("flagged"))
    return A.transparency(A.totals_by_candidate(T.amendments(spark, sf_dir), ("committed", "paid")), flags)


@query(f"SELECT topic, n, share AS unknown_share, share > 0.5 AS needs_seeding FROM (SELECT topic, count(*)::BIGINT AS n, {places("avg((stance = 'unknown')::INTEGER)")} AS share FROM positions GROUP BY ROLLUP (topic))", T.POSITIONS)
def a30_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.coverage(T.positions(spark, sf_dir))


@query(f"""@t AS (SELECT candidate, score, unnest(CASE WHEN len(topics) > 0 THEN topics ELSE ['eleicoes'] END) AS topic FROM cells)
SELECT candidate, {", ".join(f"max(CASE WHEN topic = '{t}' THEN s END) AS {t}" for t in T.TOPICS)} FROM (SELECT candidate, topic, {places("avg(score)")} AS s FROM t GROUP BY ALL) GROUP BY candidate""", T.ARTICLES, SCORES)
def a31_sentiment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sentiment_grid(A.sentiment_by_topic(T.articles(spark, sf_dir)), T.TOPICS)


# ---- rankings, joins, merges ----


@query("SELECT ordinal, published_at FROM articles ORDER BY published_at DESC NULLS LAST, ordinal LIMIT 500", T.ARTICLES)
def w01_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.newest(T.articles(spark, sf_dir)).select("ordinal", "published_at")


@query(f"""@e AS (SELECT *, ts >= {NOW} - INTERVAL 24 HOUR AS fresh FROM articles WHERE {ELIGIBLE})
SELECT ordinal, status, prominence_score FROM e WHERE fresh OR NOT (SELECT coalesce(bool_or(fresh), false) FROM e) ORDER BY {ORDER} LIMIT 80""", T.ARTICLES)
def w02_t04_curated_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.curated_feed(T.articles(spark, sf_dir), T.now()).select("ordinal", "status", "prominence_score")


@query("""@l AS (SELECT published_at AS p, poll AS q FROM polls ORDER BY 1 DESC, 2 DESC LIMIT 1)
SELECT candidate, pct, ordinal FROM polls, l WHERE published_at = p AND poll = q ORDER BY pct DESC, candidate, ordinal LIMIT 5""", T.POLLS)
def w05_j09_latest_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.latest_poll(T.poll_results(spark, sf_dir)).select("candidate", "pct", "ordinal")


@query("SELECT candidate, ordinal, k::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY published_at DESC NULLS LAST, ordinal) AS k FROM (SELECT ordinal, published_at, unnest(candidates_mentioned) AS candidate FROM articles)) WHERE k <= 5", T.ARTICLES)
def w06_w10_recent_per_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.articles(spark, sf_dir).select("ordinal", "published_at", F.explode("candidates_mentioned").alias("candidate"))
    return L.top_per_group(rows, ["candidate"], [F.col("published_at").desc_nulls_last(), F.col("ordinal")], 5).select("candidate", "ordinal", "rank")


@query("SELECT * FROM divergence WHERE n_known >= 3 ORDER BY divergence DESC, n_known DESC, topic LIMIT 15", T.POSITIONS, DIVERGENCE)
def w07_topic_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.select_topics(T.positions(spark, sf_dir))


@query(f"SELECT topic, candidate, {lst(vocab.OPTION_IDS)}[k] AS option_id FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY candidate) AS k FROM weighted WHERE known) WHERE k <= 6", T.POSITIONS)
def w08_option_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.number_options(T.positions(spark, sf_dir), G.known_position()).select("topic", "candidate", "option_id")


@query("SELECT ordinal FROM articles ORDER BY published_at DESC NULLS LAST, ordinal LIMIT 20 OFFSET 40", T.ARTICLES)
def w09_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page(T.articles(spark, sf_dir), [F.col("published_at").desc_nulls_last(), F.col("ordinal")], 2).select("ordinal")


@query("SELECT min(ordinal) AS ordinal, content FROM articles GROUP BY content", T.ARTICLES)
def u01_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.keep_first(T.articles(spark, sf_dir), "content").select("ordinal", "content")


@query("SELECT min(ordinal) AS ordinal, title FROM articles WHERE ordinal % 3 <> 0 AND title NOT IN (SELECT title FROM articles WHERE ordinal % 3 = 0) GROUP BY title", T.ARTICLES)
def j01_t01_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = T.articles(spark, sf_dir)
    return L.new_rows(a.where("ordinal % 3 <> 0"), a.where("ordinal % 3 = 0"), "title").select("ordinal", "title")


@query("""SELECT ordinal, title FROM articles WHERE ordinal % 3 = 0 UNION ALL SELECT min(ordinal), title FROM articles WHERE ordinal % 3 <> 0 AND title <> '' AND title NOT IN (SELECT title FROM articles WHERE ordinal % 3 = 0) GROUP BY title""", T.ARTICLES)
def u02_merge_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = T.articles(spark, sf_dir).select("ordinal", "title")
    return L.merge_lists(a.where("ordinal % 3 = 0"), a.where("ordinal % 3 <> 0"), "title")


@query("""@o AS (SELECT source, max(ordinal) AS v FROM articles WHERE ordinal % 2 = 0 GROUP BY source), t AS (SELECT source, max(ordinal) AS v FROM articles WHERE ordinal % 3 = 0 GROUP BY source)
SELECT coalesce(o.source, t.source) AS source, coalesce(t.v, o.v) AS v FROM o FULL JOIN t USING (source)""", T.ARTICLES)
def u03_merge_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = T.articles(spark, sf_dir)
    part = lambda k: a.where(f"ordinal % {k} = 0").groupBy("source").agg(F.max("ordinal").alias("v"))
    return L.merge_maps(part(2), part(3), "source", "v")


@query(f"""@k AS (SELECT * FROM blocked QUALIFY row_number() OVER (PARTITION BY id ORDER BY ordinal) = 1)
SELECT ordinal, CASE WHEN length(title) = 0 THEN 'title' WHEN published_at IS NULL THEN 'published_at' END AS first_error FROM k WHERE status <> 'irrelevant' AND block_reason IS NULL ORDER BY published_at DESC NULLS LAST, ordinal LIMIT 500""", T.ARTICLES, RULES)
def u07_s14_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.plans.jobs import consolidate

    return consolidate(T.articles(spark, sf_dir), _rules(spark, sf_dir)).select("ordinal", "first_error")


@query("""SELECT ordinal, status = 'validated' AND prominence_score > 0.8 AS promoted, CASE WHEN status = 'validated' AND prominence_score > 0.8 THEN 'curated' ELSE status END AS status,
  (edited::INTEGER + (status = 'validated' AND prominence_score > 0.8)::INTEGER)::INTEGER AS n_history FROM articles""", T.ARTICLES)
def u08_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.promote(T.articles(spark, sf_dir), T.now()).select("ordinal", "promoted", "status", F.size("edit_history").alias("n_history"))


@query("SELECT ordinal, ordinal % 40 IN (0, 3) AS unpublished, CASE WHEN ordinal % 40 IN (0, 3) THEN 'irrelevant' ELSE status END AS status, CASE WHEN ordinal % 40 IN (0, 3) THEN 0.0 ELSE relevance_score END AS relevance_score FROM articles", T.ARTICLES)
def u09_unpublish(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = T.articles(spark, sf_dir)
    targets = a.where("ordinal % 40 = 0").select(F.upper("id").alias("target")).union(a.where("ordinal % 40 = 3").select(F.upper("url")))
    return L.unpublish(a, targets).select("ordinal", "unpublished", "status", "relevance_score")


@query("""@c AS (SELECT conv_id, min(text) AS t, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
x AS (SELECT a.*, c.n IS NOT NULL AND status = 'raw' AS annotated, c.t, c.n FROM articles a LEFT JOIN c ON c.conv_id = a.ordinal)
SELECT ordinal, annotated, CASE WHEN annotated THEN coalesce(t, title) ELSE summary_pt END AS summary_pt, CASE WHEN annotated THEN CASE WHEN n > 2 THEN 0.6 WHEN n > 1 THEN 1.0 ELSE 0.8 END ELSE confidence_score END::DOUBLE AS confidence FROM x""", T.ARTICLES)
def u10_apply_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = T.articles(spark, sf_dir)
    c = T.table(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.min("text").alias("t"), F.count("*").alias("n"))
    notes = a.join(c, F.col("conv_id") == F.col("ordinal")).select("id", F.col("t").alias("summary_pt"), F.when(F.col("n") > 1, F.col("t")).alias("summary_en"), F.array(F.lit("eleicoes")).alias("topics"), F.array(F.lit("lula")).alias("candidates"), (F.col("n") > 2).alias("parse_error"))
    return L.apply_annotations(a, notes).select("ordinal", "annotated", F.col("summaries.pt").alias("summary_pt"), F.col("confidence_score").alias("confidence"))


@query(f"""@j AS (SELECT i.*, b.block_reason FROM integrity i JOIN blocked b USING (ordinal)),
o AS (SELECT ordinal, CASE WHEN status = 'irrelevant' THEN 'dropped_irrelevant' WHEN block_reason IS NOT NULL THEN 'blocked' WHEN NOT gate THEN 'off_topic' WHEN integrity IS NOT NULL THEN 'rejected' ELSE 'annotate' END AS outcome FROM j),
l AS (SELECT max(ordinal) AS last, count(*) AS n FROM (SELECT ordinal FROM o WHERE outcome = 'annotate' ORDER BY ordinal LIMIT 100))
SELECT ordinal, CASE WHEN n = 100 AND ordinal > last AND outcome IN ('annotate', 'rejected') THEN 'waiting' ELSE outcome END AS outcome FROM o, l""", T.ARTICLES, GATE_SQL, INTEGRITY, RULES)
def u11_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.block_reasons(_gated(spark, sf_dir).withColumn("integrity", G.integrity("content", "title")), _rules(spark, sf_dir))
    return L.triage(rows, 100).select("ordinal", "outcome")


def _draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.positions(spark, sf_dir).where("p_partkey % 2 = 0")
    return p.withColumn("stance", F.when(F.col("p_partkey") % 3 == 0, "favor").otherwise(F.col("stance")))


@query("""@d AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 'favor' ELSE stance END AS drafted FROM positions)
SELECT topic, candidate, 'stance' AS field, stance AS old, drafted AS new FROM d WHERE p_partkey % 2 = 0 AND stance <> drafted""", T.POSITIONS)
def j11_draft_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.diff_fields(T.positions(spark, sf_dir), _draft(spark, sf_dir), ("topic", "candidate"), ("stance", "position_type", "summary_pt"))


@query("""SELECT topic, candidate, CASE WHEN p_partkey % 6 = 0 THEN 'favor' ELSE stance END AS stance, CASE WHEN p_partkey % 2 = 0 AND (p_partkey % 3 = 0 OR stance <> 'unknown') THEN true ELSE false END AS from_new FROM positions""", T.POSITIONS)
def u12_u13_u15_position_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, draft = T.positions(spark, sf_dir), _draft(spark, sf_dir)
    out = L.approve_drafts(base, draft, ("topic", "candidate"), ("stance",))
    back = L.fall_back(draft, base, ("topic", "candidate"), "stance", F.col("stance") != "unknown")
    return out.select("topic", "candidate", "stance").join(back.select("topic", "candidate", "from_new"), ["topic", "candidate"])


@query("""SELECT candidate, topic, ordinal, k::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY candidate, topic ORDER BY published_at DESC NULLS LAST, ordinal) AS k FROM (
  SELECT ordinal, published_at, candidate, unnest(topics) AS topic FROM (SELECT ordinal, published_at, topics, unnest(candidates_mentioned) AS candidate FROM articles))) WHERE k <= 12""", T.ARTICLES)
def j06_j07_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = T.articles(spark, sf_dir)
    grid = Z.position_grid(a.select(F.explode("topics").alias("topic")).distinct(), a.select(F.explode("candidates_mentioned").alias("candidate")).distinct())
    return Z.evidence(a, grid).select("candidate", "topic", "ordinal", "rank")


@query("""SELECT topic, max(CASE WHEN candidate = 'lula' THEN w END)::INTEGER AS weight_a, max(CASE WHEN candidate = 'zema' THEN w END)::INTEGER AS weight_b FROM options GROUP BY topic""", T.POSITIONS, T.ANSWERS)
def j10_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.compare(_scores(spark, sf_dir)[1], "lula", "zema")


@query("""@e AS (SELECT candidate, topic, ordinal, row_number() OVER (PARTITION BY candidate, topic ORDER BY published_at DESC NULLS LAST, ordinal) AS k, title FROM (
  SELECT ordinal, published_at, title, candidate, unnest(topics) AS topic FROM (SELECT ordinal, published_at, title, topics, unnest(candidates_mentioned) AS candidate FROM articles))),
n AS (SELECT candidate, topic, count(*) AS n FROM e WHERE k <= 12 GROUP BY ALL)
SELECT e.candidate, e.topic, e.ordinal FROM e JOIN n USING (candidate, topic) WHERE e.k = CASE WHEN n.n >= 3 THEN 3 ELSE 1 END""", T.ARTICLES)
def j12_u14_source_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = T.articles(spark, sf_dir)
    grid = Z.position_grid(a.select(F.explode("topics").alias("topic")).distinct(), a.select(F.explode("candidates_mentioned").alias("candidate")).distinct())
    ranked = Z.evidence(a, grid).join(a.select("ordinal", F.col("title").alias("description")).hint("merge"), "ordinal").select("candidate", "topic", "rank", "ordinal", "description")
    picks = ranked.select("candidate", "topic").distinct().withColumn("indices", F.array(F.lit(3), F.lit(99)))
    return Z.lookup_sources(picks, ranked).select("candidate", "topic", "ordinal")


@query("""@s AS (SELECT source AS key, ordinal, title AS text, 0 AS src FROM articles WHERE ordinal % 2 = 0 UNION ALL SELECT source, ordinal, summary_pt, 1 FROM articles WHERE summary_pt IS NOT NULL),
u AS (SELECT key, text, src, ordinal FROM s QUALIFY row_number() OVER (PARTITION BY key, text ORDER BY src, ordinal) = 1),
c AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY key, src ORDER BY ordinal, text) <= CASE WHEN src = 0 THEN 4 ELSE 9 END)
SELECT key, ordinal, text, src AS source, (row_number() OVER (PARTITION BY key ORDER BY src, ordinal, text))::INTEGER AS rank FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY src, ordinal, text) <= 12""", T.ARTICLES)
def j13_snippet_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = T.articles(spark, sf_dir)
    first = a.where("ordinal % 2 = 0").select(F.col("source").alias("key"), "ordinal", F.col("title").alias("text"))
    second = a.where("summaries.pt IS NOT NULL").select(F.col("source").alias("key"), "ordinal", F.col("summaries.pt").alias("text"))
    return Z.union_snippets([(first, 4), (second, 9)]).select("key", "ordinal", "text", "source", "rank")


def _said(table, lead: str) -> str:  # noqa: ANN001
    return "CASE stance " + " ".join(f"WHEN '{k}' THEN '{lead}{v}'" for k, v in table.items()) + " END"


@query(f"""WITH_RECURSIVE @k AS (SELECT topic, candidate, weight, stance, position_type, row_number() OVER (PARTITION BY topic ORDER BY candidate) AS k, lower(replace(topic, '_', ' ')) AS label FROM weighted WHERE known),
t AS (
  SELECT topic, k, o, {lst(vocab.INTROS)}[i] || {_said(vocab.STANCE_PT, " o governo ")} || ' em ' || label || ', {vocab.ENDING_PT}' AS pt, {lst(vocab.INTROS_EN)}[i] || {_said(vocab.STANCE_EN, " ")} || ' on ' || replace(topic, '_', ' ') || ', {vocab.ENDING_EN}' AS en
  FROM (SELECT *, unnest(range(16, 40)) AS o FROM k) x, LATERAL (SELECT ('0x' || substr(sha256(topic || ':' || candidate || ':' || stance || ':' || o), 1, 8))::BIGINT % 4 + 1 AS i)),
c AS (SELECT topic, k, list(struct_pack(pt := pt, en := en) ORDER BY o) AS texts FROM t GROUP BY topic, k),
r(topic, k, used, picked) AS (
  SELECT DISTINCT topic, 0::BIGINT, []::VARCHAR[], NULL::STRUCT(pt VARCHAR, en VARCHAR) FROM k
  UNION ALL
  SELECT topic, k, CASE WHEN p IS NULL THEN used ELSE list_append(used, p.pt) END, p
  FROM (SELECT r.topic, c.k, r.used, CASE WHEN len(r.used) < 6 THEN list_filter(c.texts, lambda x: NOT list_contains(r.used, x.pt))[1] END AS p FROM r JOIN c ON c.topic = r.topic AND c.k = r.k + 1)),
o AS (SELECT r.topic, r.k, len(used) AS place, picked, max(len(used)) OVER (PARTITION BY r.topic) AS n FROM r WHERE picked IS NOT NULL)
SELECT o.topic, k.candidate, {lst(vocab.OPTION_IDS)}[place] AS option_id, weight::INTEGER AS weight, CASE position_type WHEN 'confirmed' THEN 'high' ELSE 'medium' END AS confidence, picked.pt AS text_pt, picked.en AS text_en, '' AS violations
FROM o JOIN k ON k.topic = o.topic AND k.k = o.k WHERE n >= 3""", T.POSITIONS)
def m06_m07_quiz_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = T.positions(spark, sf_dir).withColumn("topic_label_pt", F.replace("topic", F.lit("_"), F.lit(" ")))
    out = O.assemble(positions.drop("summary_pt"))
    return V.checked(out, V.quiz_rules()).select("topic", "candidate", "option_id", "weight", "confidence", "text_pt", "text_en", F.array_join("violations", ",").alias("violations"))


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each part, from the document of its number, on the topic of its brand; some map to no position, or have no
    stance or weight of their own."""
    p = T.table(spark, sf_dir, "part").where("p_partkey % 5 = 0")
    w = X.split_words("text")
    d = T.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Defendo que "), F.array_join(F.slice(w, 1, 24), " ")).alias("text_pt"), F.array_join(F.slice(w, 2, 24), " ").alias("text_en"))
    rows = p.join(d, F.col("p_partkey") == F.col("doc_id")).select(F.col("p_brand").alias("topic"), F.col("p_partkey").cast("int").alias("place"), F.when(F.col("p_size") % 3 > 0, F.col("p_size") % 11).alias("mapped_position"), "text_pt", "text_en", T.pick(T.STANCES, "p_size % 6").alias("stance"), (F.col("p_size") % 5 - 2).alias("weight"))
    # the first dozen of each topic: what one request for options returns at most
    return L.top_per_group(rows, ["topic"], [F.col("place")], 12).drop("rank")


def _sourced_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.struct(F.col("p_name").alias("description_pt"), F.lit("").alias("description_en"), F.concat(F.lit("https://example.org/"), "p_partkey").alias("url"), F.lit(None).cast("string").alias("date"))
    parts = T.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return T.positions(spark, sf_dir).join(parts, "p_partkey").withColumn("sources", F.when(F.col("p_partkey") % 3 > 0, F.array(entry)))


@query()
def m06_generated_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options from generated texts and, where they fail, templates; tested against one option after the other."""
    return O.assemble(_sourced_positions(spark, sf_dir), _generated(spark, sf_dir)).drop("n_options")


# ---- similarity ----

PAIR_TIME = "(a.ts IS NULL OR b.ts IS NULL OR abs(epoch(a.ts) - epoch(b.ts)) <= 48 * 3600)"
TFIDF = f"""texts AS (SELECT ordinal, id, coalesce(published_at, collected_at) AS ts, list_filter(regexp_extract_all({norm("title || ' ' || title || ' ' || coalesce(nullif(trim(summary_pt), ''), substr(content, 1, 500))")}, '[a-z0-9]+'), lambda w: length(w) >= 2) AS w FROM articles),
terms AS (SELECT id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM texts),
tf AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY ALL),
voc AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 10000),
raw AS (SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM articles)) / (1 + df)) + 1) AS x FROM tf JOIN voc USING (term)),
vec AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM raw),
cos AS (SELECT a.id AS a, b.id AS b, sum(a.w * b.w) AS cosine FROM vec a JOIN vec b ON a.term = b.term AND a.id < b.id GROUP BY ALL HAVING sum(a.w * b.w) >= 0.75 - 1e-12),
pairs AS (SELECT c.a, c.b, c.cosine FROM cos c JOIN texts a ON a.id = c.a JOIN texts b ON b.id = c.b WHERE {PAIR_TIME})"""


@query(f"SELECT a, b, {places('cosine')} AS cosine FROM pairs", T.ARTICLES, TFIDF)
def k01_j04_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.cosine_pairs(T.articles(spark, sf_dir)).select("a", "b", X.places("cosine").alias("cosine"))


@query("""WITH_RECURSIVE @e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), r(x, y) AS (SELECT a, a FROM e UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
c AS (SELECT x AS id, min(y) AS root FROM r GROUP BY x), m AS (SELECT root, 'cluster_' || substr(sha256(string_agg(id, '' ORDER BY id)), 1, 8) AS narrative_cluster_id FROM c GROUP BY root)
SELECT id, narrative_cluster_id FROM c JOIN m USING (root)""", T.ARTICLES, TFIDF)
def k02_k05_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.narrative_clusters(T.articles(spark, sf_dir))


NARRATIVE = f"""{TFIDF.replace("FROM articles", "FROM mine")},
e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), r(x, y) AS (SELECT a, a FROM e UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
roots AS (SELECT x AS id, min(y) AS root FROM r GROUP BY x), named AS (SELECT root, 'cluster_' || substr(sha256(string_agg(id, '' ORDER BY id)), 1, 8) AS cluster FROM roots GROUP BY root),
grouped AS (SELECT mine.*, cluster FROM mine LEFT JOIN (SELECT id, cluster FROM roots JOIN named USING (root)) USING (id)),
{CANON.replace("narrative_cluster_id", "cluster").replace("FROM articles", "FROM grouped")}"""


@query(f"""WITH_RECURSIVE @mine AS (SELECT * FROM articles WHERE {ELIGIBLE}), {NARRATIVE}
SELECT ordinal, new_status AS status, cluster AS narrative_cluster_id, CASE WHEN new_status <> 'curated' THEN duplicate_of END AS duplicate_of FROM decided
UNION ALL SELECT ordinal, status, narrative_cluster_id, NULL FROM articles WHERE NOT ({ELIGIBLE})""", T.ARTICLES)
def k05_narrative_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.narrative_pass(T.articles(spark, sf_dir)).select("ordinal", "status", "narrative_cluster_id", "duplicate_of")


@query(f"""WITH_RECURSIVE @judged AS (SELECT *, coalesce(status <> 'curated' AND NOT {RELEVANT} AND len(candidates_mentioned) < 2 AND NOT list_contains(topics, 'eleicoes'), false) AS demoted FROM scored),
mine AS (SELECT * FROM judged WHERE NOT demoted AND status <> 'irrelevant'), {NARRATIVE}
SELECT ordinal, status AS was, new_status AS status, score AS relevance_score, demoted, coalesce(cluster, narrative_cluster_id) AS narrative_cluster_id, CASE WHEN new_status <> 'curated' THEN duplicate_of END AS duplicate_of FROM decided
UNION ALL SELECT ordinal, status, 'irrelevant', score, demoted, narrative_cluster_id, NULL FROM judged WHERE demoted OR status = 'irrelevant'""", T.ARTICLES, SIGNALS)
def k06_clean_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.clean_up(T.articles(spark, sf_dir)).select("ordinal", "was", "status", "relevance_score", "demoted", "narrative_cluster_id", "duplicate_of")


TITLES = f"""tt AS (SELECT ordinal, id, coalesce(published_at, collected_at) AS ts, {norm("title")} AS t FROM articles WHERE {norm("title")} <> ''),
tp AS (SELECT a.ordinal AS pa, b.ordinal AS pb FROM tt a JOIN tt b ON a.ordinal < b.ordinal WHERE {PAIR_TIME} AND (a.t = b.t OR (length(a.t) > 20 AND length(b.t) > 20 AND (contains(a.t, b.t) OR contains(b.t, a.t)))
  OR len(list_intersect(list_distinct(string_split(a.t, ' ')), list_distinct(string_split(b.t, ' ')))) >= 0.8 * len(list_distinct(string_split(a.t, ' ') || string_split(b.t, ' '))) - 1e-9))"""


@query("SELECT pa, pb FROM tp", T.ARTICLES, TITLES)
def j05_title_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.title_pairs(T.articles(spark, sf_dir)).select("pa", "pb").distinct()


#: Rows in ingest order, each against the earlier ones that stay; the first of those decides.
FIRST_WINS = f"""live AS (SELECT ordinal, id, narrative_cluster_id AS cluster, coalesce(published_at, collected_at) AS ts, {norm("title")} AS t FROM articles WHERE status <> 'irrelevant' AND {norm("title")} <> ''),
lp AS (SELECT a.ordinal AS pa, b.ordinal AS pb FROM live a JOIN live b ON a.ordinal < b.ordinal WHERE {PAIR_TIME} AND (a.t = b.t OR (length(a.t) > 20 AND length(b.t) > 20 AND (contains(a.t, b.t) OR contains(b.t, a.t)))
  OR len(list_intersect(list_distinct(string_split(a.t, ' ')), list_distinct(string_split(b.t, ' ')))) >= 0.8 * len(list_distinct(string_split(a.t, ' ') || string_split(b.t, ' '))) - 1e-9)),
n AS (SELECT node, row_number() OVER (ORDER BY node) AS k FROM (SELECT pa AS node FROM lp UNION SELECT pb FROM lp)),
e AS (SELECT k, node, (SELECT list(pa) FROM lp WHERE pb = node) AS before FROM n),
r(k, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT e.k, CASE WHEN before IS NOT NULL AND list_has_any(kept, before) THEN kept ELSE list_append(kept, node) END FROM r JOIN e ON e.k = r.k + 1),
f AS (SELECT unnest(kept) AS node FROM (SELECT kept FROM r ORDER BY k DESC LIMIT 1)),
won AS (SELECT pb AS ordinal, min(pa) AS kept_by FROM lp WHERE pa IN (SELECT node FROM f) AND pb NOT IN (SELECT node FROM f) GROUP BY pb),
duplicates AS (SELECT won.ordinal, kept_by, coalesce(nullif(trim(o.cluster), ''), 'cluster_' || substr(sha256(least(o.id, x.id) || greatest(o.id, x.id)), 1, 8)) AS narrative_cluster_id FROM won JOIN live o ON o.ordinal = kept_by JOIN live x ON x.ordinal = won.ordinal)"""


@query("WITH_RECURSIVE SELECT ordinal, kept_by, narrative_cluster_id, true AS duplicate FROM duplicates", T.ARTICLES, FIRST_WINS)
def k04_t02_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_wins(T.articles(spark, sf_dir)).select("ordinal", "kept_by", "narrative_cluster_id", "duplicate")


# ---- sources, checks, health ----


@query("""SELECT ordinal, substr(sha256(u), 1, 16) AS id, u AS url, coalesce(nullif(trim(title), ''), u) AS title, CASE WHEN length(content) >= 200 AND length(trim(regexp_replace(regexp_replace(content, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) >= 200
  THEN trim(regexp_replace(regexp_replace(content, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) ELSE '' END AS content, coalesce(published_at, collected_at) AS published_at FROM (SELECT *, CASE WHEN ordinal % 3 = 0 THEN id ELSE url END AS u FROM articles)""", T.ARTICLES)
def s04_s05_s06_feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rfc = F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss '+0000'")
    entries = T.articles(spark, sf_dir).select("ordinal", F.when(F.col("ordinal") % 3 == 0, " ").otherwise(F.col("url")).alias("link"), F.col("id").alias("entry_id"), "url", "title", F.array(F.lit("short"), "content").alias("contents"), F.lit("").alias("summary"), rfc.alias("published"), F.lit(None).cast("string").alias("updated"), "collected_at")
    return S.feed_articles(entries).drop("status")


@query("""SELECT source AS name, 'https://' || source AS url, len(list_filter(list_transform(c, lambda x: trim(x)), lambda x: x <> ''))::INTEGER AS n FROM (SELECT source, bool_or(ordinal % 3 = 0) AS active, list_concat([' '], list_sort(list_distinct(flatten(list(candidates_mentioned))))) AS c FROM articles GROUP BY source) WHERE active AND len(c) > 1""", T.ARTICLES)
def s03_active_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = T.articles(spark, sf_dir).select("source", F.explode_outer("candidates_mentioned").alias("candidate"), (F.col("ordinal") % 3 == 0).alias("active"))
    rows = a.groupBy("source").agg(F.bool_or("active").alias("active"), F.collect_set("candidate").alias("c"))
    sources = rows.select(F.lit("party").alias("kind"), F.col("source").alias("name"), F.concat(F.lit("https://"), "source").alias("url"), F.lit("").alias("category"), F.array_prepend("c", F.lit(" ")).alias("candidate_slugs"), "active")
    return S.active_sources(sources, "party").select("name", "url", F.size("candidate_slugs").alias("n"))


@query("SELECT id, url, title, status FROM articles", T.ARTICLES)
def s01_s02_s14_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles landed as JSON envelopes, one for each source and 10 000 ordinals, read, written as a table and read back."""
    import uuid

    from tidewire.session import shared_dir

    path = f"{shared_dir(spark).rstrip('/')}/envelope-{uuid.uuid4().hex}"
    block = F.floor(F.col("ordinal") / 10000).alias("block")
    landed = T.articles(spark, sf_dir).groupBy("source", block).agg(F.to_json(F.struct(F.lit("v1").alias("schema"), F.collect_list(F.struct("id", "url", "title", "status")).alias("articles"))).alias("value"))
    landed.write.partitionBy("source", "block").text(f"{path}/landed")
    rows = S.read_envelope(spark, f"{path}/landed/*/*", "articles", "struct<id:string,url:string,title:string,status:string>")
    S.write_envelope(rows, f"{path}/out")
    return spark.read.schema(rows.schema).json(f"{path}/out/rows")


ARCHIVED = "2024-02-03 00:00:00"


@query(f"""SELECT ordinal, id, strftime(published_at, '%Y-%m') AS archive_month FROM articles WHERE NOT (published_at >= TIMESTAMP '{ARCHIVED}' - INTERVAL 30 DAY)""", T.ARTICLES)
def s16_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cold rows appended to month partitions: a part of them first, then all, of which only those not there yet are added."""
    import uuid

    from tidewire.session import shared_dir

    path = f"{shared_dir(spark).rstrip('/')}/archive-{uuid.uuid4().hex}"
    _, cold = L.apply_retention(T.articles(spark, sf_dir), F.lit(ARCHIVED).cast("timestamp"))
    cold = cold.select("ordinal", "id", "archive_month")
    S.write_archive(cold.where("ordinal % 3 = 0"), path)
    held = lambda: spark.read.schema(cold.schema).parquet(path)
    S.write_archive(cold, path, held())
    return held()


@query("""SELECT page_id, length(title)::INTEGER AS n_title, n::INTEGER AS n FROM (SELECT page_id, substr(trim(regexp_replace(html, '\\s+', ' ', 'g')), 1, 120) AS title, 1 + CASE WHEN contains(lower(html), 'ther') THEN 1 ELSE 0 END AS n FROM pages)""")
def s11_social_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = T.table(spark, sf_dir, "pages").select(F.col("page_id").alias("ordinal"), F.lit("post").alias("kind"), "url", F.col("html").alias("text"), F.lit("lula").alias("query_candidate"))
    inferred = F.when(F.lower("text").contains("ther"), F.array(F.lit("zema"))).otherwise(F.array().cast("array<string>"))
    return S.social_articles(posts, inferred).select(F.col("ordinal").alias("page_id"), F.length("title").alias("n_title"), F.size("candidates_mentioned").alias("n"))


#: Character references are read as HTML reads them: these also without their semicolon, as where a text was cut off.
PLAIN = """trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#x27(;|([^0-9a-fA-F;])|$)', '''\\2', 'g'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))"""


@query(f"""WITH a AS (SELECT page_id, {PLAIN.format("regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1)")} AS a,
  {PLAIN.format("regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<head>.*?</head>', ' ', 'g'), '(?s)<(script|style|nav|footer)>.*?(</(script|style|nav|footer)>|$)', ' ', 'g')")} AS b FROM pages),
t AS (SELECT page_id, CASE WHEN length(a) > 100 THEN a ELSE b END AS t FROM a)
SELECT page_id, length(t)::INTEGER AS n, length(t) > 50 AND {hits("lower(substr(t, 1, 800))", vocab.PAYWALL)} < 2 AS accepted FROM t""")
def s07_s08_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts with their character references decoded, with or without a semicolon."""
    rows = H.extract_main_text(T.table(spark, sf_dir, "pages"))
    rows = rows.withColumns({"status": F.lit("raw"), "content": F.lit(None).cast("string")})
    return rows.select("page_id", F.length("text").alias("n"), S.acceptable_scrape(rows, "text", G.is_paywall("text")).alias("accepted"))


@query(f"""WITH l AS (SELECT page_id, url, {PLAIN.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS title FROM pages WHERE url IS NOT NULL)
SELECT substr(sha256(url), 1, 16) AS id, url, title FROM l WHERE title <> '' AND url NOT IN (SELECT url FROM pages WHERE page_id % 10 = 0 AND url IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1""")
def s09_s10_party_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of unknown places, with titles whose character references are decoded, with or without a semicolon."""
    pages = T.table(spark, sf_dir, "pages")
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1))
    sources = pages.select(host.alias("host")).distinct().withColumn("candidate_slugs", F.array(F.lit("zema")))
    known = pages.where("page_id % 10 = 0").select(X.short_hash("url").alias("id"))
    return H.party_articles(H.extract_links(pages), pages, sources, known).select("id", "url", "title")


PAGE_INSTITUTES = ("Datafolha", "Quaest", "AtlasIntel", "PoderData")


@query(f"""@p AS (SELECT poll, published_at, min(ordinal) AS page_id, count(DISTINCT candidate) AS n FROM polls GROUP BY ALL)
SELECT page_id, {lst(PAGE_INSTITUTES)}[page_id % 4 + 1] AS institute, published_at::DATE AS day, CASE WHEN page_id % 3 = 0 THEN 'espontanea' ELSE 'estimulada' END AS type, (1000 + page_id % 900)::INTEGER AS sample_size,
  (1 + page_id % 4 + 0.5)::DOUBLE AS margin, 'BR-' || lpad((page_id % 10000)::VARCHAR, 4, '0') || '/2026' AS registration, n::INTEGER AS n FROM p""", T.POLLS)
def s12_poll_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that state the polls of the events table: results as a sentence or as rows of a table, dates in both orders."""
    p = T.poll_results(spark, sf_dir).groupBy("poll", "published_at", "candidate").agg(F.min("ordinal").alias("ordinal"), F.avg("pct").alias("pct"))
    cell = F.struct(F.replace("candidate", F.lit("-"), F.lit(" ")).alias("c"), F.floor("pct").cast("string").alias("v"))
    p = p.groupBy("poll", "published_at").agg(F.min("ordinal").alias("page_id"), F.array_sort(F.collect_list(cell)).alias("r"))
    odd = F.col("page_id") % 2 == 1
    day = F.when(odd, F.date_format("published_at", "dd/MM/yyyy")).otherwise(F.date_format("published_at", "yyyy-MM-dd"))
    table = F.concat(F.lit("<table>"), F.array_join(F.transform("r", lambda x: F.concat(F.lit("<tr><td>"), x.c, F.lit("</td><td>"), x.v, F.lit("%</td></tr>"))), ""), F.lit("</table>"))
    said = F.concat(F.lit("<p>"), F.array_join(F.transform("r", lambda x: F.concat(x.c, F.lit(" tem "), x.v, F.lit("%"))), ", "), F.lit("</p>"))
    size = (1000 + F.col("page_id") % 900).cast("string")
    size = F.when(odd, size).otherwise(F.concat(F.substring(size, 1, 1), F.lit("."), F.substring(size, 2, 3)))
    kind = F.when(F.col("page_id") % 3 == 0, "espontânea").otherwise("estimulada")
    facts = (F.lit(". Amostra de "), size, F.lit(" eleitores, margem de erro "), (1 + F.col("page_id") % 4).cast("string"), F.lit(",5 p.p. Registro BR-"), F.lpad((F.col("page_id") % 10000).cast("string"), 4, "0"), F.lit("/2026. Pesquisa "), kind)
    html = F.concat(F.lit("<article><p>"), T.pick(PAGE_INSTITUTES, "page_id % 4"), F.lit(", "), day, *facts, F.lit(" em todo o pais, com entrevistas presenciais.</p>"), F.when(odd, table).otherwise(said), F.lit("</article>"))
    out = H.extract_polls(p.select("page_id", html.alias("html")), "lula|zema|caiado|tarcisio|aldo rebelo|renan santos|eduardo leite|flavio bolsonaro|ratinho jr")
    return out.select("page_id", "institute", "day", "type", "sample_size", "margin", "registration", F.size("results").alias("n"))


@query(f"""@a AS (SELECT ordinal, {lst(PAGE_INSTITUTES)}[ordinal % 4 + 1] AS institute, published_at, 1 + (ordinal % 50 > 0)::INTEGER + (ordinal % 3 = 0)::INTEGER AS n FROM articles)
SELECT ordinal, institute, n::INTEGER AS n FROM a WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY institute, published_at::DATE ORDER BY ordinal) = 1""", T.ARTICLES)
def s13_polls_from_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = T.articles(spark, sf_dir)
    third = F.when(F.col("ordinal") % 3 == 0, " e 9% caiado").otherwise("")
    said = F.concat(T.pick(PAGE_INSTITUTES, "ordinal % 4"), F.lit(": "), (F.col("ordinal") % 50).cast("string"), F.lit("% lula, 12,5% zema"), third, F.lit(". "))
    return P.polls_from_articles(a.withColumn("content", F.concat(said, F.coalesce("content", F.lit(""))))).select("ordinal", "institute", F.size("results").alias("n"))


@query("""SELECT id, trim(concat_ws(' ', nullif(trim(title), ''), nullif(trim(summary_pt), ''), nullif(trim(summary_en), ''))) AS raw_text, source FROM articles""", T.ARTICLES)
def s17_search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search_documents(T.articles(spark, sf_dir)).select("id", F.trim("raw_text").alias("raw_text"), F.col("doc.source").alias("source"))


@query(f"""@top AS (SELECT * FROM articles WHERE {ELIGIBLE} ORDER BY published_at DESC NULLS LAST, ordinal LIMIT 50)
SELECT ordinal, l.lang, title, url AS link, coalesce(nullif(trim(l.d), ''), title) AS description, strftime(published_at, '%a, %d %b %Y %H:%M:%S GMT') AS pub_date, id AS guid FROM (SELECT *, unnest([{{'lang': 'pt', 'd': summary_pt}}, {{'lang': 'en', 'd': summary_en}}]) AS l FROM top)""", T.ARTICLES)
def s18_feed_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.feed_export(T.articles(spark, sf_dir))


@query("SELECT topic AS topic_id, candidate, stance, position_type FROM positions", T.POSITIONS)
def s19_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions nested into one document per topic and flattened again."""
    entry = F.struct("candidate", F.struct("stance", "position_type").alias("x"))
    docs = T.positions(spark, sf_dir).groupBy("topic").agg(F.map_from_entries(F.collect_list(entry)).alias("candidates"))
    docs = docs.select(F.to_json(F.struct(F.create_map("topic", F.struct("candidates")).alias("topics"))).alias("doc"))
    return S.flatten_topics(docs, "doc", "struct<stance:string,position_type:string>")


@query(f"""@f AS (SELECT id, ordinal, row_number() OVER (ORDER BY ordinal) - 1 AS n, coalesce(nullif(substr(content, 1, 600), ''), nullif(trim(summary_pt), ''), title) AS text FROM articles WHERE {ELIGIBLE})
SELECT id, ordinal, (n // 5)::INTEGER AS batch, (n % 5)::INTEGER AS place, text FROM f WHERE n < 30""", T.ARTICLES)
def s20_annotation_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.annotation_batches(T.articles(spark, sf_dir).where(G.eligible()), 30)


@query("""SELECT batch, (row_number() OVER (PARTITION BY batch ORDER BY event_id) - 1)::INTEGER AS place, k::DOUBLE AS score FROM (SELECT event_id // 5 AS batch, event_id, regexp_extract(props, '"k": ([0-9]+)', 1)::INTEGER AS k FROM events)""")
def v08_batch_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 5).cast("long").alias("batch"), "event_id", F.get_json_object("props", "$.k").cast("double").alias("k"))
    one = F.struct("event_id", "k")
    rows = e.groupBy("batch").agg(F.array_sort(F.collect_list(one)).alias("x"))
    entries = F.transform("x", lambda x, i: F.struct(F.concat(F.lit("article_"), i.cast("string")).alias("key"), F.create_map(F.lit("s"), x.k).alias("value")))
    return N.split_batches(rows.select("batch", F.to_json(F.map_from_entries(entries)).alias("r")), "r").select("batch", "place", F.col("scores")["s"].alias("score"))


@query("""SELECT ordinal, CASE WHEN length(title) = 0 THEN 'title' WHEN published_at IS NULL THEN 'published_at' END AS first_error, (CASE WHEN length(title) = 0 THEN 1 ELSE 0 END + CASE WHEN published_at IS NULL THEN 1 ELSE 0 END)::INTEGER AS n FROM articles""", T.ARTICLES)
def v01_article_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.checked(T.articles(spark, sf_dir), V.article_rules()).select("ordinal", "first_error", F.size("violations").alias("n"))


@query("""@p AS (SELECT poll, institute, min(type) AS type, count(*) AS n FROM polls GROUP BY poll, institute)
SELECT rule, count(*)::BIGINT AS n FROM (SELECT unnest(['id', CASE WHEN institute <> 'click' THEN 'institute' END]) AS rule FROM p) WHERE rule IS NOT NULL GROUP BY rule""", T.POLLS)
def v02_poll_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.poll_results(spark, sf_dir).groupBy("poll", "institute", "published_at").agg(F.min("type").alias("type"), F.collect_list(F.struct("candidate", "pct")).alias("results"))
    return V.contract_counts(V.checked(p.withColumnRenamed("poll", "id"), V.poll_rules(("click",))))


@query("""@o AS (SELECT topic, candidate, row_number() OVER (PARTITION BY topic ORDER BY candidate) AS k, count(*) OVER (PARTITION BY topic) AS n FROM weighted WHERE known)
SELECT topic, candidate, concat_ws(',', CASE WHEN k > 6 THEN 'option_id' END, CASE WHEN n NOT BETWEEN 2 AND 6 THEN 'options' END) AS violations FROM o""", T.POSITIONS)
def v04_quiz_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Z.number_options(T.positions(spark, sf_dir), G.known_position(), 9)
    sizes = rows.groupBy("topic").agg(F.count("*").alias("n_options"))
    rows = rows.join(sizes, "topic").withColumns({"weight": M.stance_weight("stance"), "text_pt": O.position_texts(F.lit(0), "topic", F.lit(None).cast("string"), F.lit(None).cast("string"), "stance", F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"))[0], "option_id": F.try_element_at(F.array(*map(F.lit, vocab.OPTION_IDS)), F.col("rank"))})
    return V.checked(rows, V.quiz_rules()).select("topic", "candidate", F.array_join("violations", ",").alias("violations"))


@query("SELECT title, count(*)::BIGINT AS n FROM articles GROUP BY title HAVING count(*) > 1", T.ARTICLES)
def v05_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.duplicate_keys(T.articles(spark, sf_dir), "title")


FRESH = """limits AS (SELECT * FROM (VALUES ('click', 60, true), ('view', 1000000, true), ('purchase', 10, false), ('nothing', 10, true)) v(name, minutes, required)),
states AS (SELECT l.name, minutes, required, CASE WHEN n IS NULL THEN NULL ELSE greatest(0, floor((epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(at_ts)) / 60))::BIGINT END AS age_minutes, n FROM limits l LEFT JOIN (SELECT provider AS name, max(at_ts) AS at_ts, count(*) AS n FROM runs GROUP BY provider) USING (name)),
judged AS (SELECT name, required, age_minutes, CASE WHEN n IS NULL THEN 'missing' WHEN age_minutes > minutes THEN 'stale' ELSE 'ok' END AS state FROM states)"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = spark.createDataFrame([("click", 60, True), ("view", 1000000, True), ("purchase", 10, False), ("nothing", 10, True)], "name string, minutes int, required boolean")
    outputs = T.runs(spark, sf_dir).select(F.col("provider").alias("name"), "at")
    return V.freshness(outputs, limits, F.lit("2024-01-31 00:00:00").cast("timestamp"))


@query("SELECT name, required, CASE WHEN state = 'missing' THEN 0 ELSE age_minutes END AS age_minutes, state FROM judged", T.RUNS, FRESH)
def t06_freshness_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir).select("name", "required", F.coalesce(F.when(F.col("state") != "missing", F.col("age_minutes")), F.lit(0)).alias("age_minutes"), "state")


@query(f"""SELECT (SELECT count_if(required AND state = 'missing') FROM judged)::BIGINT AS missing, (SELECT count_if(state = 'stale') FROM judged)::BIGINT AS stale, (SELECT count_if(NOT ok) FROM runs)::BIGINT AS errors,
  (SELECT count(*) FROM articles WHERE {ELIGIBLE} AND relevance_score <= 0)::BIGINT AS zero, 'error' AS health""", T.ARTICLES, T.RUNS, FRESH)
def t07_overall_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = T.runs(spark, sf_dir).agg(F.count_if(~F.col("ok")).alias("n"))
    return V.overall(_states(spark, sf_dir), errors, A.zero_relevance(T.articles(spark, sf_dir)))


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'bad record' END AS error FROM events")
def t09_bad_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that do not parse become rows of an error column instead of failing the job."""
    raw = F.when(F.col("event_id") % 10 == 0, F.lit("{not json")).otherwise(F.col("props"))
    rows = T.table(spark, sf_dir, "events").select("event_id", F.try_parse_json(raw).alias("v"))
    return rows.select("event_id", F.when(F.col("v").isNull(), "bad record").alias("error"))


# ---- streams: tables that arrive in parts, through the jobs that keep state ----


def _arriving(spark: SparkSession, rows: DataFrame, parts: list, job: Callable[[DataFrame, str, str], object]) -> str:  # noqa: ANN001
    """Land the rows part by part, each a batch of a stream that goes on from the one before; the folder of the job's tables."""
    import uuid

    from tidewire.session import shared_dir
    from tidewire.streaming.jobs import landed

    path = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    for part in parts:
        rows.where(part).write.mode("append").parquet(f"{path}/in")
        job(landed(spark, f"{path}/in", schema), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return f"{path}/out"


@query("""@d AS (SELECT event_type AS key, ts, ts::DATE AS day, event_id % 3 AS part FROM events),
h AS (SELECT p.part, max(d.ts) AS horizon FROM (SELECT DISTINCT part FROM d) p LEFT JOIN d ON d.part < p.part GROUP BY p.part)
SELECT key, day, count(*)::BIGINT AS n, count_if(coalesce(day + INTERVAL 1 DAY <= horizon - INTERVAL 24 HOUR, false))::BIGINT AS n_late FROM d JOIN h USING (part) GROUP BY key, day""", "one AS (SELECT 1)")
def t08_late_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events counted by type and day in three batches; what comes after its day was final is kept apart and merged in."""
    from tidewire.streaming.jobs import corrected_days, counted_days

    rows = T.table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    out = _arriving(spark, rows, [F.col("event_id") % 3 == k for k in range(3)], lambda s, out, check: counted_days(s, out, "event_type", "ts", check))
    return corrected_days(spark, out, "event_type", "ts")


@query("""@m AS (SELECT unnest(candidates_mentioned) AS key, published_at::DATE AS day FROM articles WHERE published_at IS NOT NULL),
s AS (SELECT max(ts) AS last, min(ts) AS first FROM (SELECT published_at AS ts FROM articles WHERE published_at IS NOT NULL AND len(candidates_mentioned) > 0)),
e AS (SELECT unnest(range(first::DATE::TIMESTAMP, last::DATE::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM s),
n AS (SELECT m.key, e.day, count(*) AS n, count_if(m.day = e.day) AS n_recent FROM e JOIN m ON m.day <= e.day AND m.day > e.day - 7 GROUP BY ALL)
SELECT key, day, n::BIGINT AS n, n_recent::BIGINT AS n_recent, CASE WHEN n_recent > 0 AND n_recent > 1.25 * ((n - n_recent) / 6.0) THEN 'rising' WHEN n > n_recent AND n_recent < 0.75 * ((n - n_recent) / 6.0) THEN 'falling' ELSE 'stable' END AS trend FROM n""", T.ARTICLES)
def t03_mention_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions in three batches by time; each day's trend when the day is final."""
    from tidewire.streaming.jobs import mention_trends
    from tidewire.streaming.steps import held

    a = T.articles(spark, sf_dir)
    last = a.agg(F.max("ordinal")).first()[0] or 0
    rows = a.select("ordinal", F.explode("candidates_mentioned").alias("candidate"), "published_at")
    part = F.least(F.floor(F.col("ordinal") * 3 / F.lit(last + 1)), F.lit(2))
    out = _arriving(spark, rows, [part == k for k in range(3)], lambda s, out, check: mention_trends(s, out, "candidate", "published_at", check, late_hours=0))
    return held(spark, f"{out}/trends", "key string, day date, n long, n_recent long, trend string, step long").drop("step")


@query(f"""@e AS (SELECT *, ts >= (SELECT max(ts) FROM articles) - INTERVAL 24 HOUR AS fresh FROM articles WHERE {ELIGIBLE})
SELECT ordinal, id FROM e WHERE fresh OR NOT (SELECT bool_or(fresh) FROM e) ORDER BY status = 'curated' DESC, prominence_score DESC NULLS LAST, ts DESC NULLS LAST, ordinal LIMIT 80""", T.ARTICLES)
def t04_rolling_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed after articles came in three batches, out of order; rows leave it as the latest time goes on."""
    from tidewire.streaming.jobs import curated_feed_batches

    a = T.articles(spark, sf_dir).select("ordinal", "id", "status", "prominence_score", "published_at", "collected_at")
    out = _arriving(spark, a, [F.col("ordinal") % 3 == k for k in range(3)], curated_feed_batches)
    return spark.read.schema("ordinal long, id string").parquet(f"{out}/feed/step=2")


@query("""@s AS (SELECT ordinal, source, ordinal // 10000 AS block, ordinal % 50 = 0 AS bad FROM articles),
g AS (SELECT source, count(DISTINCT block) AS n_files, count_if(bad) AS n_bad, count(*) AS n, source = 'src3' AS cut FROM s GROUP BY source)
SELECT source, n_files::BIGINT AS n_files, CASE WHEN cut THEN n_files ELSE 0 END::BIGINT AS n_errors, CASE WHEN cut THEN 0 ELSE n - n_bad END::BIGINT AS n_rows, CASE WHEN cut THEN 0 ELSE n_bad END::BIGINT AS n_bad_records FROM g""", T.ARTICLES)
def t09_failure_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles landed as files by source, those of one source cut off and some records without an id: the ledger of the read."""
    import uuid

    from tidewire.session import shared_dir
    from tidewire.sources.isolation import isolate, read_files

    path = f"{shared_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    item = F.struct(F.when(F.col("ordinal") % 50 > 0, F.col("id")).alias("id"), "url")
    # a file holds the articles of a source in 10 000 ordinals at most
    landed = T.articles(spark, sf_dir).groupBy("source", F.floor(F.col("ordinal") / 10000).alias("block")).agg(F.to_json(F.struct(F.collect_list(item).alias("articles"))).alias("value"))
    landed = landed.withColumn("value", F.when(F.col("source") == "src3", F.expr("substring(value, 1, length(value) - 2)")).otherwise(F.col("value")))
    landed.write.partitionBy("source", "block").text(path)
    return isolate(read_files(spark, path), "articles", "struct<id: string, url: string>")[2]


@query("""@rules AS (SELECT DISTINCT lower(split_part(trim(text), ' ', 1)) AS value FROM conversations WHERE turn = 0 AND length(split_part(trim(text), ' ', 1)) >= 4)
SELECT ordinal, EXISTS (SELECT 1 FROM rules WHERE contains(lower(title), value)) AS found FROM articles""", T.ARTICLES)
def j03_many_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that contain one of a table of patterns that grows with the input, by the index of the patterns."""
    from tidewire.operators.matching import containing

    first = F.lower(F.split_part(F.trim("text"), F.lit(" "), F.lit(1)))
    rules = T.table(spark, sf_dir, "conversations").where("turn = 0").select(first.alias("value")).where(F.length("value") >= 4)
    a = T.articles(spark, sf_dir).select("ordinal", F.lower("title").alias("text"))
    hits = containing(a, rules).withColumn("found", F.lit(True))
    return a.join(hits.hint("merge"), "text", "left").select("ordinal", F.coalesce("found", F.lit(False)).alias("found"))
