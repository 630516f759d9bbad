"""The library's tables derived from the driver's, by the same arithmetic in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import vocab

START = "2024-01-01 00:00:00"
NOW = "2024-01-05 12:00:00"
#: Frequent words of the given texts that stand for topics and candidates.
TOPIC_WORDS = {"eleicoes": " the ", "corrupcao": " que ", "impostos": " des ", "economia": " was ", "saude": " with ", "previdencia": " der "}
CANDIDATE_WORDS = {"lula": " from ", "zema": " les ", "caiado": " are ", "tarcisio": " dem ", "flavio-bolsonaro": " para ", "renan-santos": " this "}
TOPICS = tuple(TOPIC_WORDS)
HIGH, CANDIDATE, CONTEXT, OFF, FOREIGN = ("that", "tion", "pour", "eine"), ("reth", "enle", "asta"), ("ing", "ment", "und"), ("wh", "eau"), ("ou", "sch")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], index: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.expr(f"CAST({index} AS INT)") + 1)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), F.col("text").alias("content"), "source")
    low = F.lower("content")
    found = lambda w: F.array_compact(F.array(*(F.when(F.contains(low, F.lit(x)), F.lit(k)) for k, x in w.items())))
    minutes = lambda e: F.lit(START).cast("timestamp") + F.expr(f"make_dt_interval(0, 0, {e})")
    line = lambda n: F.nullif(F.trim(F.split_part("content", F.lit("\n"), F.lit(n))), F.lit(""))
    d = d.withColumns({"topics": found(TOPIC_WORDS), "candidates_mentioned": found(CANDIDATE_WORDS)})
    entry = "named_struct('tier', IF(ordinal % 2 = 0, 'editor', 'curator'), 'at', '2024-01-01T00:00:00Z', 'provider', source, 'action', IF(ordinal % 3 = 0, 'validated', 'promote'), 'changes', IF(ordinal % 4 = 0, array('status', 'title'), array('title')))"
    return d.select(
        "ordinal", F.substring(F.sha2(F.col("ordinal").cast("string"), 256), 1, 16).alias("id"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.col("ordinal").cast("string")).alias("url"),
        F.substring(F.split_part("content", F.lit("\n"), F.lit(1)), 1, 120).alias("title"), "content", "source",
        pick(vocab.CATEGORIES, "ordinal % 7").alias("source_category"),
        F.when(F.col("ordinal") % 97 != 0, minutes("ordinal * 7")).alias("published_at"), minutes("ordinal * 7 + 5").alias("collected_at"),
        pick(vocab.STATUSES, "ordinal % 4").alias("status"), "topics", "candidates_mentioned",
        F.struct(F.when(F.col("ordinal") % 3 != 0, line(2)).alias("pt"), F.when(F.col("ordinal") % 5 > 1, line(3)).alias("en")).alias("summaries"),
        F.expr("map_from_arrays(IF(ordinal % 2 = 0, candidates_mentioned, array()), transform(IF(ordinal % 2 = 0, candidates_mentioned, array()), (c, i) -> ((ordinal * 7 + i * 3) % 21 - 10) / 10D))").alias("sentiment_scores"),
        F.expr("map_from_arrays(candidates_mentioned, transform(candidates_mentioned, (c, i) -> element_at(array('positivo', 'neutro', 'negativo'), CAST((ordinal + i) % 3 AS INT) + 1)))").alias("sentiment_per_candidate"),
        F.expr("IF(ordinal % 13 = 0, NULL, (ordinal % 11) / 10D)").alias("confidence_score"), F.expr("((ordinal % 21) - 10) / 10D").alias("sentiment_score"),
        F.expr("(ordinal % 10) / 10D").alias("relevance_score"), F.expr("((ordinal * 37) % 100) / 100D").alias("prominence_score"),
        F.expr("IF(ordinal % 6 = 0, concat('c', CAST(ordinal DIV 12 AS STRING)), NULL)").alias("narrative_cluster_id"),
        F.expr(f"IF(ordinal % 5 = 0, array({entry}), slice(array({entry}), 1, 0))").alias("edit_history"),
    )


def _sql_list(values) -> str:  # noqa: ANN001
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_found(words: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{k}' END" for k, w in words.items()) + "], lambda x: x IS NOT NULL)"


ARTICLES = f"""base AS (
  SELECT doc_id AS ordinal, text AS content, source, {_sql_found(TOPIC_WORDS)} AS topics, {_sql_found(CANDIDATE_WORDS)} AS candidates_mentioned FROM documents),
articles AS (
  SELECT ordinal, substr(sha256(ordinal::VARCHAR), 1, 16) AS id, 'https://' || source || '.example.org/' || ordinal AS url,
    substr(split_part(content, chr(10), 1), 1, 120) AS title, content, source, {_sql_list(vocab.CATEGORIES)}[ordinal % 7 + 1] AS source_category,
    CASE WHEN ordinal % 97 <> 0 THEN TIMESTAMP '{START}' + to_minutes(ordinal * 7) END AS published_at, TIMESTAMP '{START}' + to_minutes(ordinal * 7 + 5) AS collected_at,
    {_sql_list(vocab.STATUSES)}[ordinal % 4 + 1] AS status, topics, candidates_mentioned,
    CASE WHEN ordinal % 3 <> 0 THEN nullif(trim(split_part(content, chr(10), 2)), '') END AS summary_pt,
    CASE WHEN ordinal % 5 > 1 THEN nullif(trim(split_part(content, chr(10), 3)), '') END AS summary_en,
    CASE WHEN ordinal % 2 = 0 THEN list_transform(candidates_mentioned, lambda c, i: {{'candidate': c, 'score': ((ordinal * 7 + (i - 1) * 3) % 21 - 10) / 10.0::DOUBLE}}) ELSE [] END AS stored_scores,
    list_transform(candidates_mentioned, lambda c, i: {{'candidate': c, 'score': [1.0::DOUBLE, 0.0::DOUBLE, -1.0::DOUBLE][(ordinal + i - 1) % 3 + 1]}}) AS label_scores,
    CASE WHEN ordinal % 13 <> 0 THEN (ordinal % 11) / 10.0::DOUBLE END AS confidence_score, ((ordinal % 21) - 10) / 10.0::DOUBLE AS sentiment_score,
    (ordinal % 10) / 10.0::DOUBLE AS relevance_score, ((ordinal * 37) % 100) / 100.0::DOUBLE AS prominence_score,
    CASE WHEN ordinal % 6 = 0 THEN 'c' || (ordinal // 12) END AS narrative_cluster_id,
    ordinal % 5 = 0 AS edited, CASE WHEN ordinal % 2 = 0 THEN 'editor' ELSE 'curator' END AS tier, CASE WHEN ordinal % 3 = 0 THEN 'validated' ELSE 'promote' END AS action,
    coalesce(CASE WHEN ordinal % 97 <> 0 THEN TIMESTAMP '{START}' + to_minutes(ordinal * 7) END, TIMESTAMP '{START}' + to_minutes(ordinal * 7 + 5)) AS ts
  FROM base)"""


def poll_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    slug = pick(vocab.SLUGS, "user_id % 9")
    return e.select(F.col("event_id").alias("ordinal"), F.concat_ws("_", "event_type", F.date_format("ts", "yyyy-MM-dd")).alias("poll"), F.col("event_type").alias("institute"), F.when(F.col("user_id") % 2 == 0, "estimulada").otherwise("espontanea").alias("type"), F.date_trunc("day", "ts").alias("published_at"), slug.alias("candidate"), F.upper(slug).alias("name"), F.least("value", F.lit(100.0)).alias("pct"))


POLLS = f"""polls AS (
  SELECT event_id AS ordinal, event_type || '_' || strftime(ts, '%Y-%m-%d') AS poll, event_type AS institute, CASE WHEN user_id % 2 = 0 THEN 'estimulada' ELSE 'espontanea' END AS type,
    date_trunc('day', ts)::TIMESTAMP AS published_at, {_sql_list(vocab.SLUGS)}[user_id % 9 + 1] AS candidate, upper({_sql_list(vocab.SLUGS)}[user_id % 9 + 1]) AS name, least(value, 100.0)::DOUBLE AS pct
  FROM events)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), F.concat(F.lit("task"), (F.col("user_id") % 5).cast("string")).alias("task"), F.col("event_type").alias("tier"), F.col("ts").alias("at"), (F.col("value") > 20).alias("ok"), F.col("value").alias("duration"))


RUNS = "runs AS (SELECT event_type AS provider, 'task' || (user_id % 5) AS task, event_type AS tier, ts AS at_ts, value > 20 AS ok, value AS duration FROM events)"


def donations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("n_name").alias("candidate"), F.when(F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD"), "PF").otherwise("PJ").alias("donor_type"), F.col("c_custkey").alias("donor"), F.col("c_mktsegment").alias("sector"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))


DONATIONS = """donations AS (
  SELECT n_name AS candidate, CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 'PF' ELSE 'PJ' END AS donor_type, c_custkey AS donor, c_mktsegment AS sector, o_totalprice::DECIMAL(18,2) AS amount
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def amendments(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, s, n = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    rows = l.join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("n_name").alias("candidate"), F.col("l_extendedprice").cast("decimal(18,2)").alias("committed"), F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice").cast("decimal(18,2)")).otherwise(F.lit(0).cast("decimal(18,2)")).alias("paid"))


AMENDMENTS = """amendments AS (
  SELECT n_name AS candidate, l_extendedprice::DECIMAL(18,2) AS committed, CASE WHEN l_returnflag = 'R' THEN l_extendedprice::DECIMAL(18,2) ELSE 0::DECIMAL(18,2) END AS paid
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
STANCES = (*vocab.STANCES, "unknown")
TYPES = ("confirmed", "inferred", "unknown")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("topic"), pick(vocab.SLUGS, "p_partkey % 9").alias("candidate"), "p_partkey", "p_size", "p_name")
    first = p.groupBy("topic", "candidate").agg(F.min_by(F.struct("p_partkey", "p_size", "p_name"), "p_partkey").alias("x")).select("topic", "candidate", "x.*")
    return first.select("topic", "candidate", "p_partkey", pick(STANCES, "p_size % 6").alias("stance"), pick(TYPES, "p_partkey % 3").alias("position_type"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_name")).alias("summary_pt"))


POSITIONS = f"""positions AS (
  SELECT topic, candidate, p_partkey, {_sql_list(STANCES)}[p_size % 6 + 1] AS stance, {_sql_list(TYPES)}[p_partkey % 3 + 1] AS position_type, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS summary_pt
  FROM (SELECT p_brand AS topic, {_sql_list(vocab.SLUGS)}[p_partkey % 9 + 1] AS candidate, * FROM part)
  QUALIFY row_number() OVER (PARTITION BY topic, candidate ORDER BY p_partkey) = 1),
weighted AS (SELECT *, CASE stance WHEN 'strongly_favor' THEN 3 WHEN 'favor' THEN 2 WHEN 'neutral' THEN 0 WHEN 'against' THEN -2 WHEN 'strongly_against' THEN -3 END AS weight, position_type IN ('confirmed', 'inferred') AND stance <> 'unknown' AS known FROM positions)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = l.join(p.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("l_suppkey").alias("user_id"), F.col("p_brand").alias("topic")).agg((F.min("l_quantity") % 7 - 3).alias("weight"))


ANSWERS = """answers AS (
  SELECT l_suppkey AS user_id, p_brand AS topic, min(l_quantity) % 7 - 3 AS weight FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
options AS (SELECT topic, candidate, weight AS w FROM weighted WHERE known),
users AS (SELECT DISTINCT user_id FROM answers),
scores AS (
  SELECT u.user_id, c.candidate, count(w)::BIGINT AS n_topics, floor(coalesce(avg(1 - abs(a.weight - w) / 6.0::DOUBLE) * 100, 0.0) * 100 + 0.5 + 1e-6) / 100 AS affinity
  FROM users u CROSS JOIN (SELECT DISTINCT candidate FROM positions) c LEFT JOIN answers a USING (user_id) LEFT JOIN options o ON o.topic = a.topic AND o.candidate = c.candidate
  GROUP BY ALL)"""
