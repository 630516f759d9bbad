"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_repeated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.repeated_text import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.quality_rules import quality_rules

    out = quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures")


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         coalesce(text, '') AS text
  FROM documents),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines
  FROM w),
g AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
r AS (
  SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 8) AS gap
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, sum(least(gap, 8))::BIGINT AS n FROM r GROUP BY doc_id),
f AS (
  SELECT m.*, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM m LEFT JOIN c USING (doc_id)),
l AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 12 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END)::INTEGER AS failures
  FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed,
       (failures & 63) = 0 AS kept, failures
FROM l"""


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.simhash import near_duplicates

    out = near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.url_filter import filter_urls

    return filter_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "by")


OP2_SQL = r"""
WITH RECURSIVE tags AS (
  SELECT url AS src, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) AS tag
  FROM pages WHERE regexp_matches(html, '(?i)canonical|refresh')),
hrefs AS (
  SELECT src, trim(CASE
      WHEN lower(tag) LIKE '<link%' AND regexp_matches(tag, '(?is)\brel\s*=\s*["'']?[^"''>]*\bcanonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]*)', 1)
      WHEN lower(tag) LIKE '<meta%' AND regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?refresh') THEN regexp_extract(tag, '(?is)\bcontent\s*=\s*"[^"]*url\s*=\s*([^"]*)"', 1)
    END) AS dst FROM tags),
links AS (SELECT DISTINCT src, replace(dst, '&amp;', '&') AS dst FROM hrefs WHERE dst LIKE '%://%'),
urls AS (SELECT url FROM pages UNION SELECT dst FROM links),
cut AS (
  SELECT url, CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*(\??[^#]*)', 1) ELSE '' END AS query
  FROM urls),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
won AS (
  SELECT c.url, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS verdict
  FROM cut c JOIN rules r ON (c.host = r.h OR ends_with(c.host, '.' || r.h)) AND starts_with(c.path, r.p) GROUP BY c.url),
nodes AS (SELECT cut.*, host || path || query AS node, rule, verdict FROM cut LEFT JOIN won USING (url)),
e AS (SELECT a.node AS a, b.node AS b FROM links JOIN nodes a ON a.url = src JOIN nodes b ON b.url = dst WHERE a.host <> '' AND b.host <> ''),
bad(node) AS (
  SELECT node FROM nodes WHERE verdict = 'block' AND node IN (SELECT a FROM e UNION SELECT b FROM e)
  UNION SELECT CASE WHEN e.a = bad.node THEN e.b ELSE e.a END FROM bad JOIN e ON e.a = bad.node OR e.b = bad.node)
SELECT page_id, host, path, n.rule, coalesce(n.verdict, CASE WHEN bad.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN n.verdict IS NOT NULL THEN 'rule' WHEN bad.node IS NOT NULL THEN 'alias' ELSE 'default' END AS "by"
FROM pages LEFT JOIN nodes n ON n.url IS NOT DISTINCT FROM pages.url LEFT JOIN bad ON bad.node = n.node"""


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.warc import decide, read_archives, write_archives
    from tidewire.session import stored

    archives = stored(write_archives(decide(_table(spark, sf_dir, "pages"))), "warc")
    out = read_archives(archives).where("reason IS NULL")
    return out.select(F.expr("try_cast(record_id AS long)").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"))


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
k AS (SELECT html, max(page_id) AS kept FROM p WHERE n >= 1000 GROUP BY html)
SELECT page_id, n AS payload_bytes, sha1(p.html) AS payload_digest, CASE WHEN kept IS NULL OR kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM p LEFT JOIN k ON k.html = p.html AND p.n >= 1000"""


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.html_text import extract

    return extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


#: Holds for the layout of the given pages: one article of h1 and p blocks, with b and br inside.
OP5_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS a FROM pages),
b AS (
  SELECT page_id, url, list_transform(string_split_regex(regexp_replace(regexp_replace(a, '</?b>', '', 'g'), '<br>', ' ', 'g'), '</?(?:h1|p)>'),
    lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS blocks FROM a)
SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text,
       length(array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)))::BIGINT AS n_chars
FROM b"""


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidewire.llm.sentence_pieces import encode_decode

    out = encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.line_dedup import drop_repeated_lines

    out = drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH raw AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
  SELECT doc_id, i, ls[i] AS line, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(ls[i]), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS t
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM raw)),
s AS (SELECT t, len(t) AS n, min(row(doc_id, i)) AS place FROM l WHERE len(t) > 0 GROUP BY t),
w AS (SELECT place, n, unnest(t) AS w FROM s),
f AS (SELECT w, count(*) AS c FROM w GROUP BY w),
p AS (SELECT place, n, w FROM w JOIN f USING (w) QUALIFY row_number() OVER (PARTITION BY place ORDER BY c, w) <= n - (4 * n + 4) // 5 + 1),
pairs AS (SELECT DISTINCT y.place AS y, x.place AS x FROM p y JOIN p x ON x.w = y.w AND x.place < y.place AND 5 * y.n >= 4 * x.n AND 5 * x.n >= 4 * y.n),
bad AS (
  SELECT DISTINCT y AS place FROM pairs JOIN s a ON a.place = y JOIN s b ON b.place = x
  WHERE 9 * len(list_intersect(a.t, b.t)) >= 4 * (a.n + b.n)),
v AS (
  SELECT l.doc_id, l.i, l.line, len(l.t) > 0 AS word, coalesce(len(l.t) > 0 AND (row(l.doc_id, l.i) <> s.place OR bad.place IS NOT NULL), false) AS gone
  FROM l LEFT JOIN s ON s.t = l.t LEFT JOIN bad ON bad.place = s.place AND bad.place = row(l.doc_id, l.i))
SELECT doc_id, count_if(word)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM v GROUP BY doc_id"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.decontaminate import contained_items

    out = contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "n_found", "n_shingles")


OP9_SQL = r"""
WITH t AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (
  SELECT kind, id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[\x00-\x20!-/:-@\[-`{-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM t),
b AS (SELECT id, words, least(5, len(words)) AS width FROM w WHERE kind = 'b' AND len(words) > 0),
bg AS (
  SELECT DISTINCT id, width, array_to_string(words[i:i + width - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(words) - width + 2)) AS i FROM b)),
dg AS (
  SELECT DISTINCT id, width, array_to_string(words[i:i + width - 1], ' ') AS gram
  FROM (SELECT w.id, width, words, unnest(range(1, len(words) - width + 2)) AS i FROM w CROSS JOIN (SELECT DISTINCT width FROM b) WHERE kind = 'd' AND len(words) >= width)),
n AS (SELECT id, count(*) AS n FROM bg GROUP BY id)
SELECT dg.id AS doc_id, bg.id AS item_id, count(*) AS n_found, any_value(n.n) AS n_shingles
FROM dg JOIN bg USING (width, gram) JOIN n ON n.id = bg.id
GROUP BY dg.id, bg.id HAVING count(*) * 5 >= any_value(n.n) * 4"""


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.classifier import classify, fit

    docs = _table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op11_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.private_data import report

    return report(_table(spark, sf_dir, "documents"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.source_audit import audit

    return audit(_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
w AS (SELECT i, lang, source, unnest(words) AS w FROM d),
kept AS (SELECT lang, w FROM w GROUP BY lang, w HAVING count(DISTINCT i) >= 30),
v AS (SELECT lang, count(kept.w) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, w, count(*) AS n FROM w GROUP BY ALL),
full_grid AS (SELECT g.lang, g.source, kept.w, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, w)),
p AS (SELECT lang, source, w, n, 1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM full_grid JOIN v USING (lang)),
q AS (
  SELECT lang, w, 1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
  FROM (SELECT lang, w, sum(n) AS n FROM full_grid GROUP BY lang, w) JOIN v USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS a, y.source AS b, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.w = y.w AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.a = a.source AND s.b = b.source),
terms AS (SELECT lang, source, w AS item, p - q AS value FROM p JOIN q USING (lang, w) WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.conversation_repair import audit, damage

    return audit(damage(_table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_url_filter, op3_repeated_text, op4_quality_rules, op5_html_text, op6_sentence_pieces, op7_warc, op8_line_dedup, op9_decontamination, op10_quality_classifier, op11_private_data, op12_source_audit, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2_SQL, "op4_quality_rules": OP4_SQL, "op5_html_text": OP5_SQL, "op7_warc": OP7_SQL, "op8_line_dedup": OP8_SQL, "op9_decontamination": OP9_SQL, "op12_source_audit": OP12_SQL}
