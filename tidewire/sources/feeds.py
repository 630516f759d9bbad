"""Landed records as article rows: feeds, social posts, envelopes, nested documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.text import blank_to_null, parse_ts, short_hash, strip_html


def read_envelope(spark: SparkSession, path: str, field: str, item: str, missing_ok: bool = False) -> DataFrame:
    """Rows of JSON files that are a list of items or an object with the list under ``field``.

    The text is parsed with a declared schema; a file of neither shape fails the job. With ``missing_ok`` a path without files is
    an empty table.
    """
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if not missing_ok or e.getCondition() != "PATH_NOT_FOUND":
            raise
        whole = spark.createDataFrame([], "value string")
    kind = f"array<{item}>"
    rows = F.coalesce(F.get_json_object("value", f"$.{field}"), F.when(F.ltrim("value").startswith("["), F.col("value")))
    rows = F.when(F.assert_true(rows.isNotNull(), "neither a list nor an envelope").isNull(), rows)
    return whole.select(F.inline(F.filter(F.from_json(rows, kind), lambda x: x.isNotNull())))


def _summary(df: DataFrame) -> DataFrame:
    """Number of rows and a checksum of their contents, whatever their order and partitions; repeated rows count."""
    names = sorted(df.columns)
    text = F.to_json(F.struct(*(F.col(c) for c in names)), {"ignoreNullFields": "false"})
    return df.agg(F.count("*").alias("total_count"), F.coalesce(F.sum(F.xxhash64(text).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum"), F.lit(",".join(names)).alias("columns"))


def write_envelope(df: DataFrame, path: str) -> DataFrame:
    """Write rows as JSON lines under ``path``/rows, and one row of metadata under ``path``/meta, which is returned.

    Rows that are the same as those written last, by number and checksum of their contents, are not written again: then no
    file changes. The metadata is written last, so a run that ends early is made good by the next.
    """
    spark, meta = df.sparkSession, _summary(df)
    new = meta.first()
    old = _stored_meta(spark, path)
    if old is not None and (old.total_count, old.checksum, old.columns) == (new.total_count, new.checksum, new.columns):
        return spark.createDataFrame([new], META)
    if old is not None:  # stale once the rows are being replaced
        spark.createDataFrame([], META).write.mode("overwrite").json(f"{path}/meta")
    df.write.mode("overwrite").json(f"{path}/rows")
    out = spark.createDataFrame([new], META)
    out.coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    return out


META = "total_count long, checksum string, columns string"


def _stored_meta(spark: SparkSession, path: str) -> Row | None:
    try:
        return spark.read.schema(META).json(f"{path}/meta").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def active_sources(sources: DataFrame, kind: str) -> DataFrame:
    """Active sources with a name and url; party sources also need a candidate."""
    slugs = F.filter(F.transform("candidate_slugs", lambda s: F.trim(s)), lambda s: s != "")
    out = sources.where(F.col("active") & (F.col("kind") == kind) & blank_to_null("name").isNotNull() & blank_to_null("url").isNotNull())
    return out.withColumns({"candidate_slugs": slugs, "category": F.coalesce(blank_to_null("category"), F.lit(kind))}).where((F.lit(kind) != "party") | (F.size("candidate_slugs") > 0))


def published_at(fields: Sequence[str], collected: str) -> Column:
    """First parseable time in whole seconds: ISO or RFC-2822 text, else the collection time."""
    one = lambda f: F.coalesce(parse_ts(f), F.try_to_timestamp(F.regexp_replace(f, r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss XX")))
    return F.date_trunc("second", F.coalesce(*map(one, fields), F.col(collected)))


def feed_body(contents: str, summary: str, least: int = 200) -> Column:
    """First content of enough text before and after its tags are dropped, else the summary, else ''."""
    ok = lambda x: (F.length(x) >= least) & (F.length(strip_html(x)) >= least)
    first = F.get(F.filter(contents, ok), F.lit(0))
    return F.coalesce(strip_html(first), F.when(ok(F.col(summary)), strip_html(summary)), F.lit(""))


def feed_articles(entries: DataFrame) -> DataFrame:
    """Feed entries (link, entry_id, url, title, contents, summary, published, updated, collected_at) as raw articles."""
    url = F.coalesce(blank_to_null("link"), blank_to_null("entry_id"), blank_to_null("url"))
    rows = entries.withColumn("url", url).where("url IS NOT NULL")
    return rows.select("ordinal", short_hash("url").alias("id"), "url", F.coalesce(blank_to_null("title"), F.col("url")).alias("title"), feed_body("contents", "summary").alias("content"), published_at(["published", "updated"], "collected_at").alias("published_at"), F.lit("raw").alias("status"))


def social_articles(posts: DataFrame, inferred: Column) -> DataFrame:
    """Posts and videos (kind, url, text, query_candidate) as articles: a post keeps its query's candidate, a video
    needs an inferred one."""
    cands = F.when(F.col("kind") == "post", F.array_union(F.array("query_candidate"), inferred)).otherwise(inferred)
    title = F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 120)
    return posts.select("ordinal", short_hash("url").alias("id"), "url", title.alias("title"), F.lit("social").alias("source_category"), cands.alias("candidates_mentioned")).where(F.size("candidates_mentioned") > 0)


def search_documents(df: DataFrame) -> DataFrame:
    """(id, raw_text, doc) of the last row of each id."""
    text = F.concat_ws(" ", blank_to_null("title"), blank_to_null("summaries.pt"), blank_to_null("summaries.en"))
    rows = df.where(blank_to_null("id").isNotNull()).groupBy("id").agg(F.max_by(F.struct(text.alias("raw_text"), F.struct("title", "source", "status").alias("doc")), "ordinal").alias("x"))
    return rows.select("id", "x.raw_text", "x.doc")


def feed_export(df: DataFrame, n: int = 50) -> DataFrame:
    """Newest published rows for each of two languages."""
    top = df.where(F.col("status").isin("validated", "curated")).orderBy(F.col("published_at").desc_nulls_last(), "ordinal").limit(n)
    langs = F.explode(F.array(F.struct(F.lit("pt").alias("lang"), F.col("summaries.pt").alias("d")), F.struct(F.lit("en").alias("lang"), F.col("summaries.en").alias("d"))))
    rows = top.select("*", langs.alias("l"))
    return rows.select("ordinal", F.col("l.lang").alias("lang"), "title", F.col("url").alias("link"), F.coalesce(blank_to_null("l.d"), F.col("title")).alias("description"), F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'").alias("pub_date"), F.col("id").alias("guid"))


def flatten_topics(docs: DataFrame, column: str, item: str) -> DataFrame:
    """Rows (topic_id, key, fields) of a nested document {topics: {id: {candidates: {slug: {...}}}}} in JSON text."""
    kind = f"struct<topics:map<string,struct<candidates:map<string,{item}>>>>"
    topics = docs.select(F.explode(F.from_json(column, kind)["topics"]).alias("topic_id", "t"))
    return topics.select("topic_id", F.explode("t.candidates").alias("candidate", "x")).select("topic_id", "candidate", "x.*")


def annotation_batches(df: DataFrame, limit: int, size: int = 5) -> DataFrame:
    """Requests for annotation: first ``limit`` eligible unscored rows in ingest order, numbered off in groups.

    The rows are at most ``limit``, so their one window is small.
    """
    from pyspark.sql import Window as W

    text = F.coalesce(F.nullif(F.substring("content", 1, 600), F.lit("")), blank_to_null("summaries.pt"), F.col("title"))
    rows = df.orderBy("ordinal").limit(limit).withColumn("n", F.row_number().over(W.orderBy("ordinal")) - 1)
    return rows.select("id", "ordinal", F.floor(F.col("n") / size).cast("int").alias("batch"), (F.col("n") % size).cast("int").alias("place"), text.alias("text"))


def write_archive(cold: DataFrame, path: str, existing: DataFrame | None = None) -> None:
    """Append cold rows to month partitions, without those already there."""
    rows = cold if existing is None else cold.join(existing.select("id"), "id", "left_anti")
    rows.write.partitionBy("archive_month").mode("append").parquet(path)


def acceptable_scrape(df: DataFrame, text: str, paywalled: Column, least: int = 50) -> Column:
    return (F.col("status") == "raw") & (F.coalesce(F.trim("content"), F.lit("")) == "") & (F.length(text) > least) & ~paywalled
