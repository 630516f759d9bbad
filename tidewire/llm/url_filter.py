"""URL filters: host and path rules, and block decisions that follow redirects and canonical links.

A rule fits its host and every subdomain if the path starts with the rule's; the longest wins (allow on a tie).
Redirect and canonical-link edges join urls into classes of aliases (distributed connected components). A url without
a rule is blocked if any alias of its class is blocked; a url that a rule allows stays allowed.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule and no alias, and is allowed;
null html has no edges; rows are judged one by one; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.graph import connected_components
from tidewire.session import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
#: Rules up to this number are matched in the row; beyond it they are a table joined on host suffixes.
INLINE = 1000
#: (verdict, host, path) of the default list.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def parts(url: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    return {"host": F.translate(F.regexp_extract(u, PARTS, 1), UPPER, LOWER), "path": F.regexp_extract(u, PARTS, 2), "query": F.regexp_extract(u, PARTS, 3)}


def _inline(rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (n, allow, rule, verdict) of the winning rule over columns host and path, or null."""
    found = [F.when(((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p)), F.struct(F.lit(len(h + p)).alias("n"), F.lit(v == "allow").alias("allow"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.array_max(F.array_compact(F.array(*found))) if found else F.lit(None).cast("struct<n:int,allow:boolean,rule:string,verdict:string>")


def match_rules(urls: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """Add ``win`` (the winning rule or null) to rows with host and path.

    A list of at most ``INLINE`` rules is part of the expression. A larger list or a table (verdict, host, path) is
    joined on each distinct host-and-path's suffixes; a hot suffix is split by adaptive execution.
    """
    if not isinstance(rules, DataFrame) and len(rules) <= INLINE:
        return urls.withColumn("win", _inline(rules))
    if not isinstance(rules, DataFrame):
        rules = urls.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
    table = rules.select(F.col("host").alias("suffix"), F.struct(F.length(F.concat("host", "path")).alias("n"), (F.col("verdict") == "allow").alias("allow"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("verdict")).alias("r"), F.col("path").alias("p"))
    keys = urls.select("host", "path").distinct()
    labels = F.split("host", "\\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    wins = keys.select("host", "path", suffix.alias("suffix")).join(table.hint("merge"), "suffix").where(F.startswith("path", "p")).groupBy("host", "path").agg(F.max("r").alias("win"))
    return urls.join(wins.hint("merge"), ["host", "path"], "left")


def _node(host: Column, path: Column, query: Column) -> Column:
    return F.when(host != "", F.concat(host, path, query))


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(src, dst)`` absolute urls of canonical links and meta refreshes in the pages."""
    page = pages.select(F.col(url).alias("src"), F.regexp_replace(html, "(?s)<!--.*?-->", "").alias("h")).where("src IS NOT NULL AND rlike(h, '(?i)canonical|refresh')")
    tags = page.select("src", F.explode(F.regexp_extract_all("h", F.lit("(?is)(<(?:link|meta)\\b[^>]*>)"), 1)).alias("tag"))
    pick = lambda name: F.concat(*(F.regexp_extract("tag", f"(?is)\\b{name}\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s>\"']+))", i) for i in (1, 2, 3)))
    canonical = F.when(F.lower("tag").startswith("<link") & F.array_contains(F.split(F.lower(F.trim(pick("rel"))), "\\s+"), "canonical"), pick("href"))
    refresh = F.when(F.lower("tag").startswith("<meta") & (F.lower(F.trim(pick("http-equiv"))) == "refresh"), F.regexp_extract(pick("content"), "(?is)url\\s*=\\s*['\"]?([^'\"]*)", 1))
    to = F.replace(F.trim(F.coalesce(canonical, refresh)), F.lit("&amp;"), F.lit("&"))
    links = tags.select("src", to.alias("to")).where("to <> ''")
    scheme = F.regexp_extract("src", "(?s)^(.*?)://", 1)
    root = F.regexp_extract("src", "(?s)^(.*?://[^/?#]*)", 1)
    base = F.regexp_extract("src", "(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    whole = F.when(F.col("to").rlike("(?i)^[a-z][a-z0-9+.-]*://"), F.col("to")).when(F.startswith("to", F.lit("//")), F.concat(scheme, F.lit(":"), "to")).when(F.startswith("to", F.lit("/")), F.concat(root, "to"))
    return links.select("src", F.coalesce(whole, F.concat(base, F.when(~base.endswith("/"), "/").otherwise(""), "to")).alias("dst")).distinct()


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, redirects: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(key, url, host, path, rule, verdict, by)`` for every row; ``by`` is rule, alias or default.

    ``redirects`` (src, dst) adds edges from a crawl log to those found in the pages.
    """
    rows = pages.select(F.col(key), F.col(url).alias("url")).withColumns(parts(F.col("url")))
    rows = match_rules(rows.withColumn("node", _node(F.col("host"), F.col("path"), F.col("query"))), rules)
    edges = page_edges(pages, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("src", "dst"))
    ends = {k: parts(F.col(k)) for k in ("src", "dst")}
    links = stored(edges.select(*(_node(p["host"], p["path"], p["query"]).alias(k) for k, p in ends.items()), *(p[x].alias(f"{k}_{x}") for k, p in ends.items() for x in ("host", "path"))), "links")
    classes = connected_components(links, "src", "dst")
    nodes = links.select(F.explode(F.array(*(F.struct(F.col(k).alias("node"), F.col(f"{k}_host").alias("host"), F.col(f"{k}_path").alias("path")) for k in ends))).alias("x")).select("x.*").where("node IS NOT NULL").distinct()
    bad = match_rules(nodes, rules).where("win.verdict = 'block'").select("node")
    blocked = classes.join(bad.hint("merge"), "node").select("component").distinct()
    aliases = classes.join(blocked.hint("merge"), "component").select("node", F.lit(True).alias("aliased"))
    out = rows.join(aliases.hint("merge"), "node", "left")
    by = F.when(F.col("win").isNotNull(), "rule").when(F.col("aliased"), "alias").otherwise("default")
    verdict = F.coalesce("win.verdict", F.when(F.col("aliased"), "block"), F.lit("allow"))
    return out.select(key, "url", "host", "path", F.col("win.rule").alias("rule"), verdict.alias("verdict"), by.alias("by"))
