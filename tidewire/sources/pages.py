"""Facts read from page html: main text, link ladders, polls. Small per-row parsers inside Arrow batches."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIPPED = frozenset(("script", "style", "nav", "footer", "header", "aside"))
UNSEEN = frozenset(("script", "style"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
#: Containers in the order in which they are tried, by tag, role, class or id.
CONTAINERS = ("article", "[role='main']", "main", ".post-content", ".article-content", ".article-body", ".entry-content", ".content", "#content")
#: Fixed value: what the address of a news page looks like.
NEWS = re.compile(r"/(noticias?|news|20\d{2}/)", re.IGNORECASE)


class _Element:
    """A tag with its attributes, and where its text begins and ends among the pieces of the page."""

    def __init__(self, tag: str, attrs: dict[str, str], at: int, place: int, skipped: bool):
        self.tag, self.attrs, self.start, self.end = tag, attrs, at, at
        self.place = self.last = place
        self.skipped = skipped
        self.marks = {tag, *(f".{c}" for c in attrs.get("class", "").split()), f"#{attrs.get('id', '')}", f"[role='{attrs.get('role', '')}']"}


class _Reader(HTMLParser):
    """The elements of a page in order, each a range of pieces of text and of later elements."""

    def __init__(self) -> None:
        super().__init__()
        self.stack: list[_Element] = []
        self.elements: list[_Element] = []
        self.pieces: list[tuple[str, bool, bool]] = []
        self.depth: Counter[str] = Counter()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        e = _Element(tag, {k: v or "" for k, v in reversed(attrs)}, len(self.pieces), len(self.elements), any(self.depth[t] for t in SKIPPED))
        self.elements.append(e)
        if tag not in VOID:
            self.stack.append(e)
            self.depth[tag] += 1

    def _close(self, e: _Element) -> None:
        e.end, e.last = len(self.pieces), len(self.elements) - 1
        self.depth[e.tag] -= 1

    def handle_endtag(self, tag: str) -> None:
        if self.depth[tag]:
            while True:
                e = self.stack.pop()
                self._close(e)
                if e.tag == tag:
                    break

    def handle_data(self, data: str) -> None:
        self.pieces.append((data, any(self.depth[t] for t in SKIPPED), any(self.depth[t] for t in UNSEEN)))

    def finish(self) -> None:
        while self.stack:
            self._close(self.stack.pop())

    def text(self, e: _Element | None, skip: bool) -> str:
        """Text of an element, or of all, without what is never seen, or without all that is skipped."""
        return _line(t for t, skipped, unseen in self.pieces[e.start : e.end] if not (skipped if skip else unseen)) if e else ""

    def within(self, e: _Element, tag: str) -> Iterator[_Element]:
        return (x for x in self.elements[e.place + 1 : e.last + 1] if x.tag == tag)

    def ld(self) -> Iterator[str]:
        return ("".join(t for t, _, _ in self.pieces[e.start : e.end]) for e in self.elements if e.tag == "script" and e.attrs.get("type") == "application/ld+json")


def _read(html: str | None) -> _Reader:
    r = _Reader()
    try:
        r.feed(html or "")
        r.close()
    except (ValueError, AssertionError):
        pass  # what was read so far counts
    r.finish()
    return r


def _line(parts: Iterable[str]) -> str:
    return " ".join(" ".join(parts).split())


def _main_text(r: _Reader, least: int = 100) -> str:
    for mark in CONTAINERS:
        first = next((e for e in r.elements if mark in e.marks and not e.skipped and e.tag not in SKIPPED), None)
        text = r.text(first, True)
        if len(text) > least:
            return text
    body = next((e for e in r.elements if e.tag == "body"), None)
    if body:
        return r.text(body, True)
    head = next((e for e in r.elements if e.tag in ("head", "title")), None)
    return _line(t for i, (t, skipped, _) in enumerate(r.pieces) if not skipped and not (head and head.start <= i < head.end))


def main_text(html: str | None, least: int = 100) -> str:
    return _main_text(_read(html), least)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, text): of each container mark only the first element counts; the first of them with over 100 characters, else
    the body."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b.page_id, "text": b.html.map(main_text)})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, text string")


def _nodes(value: object) -> Iterator[dict]:
    if isinstance(value, dict):
        yield value
        for v in value.values():
            yield from _nodes(v)
    elif isinstance(value, list):
        for v in value:
            yield from _nodes(v)


def _stated_articles(r: _Reader) -> Iterator[tuple[str, str]]:
    """(url, title) of the article nodes of JSON-LD."""
    for text in r.ld():
        try:
            nodes = list(_nodes(json.loads(text)))
        except ValueError:
            continue
        for n in nodes:
            kinds = n.get("@type") if isinstance(n.get("@type"), list) else [n.get("@type")]
            if not any(isinstance(k, str) and k.lower() in ("newsarticle", "article") for k in kinds):
                continue
            page = n.get("mainEntityOfPage")
            page = (page.get("@id") or page.get("url")) if isinstance(page, dict) else page
            url = n["url"] if isinstance(n.get("url"), str) else page
            title = next((n[k] for k in ("headline", "name") if isinstance(n.get(k), str)), None)
            if isinstance(url, str) and title is not None:
                yield url, title


def _anchors(r: _Reader) -> Iterator[tuple[str, str]]:
    """(href, title) of the links of articles, then of headings, then of those that look like news."""
    linked = lambda e: (x for x in r.within(e, "a") if "href" in x.attrs)
    for e in r.elements:
        if e.tag == "article":
            yield from ((x.attrs["href"], r.text(x, False)) for x in linked(e))
    for e in r.elements:
        if e.tag in ("h2", "h3"):
            first = next(linked(e), None)
            if first:
                yield first.attrs["href"], r.text(first, False) or r.text(e, False)
    for e in r.elements:
        if e.tag == "a" and NEWS.search(e.attrs.get("href", "")):
            yield e.attrs["href"], r.text(e, False)


def _unique(found: Iterable[tuple[str, str]], base: str) -> list[tuple[str, str]]:
    """Links with a title, resolved, the first of each place."""
    out: dict[str, str] = {}
    for url, title in found:
        url, title = url.strip(), " ".join(title.split())
        if not url or not title:
            continue
        try:
            place = urljoin(base, url)
        except ValueError:  # no address at all
            continue
        if place:
            out.setdefault(place, title)
    return list(out.items())


def link_ladder(url: str | None, html: str | None) -> tuple[int, list[tuple[str, str]]]:
    """(rung, links) of the first rung with any: JSON-LD articles, Open Graph, anchors, first heading with the canonical address."""
    r, base = _read(html), url or ""
    named = lambda name: next((e.attrs.get("content") for e in r.elements if e.tag == "meta" and e.attrs.get("property") == name), None)
    head = next((e for e in r.elements if e.tag in ("h1", "h2")), None)
    canonical = next((e for e in r.elements if e.tag == "link" and "canonical" in e.attrs.get("rel", "").split()), None)
    rungs = (
        lambda: _stated_articles(r),
        lambda: [(named("og:url"), named("og:title"))] if named("og:url") is not None and named("og:title") is not None else [],
        lambda: _anchors(r),
        lambda: [(canonical.attrs["href"] if canonical and "href" in canonical.attrs else base, r.text(head, False))] if head else [],
    )
    for k, rung in enumerate(rungs):
        links = _unique(rung(), base)
        if links:
            return k + 1, links
    return 0, []


def extract_links(pages: DataFrame) -> DataFrame:
    """(page_id, rung, link, title) of every page with links."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, k, h, t) for p, u, x in zip(b.page_id, b.url, b.html, strict=True) for k, links in [link_ladder(u, x)] for h, t in links]
            yield pd.DataFrame(rows, columns=["page_id", "rung", "link", "title"])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, rung int, link string, title string")


def party_articles(links: DataFrame, pages: DataFrame, sources: DataFrame, existing: DataFrame) -> DataFrame:
    """Links of pages as raw articles with their source's candidates (host, candidate_slugs), without known ids; of
    several links to one place that of the first page counts."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1))
    rows = links.join(pages.select("page_id", host.alias("host")).hint("merge"), "page_id").join(sources.hint("merge"), "host")
    first = rows.groupBy(F.substring(F.sha2("link", 256), 1, 16).alias("id")).agg(F.min_by(F.struct("link", "title", "candidate_slugs"), F.struct("page_id", "host", "title")).alias("x"))
    rows = first.select("id", F.col("x.link").alias("url"), "x.title", F.lit("party").alias("source_category"), F.col("x.candidate_slugs").alias("candidates_mentioned"), F.lit("raw").alias("status"))
    return rows.join(existing.select("id").hint("merge"), "id", "left_anti")


def stated_results(html: str | None) -> list[tuple[str, str]]:
    """(name, percentage) pairs that the JSON-LD of a page states, in any node, as texts."""
    found = []
    for text in _read(html).ld():
        try:
            nodes = list(_nodes(json.loads(text)))
        except ValueError:
            continue
        for n in nodes:
            name = next((n[k] for k in ("candidate", "name", "candidate_name") if n.get(k)), None)
            share = next((n[k] for k in ("percentage", "percent", "value", "votos") if n.get(k)), None)
            if isinstance(name, str) and isinstance(share, (str, int, float)):
                found.append((name, str(share)))
    return found


def extract_polls(pages: DataFrame, names: str) -> DataFrame:
    """(page_id, institute, day, type, sample_size, margin, confidence, registration, results, snippet) of pages that
    name an institute and give candidates a percentage: in JSON-LD, of which the last for each candidate counts, else in
    the text, tables included, within 20 characters after a known name (``names`` is an alternation)."""
    from tidewire.functions import polls as P

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            stated = [[{"w": w, "p": p} for w, p in stated_results(x)] for x in b.html]
            yield pd.DataFrame({"page_id": b.page_id, "text": b.html.map(main_text), "stated": stated})

    rows = pages.select("page_id", "html").mapInPandas(run, "page_id long, text string, stated array<struct<w:string,p:string>>")
    rows = rows.withColumn("institute", P.institute_of("text")).where("institute IS NOT NULL")
    pattern = rf"(?i)({names})\D{{0,20}}(\d{{1,3}}(?:[.,]\d+)?)\s*%"
    who, pct = F.regexp_extract_all("text", F.lit(pattern), 1), F.regexp_extract_all("text", F.lit(pattern), 2)
    read = lambda x: F.struct(P.poll_candidate(x.w).alias("candidate"), P.coerce_pct(x.p).alias("pct"))
    known = lambda pairs: F.filter(F.transform(pairs, read), lambda r: r.candidate.isNotNull() & r.pct.isNotNull())
    rows = rows.withColumns({"stated": known("stated"), "said": known(F.arrays_zip(who.alias("w"), pct.alias("p")))})
    last = F.filter("stated", lambda r, i: ~F.exists(F.slice("stated", i + 2, F.size("stated")), lambda o: o.candidate == r.candidate))
    results = F.when(F.size("stated") > 0, last).otherwise(F.col("said"))
    out = rows.select("page_id", "institute", P.poll_date("text").alias("day"), P.poll_type("text").alias("type"), P.sample_size("text").alias("sample_size"), P.margin_of_error("text").alias("margin"), P.confidence_level("text").alias("confidence"), P.registration("text").alias("registration"), results.alias("results"), F.substring("text", 1, 500).alias("snippet"))
    return out.where(F.size("results") > 0)
