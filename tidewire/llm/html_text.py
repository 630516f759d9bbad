"""Main text of web pages by wrapper induction over the pages of a host.

Each page is parsed once into a tree and its text blocks. Runs of siblings with the same label are one node, so the
trees of a host's pages are small and few. Trees that share ``ALIKE`` of their label paths are a layout; the most common
tree of a layout is its reference, and every other tree is aligned with it by simple tree matching (largest
order-preserving match of equal labels, Yang 1991). Aligned nodes are slots; a node without a match is the slot of its
label path, and all of a page too deep to be numbered is one slot. A block text that fills a slot on at least half of the
distinct contents of a layout (``LEAST`` or more) is template; what varies is content. Copies of a page, whose content
blocks are all equal, count once, so what only they share stays. Elements that are menus, headers, footers, sidebars,
notices, adverts, forms or comments by their tag or role are never content. A class or id says so only by a whole token of
such words, and not of a wrapper that holds a main element, the page's longest article or over ``MOST`` of its text; tokens
that merely contain such a word drop elements outside an article only while these hold at most ``LITTLE`` of the text.
Pages that mark an article or main element go through the same alignment. On them content lies inside the mark, and the
slots that it fills are content slots of the layout, on pages without a mark too: what fills them is never template, however
many pages of a host repeat it, so a byline stays. All other slots are judged by their texts.

Counts cover all pages and are combined before their shuffle; the parsed blocks are written once, and only hashes move.
Distinct contents are counted for texts that fill a slot on enough pages, copies included, as no others can be template.
Defined cases: null or blank html gives an empty text; a url without a host is a host of its own, ''; repeated rows and
null ids give a row each, with equal texts for equal pages of a host; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import stored

#: A text is template if it fills a slot on SHARE of a layout's distinct contents and on LEAST of them or more.
SHARE, LEAST = 0.5, 4
#: Shares of a page's text: a wrapper of more is not dropped by its class; all that parts of tokens drop is not more.
MOST, LITTLE = 0.5, 0.1
#: Share of all label paths of two trees of one layout that both have.
ALIKE = 0.5
#: Shape of a page too deep to be numbered.
DEEP = "#deep"

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S)
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "xmp")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var td th".split())
DROPPED = frozenset("head nav footer aside form button select option fieldset menu dialog object canvas audio video frameset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Words of a class or id that mark boilerplate; HEAD words do so only outside an article.
HINTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promos promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer cookie cookies consent gdpr notice notices popup popups modal overlay subscribe subscription newsletter signup login comment comments commentlist disqus respond reply replies discussion related recommended recommendations share sharing social widget widgets toolbar pager pagination copyright legal disclaimer search form alert toast".split())
HEAD = frozenset("header masthead topbar".split())
#: Words that may stand beside such a word in a token without changing what it says.
NEUTRAL = frozenset("site page global left right top bottom primary secondary list item items block box bar wrap wrapper container section area inner outer link links button buttons icon icons thread".split())
KEPT = frozenset("html body main article".split())
#: An open element that the start of another one ends.
ENDS = {t: frozenset(("p",)) for t in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
ENDS |= {"li": frozenset(("li", "p")), "dt": frozenset(("dt", "dd", "p")), "dd": frozenset(("dt", "dd", "p")), "tr": frozenset(("tr",)), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",)), "tbody": frozenset(("tr", "thead", "td", "th"))}
SCOPE = frozenset("ul ol dl table article section div body html".split())
ROWS = frozenset(("table",))


class _Node:
    __slots__ = ("tag", "label", "kids", "block", "drop", "area", "number", "hint", "size")

    def __init__(self, tag: str, label: str, drop: bool, area: bool, hint: int = 0) -> None:
        self.tag, self.label, self.kids, self.drop, self.area = tag, label, [], drop, area
        self.hint, self.size = hint, 0
        self.block = tag not in INLINE


@lru_cache(4096)
def _words(value: str) -> frozenset[str]:
    return frozenset(w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()) if w)


def _hint(value: str, hints: frozenset[str]) -> int:
    """2 if a token of a class or id says that the element is boilerplate, 1 if one contains such a word, else 0."""
    best = 0
    for token in value.split():
        words = _words(token)
        if words & hints:
            best = max(best, 2 if words <= hints | NEUTRAL else 1)
    return best


@lru_cache(8192)
def _judge(tag: str, attrs: str, inside: bool) -> tuple[str, bool, int]:
    """(label, whether it is boilerplate by tag, role or style, hint of class and id) of a start tag."""
    found = {m[0].lower(): entities.unescape(m[1] or m[2] or m[3]) for m in ATTR.findall(attrs)} if attrs.strip(" /") else {}
    named = found.get("class", "") + " " + found.get("id", "")
    label = tag + "".join(f".{w}" for w in sorted(_words(named))[:6])
    if tag in KEPT:
        return label, False, 2 if tag == "article" and _hint(named, HINTS) == 2 else 0
    drop = tag in DROPPED or (tag == "header" and not inside)
    drop |= found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")))
    return label, drop, _hint(named, HINTS if inside else HINTS | HEAD)


def _settle(blocks: list[tuple[_Node, bool, tuple[_Node, ...], str]]) -> None:
    """Turn hints into drops: needs the text that each hinted element, article and main element of a page holds."""
    total = 0
    for _, dropped, around, words in blocks:
        if not dropped:
            total += len(words)
            for n in around:
                n.size += len(words)
    if not any(n.hint for _, _, around, _ in blocks for n in around):
        return
    nodes = {id(n): n for _, dropped, around, _ in blocks if not dropped for n in around}
    longest = max((n for n in nodes.values() if n.tag == "article" and not n.hint and n.size > LITTLE * total), key=lambda n: n.size, default=None)
    holds = set()
    for _, dropped, around, _ in blocks:
        if not dropped:
            last = max((i for i, n in enumerate(around) if n is longest or n.tag == "main"), default=0)
            holds.update(id(n) for n in around[:last])
    hinted = [n for n in nodes.values() if n.hint and id(n) not in holds and n.size <= MOST * total]
    for n in hinted:
        n.drop = n.hint == 2
    free = {id(n) for n in hinted if n.hint == 1}
    weak, held = set(), 0
    for _, dropped, around, words in blocks:
        if dropped or any(n.drop for n in around):
            continue
        inner = max((i + 1 for i, n in enumerate(around) if n.tag == "article"), default=0)
        mine = [id(n) for i, n in enumerate(around) if id(n) in free and i >= inner]
        weak.update(mine)
        held += len(words) * bool(mine)
    if held <= LITTLE * total:
        for k in weak:
            nodes[k].drop = True


def parse(page: str | None) -> tuple[str, list[tuple[int, bool, str]]]:
    """``(shape, blocks)`` of a page: its collapsed tree, and (node, kept, text) of each text block in page order."""
    shape, _, blocks = parse_marked(page)
    return shape, blocks


def parse_marked(page: str | None) -> tuple[str, bool, list[tuple[int, bool, str]]]:
    """The same, with whether the page marks its article or main element; then only blocks inside it are kept."""
    text = page or ""
    root = _Node("#", "#", False, False)
    stack, blocks, run = [root], [], []
    marked: set[str] = set()

    def flush() -> None:
        if run:
            words = " ".join("".join(run).split())
            run.clear()
            if words:
                node = next(n for n in reversed(stack) if n.block)
                blocks.append((node, any(n.drop for n in stack), tuple(n for n in stack if n.area or n.hint), words))

    def put(piece: str) -> None:
        run.append(entities.unescape(piece) if "&" in piece else piece)

    at, size = 0, len(text)
    while at < size:
        m = TOKEN.search(text, at)
        if m is None:
            put(text[at:])
            break
        if m.start() > at:
            put(text[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                put(m[0][9:-3])
            continue
        tag = tag.lower()
        if m[1]:
            # an inline end tag does not reach past the nearest block
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if any(n.block for n in stack[k:]):
                        flush()
                    elif tag in ("td", "th"):
                        run.append(" ")
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].block or stack[k].tag in ("table", "article") and tag in ("div", "section", "p", "li"):
                    break
            continue
        if tag in RAW:
            end = RAW[tag].search(text, at)
            at = end.end() if end else size
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "img", "input"):
                run.append(" ")
            continue
        if tag in ENDS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ENDS[tag]:
                    if any(n.block for n in stack[k:]):
                        flush()
                    del stack[k:]
                    break
                if stack[k].tag in (ROWS if tag == "tr" else SCOPE):
                    break
        label, drop, hint = _judge(tag, m[3] or "", "article" in marked and any(n.tag == "article" for n in stack))
        node = _Node(tag, label, drop, tag in ("article", "main") and not drop, hint)
        if node.block:
            flush()
        elif tag in ("td", "th"):
            run.append(" ")
        if node.area:
            marked.add(tag)
        if node.block:
            next(n for n in reversed(stack) if n.block).kids.append(node)
        if not (m[3] or "").endswith("/") or tag not in ("path", "rect", "use"):
            stack.append(node)
    flush()
    _settle(blocks)
    blocks = [(node, dropped or any(n.drop for n in around), {n.tag for n in around if n.area}, words) for node, dropped, around, words in blocks]
    # collapse runs of equal siblings and number the nodes in order
    shape: list[str] = []
    count = 0

    def walk(nodes: list[_Node]) -> None:
        nonlocal count
        i = 0
        while i < len(nodes):
            same = [nodes[i]]
            while i + len(same) < len(nodes) and nodes[i + len(same)].label == nodes[i].label:
                same.append(nodes[i + len(same)])
            i += len(same)
            for n in same:
                n.number = count
            count += 1
            shape.append(same[0].label)
            kids = [k for n in same for k in n.kids]
            if kids and len(shape) < 400:
                shape.append("(")
                walk(kids)
                shape.append(")")
            elif kids:
                _number(kids, same[0].number)

    def _number(nodes: list[_Node], number: int) -> None:
        todo = list(nodes)
        while todo:
            n = todo.pop()
            n.number = number
            todo += n.kids

    deep = max((len(s) for s in _depths(root)), default=0)
    if deep < 150:
        root.number = -1
        walk(root.kids)
    else:
        _number([root], -1)
        shape.append(DEEP)
    area = "article" if any(not d and "article" in a for _, d, a, _ in blocks) else "main" if any(not d and "main" in a for _, d, a, _ in blocks) else None
    return " ".join(shape), area is not None, [(n.number, not drop and (area is None or area in areas), words) for n, drop, areas, words in blocks]


def _depths(root: _Node) -> Iterator[range]:
    level, todo = 0, [root]
    while todo:
        level += 1
        yield range(level)
        todo = [k for n in todo for k in n.kids]


def _tree(shape: str) -> list:
    """[label, number, kids] lists of a shape."""
    top: list = []
    stack, number = [top], 0
    for token in shape.split():
        if token == "(":
            stack.append(stack[-1][-1][2])
        elif token == ")":
            stack.pop()
        else:
            stack[-1].append([token, number, []])
            number += 1
    return top


def _paths(shape: str) -> list[str]:
    """Label path of each node of a shape."""
    out: list[str] = []
    stack, last = [""], ""
    for token in shape.split():
        if token == "(":
            stack.append(last)
        elif token == ")":
            stack.pop()
        else:
            last = f"{stack[-1]}/{token}"
            out.append(last)
    return out


def align(shape: str, reference: str) -> list[int]:
    """For each node of a shape the matching node of the reference, or -1: simple tree matching."""
    memo: dict[tuple[int, int], int] = {}

    def forest(a: list, b: list) -> list[list[int]]:
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + match(x, y))
        return m

    def match(x: list, y: list) -> int:
        if x[0] != y[0]:
            return 0
        if (x[1], y[1]) not in memo:
            memo[x[1], y[1]] = 1 + forest(x[2], y[2])[-1][-1]
        return memo[x[1], y[1]]

    mine, theirs = _tree(shape), _tree(reference)
    out = [-1] * sum(t not in "()" for t in shape.split())

    def trace(a: list, b: list) -> None:
        m = forest(a, b)
        i, j = len(a), len(b)
        while i and j:
            if m[i][j] == m[i - 1][j]:
                i -= 1
            elif m[i][j] == m[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out[a[i][1]] = b[j][1]
                trace(a[i][2], b[j][2])

    trace(mine, theirs)
    return out


def _parsed(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    kind = pages.schema[key].dataType.simpleString()
    block = pa.list_(pa.struct([("node", pa.int32()), ("kept", pa.bool_()), ("text", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                shapes, marked, blocks = zip(*(parse_marked(x) for x in part.column(3).to_pylist()), strict=True)
                rows = [[{"node": n, "kept": k, "text": t} for n, k, t in b] for b in blocks]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(shapes), pa.array(marked, pa.bool_()), pa.array(rows, block)], names=["key", "url", "host", "shape", "marked", "blocks"])

    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host.alias("host"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(run, f"key {kind}, url string, host string, shape string, marked boolean, blocks array<struct<node:int,kept:boolean,text:string>>")


def _layouts(shapes: DataFrame) -> DataFrame:
    """``(host, shape, reference)``: a shape joins the commoner shape of its host that it is most alike, if any."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_host, sizes, leaders, having = None, [], [], {}
        for batch in batches:
            out = []
            for host, shape in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if host != open_host:
                    open_host, sizes, leaders, having = host, [], [], {}
                paths = set(_paths(shape))
                shared: dict[int, int] = {}
                for x in paths:
                    for k in having.get(x, ()):
                        shared[k] = shared.get(k, 0) + 1
                best, at = max(((n / (len(paths) + sizes[k] - n), -k) for k, n in shared.items()), default=(0.0, 0))
                if best >= ALIKE:
                    out.append(leaders[-at])
                    continue
                for x in paths:
                    having.setdefault(x, []).append(len(leaders))
                sizes.append(len(paths))
                leaders.append(shape)
                out.append(shape)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["host", "shape", "reference"])

    ranked = shapes.repartition("host").sortWithinPartitions("host", F.desc("n"), "shape")
    return ranked.select("host", "shape").mapInArrow(run, "host string, shape string, reference string")


def _slots(shape: str, reference: str) -> list[int]:
    """Slot of each node: its match in the reference, or else a number above all nodes that stands for its path."""
    return [s if s >= 0 else (1 << 32) + zlib.crc32(x.encode("utf-8", "replace")) for s, x in zip(align(shape, reference), _paths(shape), strict=True)]


def _aligned(layouts: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_slots(a, b) for a, b in pairs], pa.list_(pa.int64()))], names=["host", "shape", "reference", "slots"])

    rows = layouts.repartition("host", "shape").mapInArrow(run, "host string, shape string, reference string, slots array<long>")
    return rows.withColumn("layout", F.xxhash64("reference")).drop("reference")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(key, url, text, n_chars, n_template)`` for every row: blocks of the main text joined by a line break."""
    parsed = stored(_parsed(pages, key, url, html), "blocks")
    shapes = parsed.groupBy("host", "shape").agg(F.count("*").alias("n"))
    slots = stored(_aligned(_layouts(shapes)).withColumn("sid", F.xxhash64("shape")).drop("shape"), "slots")
    parsed = parsed.withColumn("sid", F.xxhash64("shape")).drop("shape")
    cells = F.transform(F.filter("blocks", lambda b: b.kept), lambda b: F.struct(b.node.alias("node"), F.xxhash64(b.text).alias("h")))
    content = F.xxhash64(F.transform(F.filter("blocks", lambda b: b.kept), lambda b: b.text))
    page = ["host", "sid", "marked"]
    slim = parsed.select(*page, F.explode(F.array_distinct(cells)).alias("c")).groupBy(*page, "c").agg(F.count("*").alias("n"))
    slot = F.when(F.col("c.node") >= 0, F.get("slots", F.col("c.node"))).otherwise(-1)
    filled = stored(slim.join(slots.hint("merge"), ["host", "sid"]).select(*page, "layout", "c", "n", slot.alias("slot"), F.col("c.h").alias("h")), "filled")
    cell = ["host", "layout", "slot", "h"]
    # the slots of marked content; -1 is no place that a page without a mark shares
    held = filled.where("marked AND slot >= 0").select("host", "layout", "slot").distinct()
    judged = filled.where("NOT (marked AND slot < 0)").join(stored(held, "held").hint("merge"), ["host", "layout", "slot"], "left_anti")
    contents = parsed.select("host", "sid", content.alias("content")).distinct()
    contents = contents.join(slots.select("host", "sid", "layout").hint("merge"), ["host", "sid"]).groupBy("host", "layout").agg(F.count_distinct("content").alias("contents"))
    # pages are no fewer than contents; written and read back, as below
    often = judged.groupBy(*cell).agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    often = often.join(contents.hint("merge"), ["host", "layout"]).where(F.col("n") >= SHARE * F.col("contents")).select(*cell)
    maybe = stored(judged.join(often.hint("merge"), cell).groupBy(*page, "layout").agg(F.collect_list(F.struct("c", "slot")).alias("maybe")), "maybe")
    seen = F.filter("maybe", lambda m: F.array_contains("cells", m.c))
    exact = parsed.select(*page, cells.alias("cells"), content.alias("content")).join(maybe, page).select("host", "layout", "content", F.explode(F.transform(seen, lambda m: F.struct(m.slot.alias("slot"), m.c.h.alias("h")))).alias("m"))
    constant = exact.select("host", "layout", "m.slot", "m.h", "content").groupBy(*cell).agg(F.count_distinct("content").alias("n")).where(F.col("n") >= LEAST)
    constant = constant.join(contents.hint("merge"), ["host", "layout"]).where(F.col("n") >= SHARE * F.col("contents")).select(*cell)
    listed = maybe.select(*page, "layout", F.explode("maybe").alias("m")).select(*page, "layout", "m.slot", F.col("m.c.h").alias("h"), "m.c")
    template = listed.join(constant.hint("merge"), cell).groupBy(*page).agg(F.collect_set("c").alias("template"))
    # written and read back: its true size decides between a broadcast and a sort-merge join
    joined = parsed.join(stored(template, "template"), page, "left")
    is_template = lambda b: F.coalesce(F.array_contains("template", F.struct(b.node.alias("node"), F.xxhash64(b.text).alias("h"))), F.lit(False))
    kept = joined.withColumn("kept", F.transform(F.filter("blocks", lambda b: b.kept & ~is_template(b)), lambda b: b.text))
    text = F.array_join("kept", "\n")
    return kept.select(F.col("key").alias(key), F.col("url").alias(url), text.alias("text"), F.length(text).cast("long").alias("n_chars"), (F.size(F.filter("blocks", lambda b: b.kept)) - F.size("kept")).alias("n_template"))
