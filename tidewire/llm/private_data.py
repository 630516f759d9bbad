"""Personal data: patterns, and terms that give away whom a pattern belongs to, by their information content.

``find`` reads e-mail addresses, IP addresses, card and phone numbers from whole texts. Each value is an entity to protect. What
else would disclose it is estimated from the whole corpus: a term that stands within ``NEAR`` characters of entity e in
``n_te`` of the ``n_t`` documents that hold it discloses the share PMI(t; e) / IC(e) = 1 + log(n_te / n_t) / log(N / n_e) of what there is
to know about e, with N documents of which ``n_e`` hold e. From ``DISCLOSED`` on, the term is generalised in the documents where it
stands near e, from ``REMOVED`` on it is removed. Copies are no evidence: a pair counts only if it stands in different
surroundings in two documents at least. What stands in every document has no content to disclose.

A document gives at most one row for each of its pairs; counts are combined before their shuffle, so an entity or a
term in a third of all documents is a count like any other. Pairs that disclose meet the pairs of the documents in a
plain join of two written tables. Texts are never shuffled: only those with an entity are written, and meet their terms by
row.

Defined cases: a null text is an empty one and has no spans; every row is a document, so repeated rows have repeated
results and a null id is an id; extra columns, whatever their names, are left out; an empty table gives an empty table. In a
document without an entity nothing is touched. Spans are in code points, their ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.session import stored

KINDS = ("email", "ip", "card", "phone", "term")
NEAR, LEAST_LETTERS, DISCLOSED, REMOVED = 100, 3, 0.75, 0.95
#: Rows of one batch that leaves a task.
OUT = 1 << 14

# The patterns, without steps back into a run: a number is only looked at from its first digit on.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
ADDRESS = re.compile(r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An address starts where the run of characters before its @ does, so only the surroundings of each @ are read."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _part(digits: str) -> int:
    short = digits.lstrip("0")
    return int(short[:4] or 0)  # from four digits on it is too much, however many follow


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, in order; matches that fail their test are dropped, not tried again."""
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in ADDRESS.finditer(text) if all(_part(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out)


def entity(kind: int, value: str) -> bytes:
    """Digest of what a span stands for, however it is written."""
    value = value.lower() if kind == 0 else ".".join(str(_part(p)) for p in value.split(".")) if kind == 1 else _digits(value)
    return hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=16).digest()


def _words(text: str) -> set[str]:
    return {w.lower() for w in set(WORD.findall(text)) if len(w) >= LEAST_LETTERS}


def _outside(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, term) of the words that no span covers, in order."""
    k, edge = 0, 0
    for m in WORD.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            edge, k = max(edge, spans[k][2]), k + 1
        if m.start() >= edge and m.end() - m.start() >= LEAST_LETTERS:
            yield m.start(), m.end(), m.group().lower()


def pairs(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[bytes, str | None, int | None]]:
    """(entity, term, hash of the surroundings) for every span and each different whole word within ``NEAR`` characters; for each
    span one without a term as well."""
    words = list(_outside(text, spans)) if spans else []
    low = 0
    for start, kind, end in spans:
        while low < len(words) and words[low][0] < start - NEAR:
            low += 1
        high, near = low, []
        while high < len(words) and words[high][1] <= end + NEAR:
            near.append(words[high][2])
            high += 1
        place = xxhash.xxh64_intdigest(" ".join(near)) - (1 << 63)
        value = entity(kind, text[start:end])
        yield value, None, None
        for term in dict.fromkeys(near):
            yield value, term, place


# ---- the corpus ----

SPANS = "array<struct<start: int, kind: int, end: int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_FOUND = [("row", pa.int64()), ("spans", _SPAN), ("text", pa.string()), ("entity", pa.binary()), ("term", pa.string()), ("place", pa.int64())]


def _batch(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    kinds = [("key", key), *_FOUND]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def _found(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row ``(key, row, spans, text)`` for each document, its text only where it has spans, one ``(row, entity)`` for each entity of a
    document, and one ``(row, entity, term, place)`` for each pair and the surroundings of it, at most two."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            keys, rows, texts = b.columns
            for i in range(b.num_rows):
                row, t = rows[i].as_py(), texts[i].as_py() or ""
                spans = find(t)
                out.append((keys[i].as_py(), row, spans, t if spans else None, None, None, None))
                seen: dict[tuple[bytes, str | None], tuple[int | None, int]] = {}
                for value, term, place in pairs(t, spans):
                    first, n = seen.get((value, term), (place, 0))
                    # the first surroundings and other ones are enough to tell that there are two
                    if n == 0 or (n == 1 and first != place):
                        seen[value, term] = first, n + 1
                        out.append((None, row, None, None, value, term, place))
                    if len(out) >= OUT:
                        yield _batch(out, keys.type)
                        out = []
            yield _batch(out, keys.type)

    rows = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, row long, spans {SPANS}, text string, entity binary, term string, place long")


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, n_t): documents that hold each term, combined in each batch, in each task and then by term."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count: Counter[str] = Counter()
            for i in range(b.num_rows):
                count.update(_words(b.column(0)[i].as_py() or ""))
            yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), pa.array(count.values(), pa.int64())], names=["term", "n"])

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def _disclosing(found: DataFrame, docs: DataFrame, text: str, least: float) -> DataFrame:
    each = found.where("term IS NOT NULL").groupBy("row", "entity", "term").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    ends = [f(c).alias(f"{c}_{n}") for c in ("low", "high") for n, f in (("least", F.min), ("most", F.max))]
    met = each.groupBy("entity", "term").agg(F.count("*").alias("n_te"), *ends).where("low_least <> low_most OR high_least <> high_most").select("entity", "term", "n_te")
    holds = found.where("entity IS NOT NULL AND term IS NULL").groupBy("entity").agg(F.count("*").alias("n_e"))
    n = found.where("entity IS NULL").count()
    met = stored(met, "met").join(holds.hint("merge"), "entity").join(document_counts(docs, text).hint("merge"), "term")
    share = 1 + F.log(F.col("n_te") / F.col("n_t")) / F.log(F.lit(float(n)) / F.col("n_e"))
    share = F.when(F.col("n_e") < n, share).otherwise(0.0)
    return met.withColumn("disclosure", share).where(F.col("disclosure") >= least)


def disclosing_terms(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = DISCLOSED) -> DataFrame:
    """(entity, term, n_te, n_e, n_t, disclosure) of the terms that disclose an entity."""
    return _disclosing(stored(_found(docs, key, text), "found"), docs, text, least)


def sanitised(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = DISCLOSED, removed: float = REMOVED) -> DataFrame:
    """``(key, base, spans, text)`` for each document: its base spans, all spans, and, where it has any, its text without them.

    Base spans become the name of their kind, disclosing terms ``[TERM]`` or nothing. Every occurrence of a term that stands near
    the entity it discloses is one of the document's spans, wherever it stands in the text.
    """
    found = stored(_found(docs, key, text), "found")
    telling = stored(_disclosing(found, docs, text, least).select("entity", "term", (F.col("disclosure") >= removed).alias("gone")), "telling")
    mine = found.where("term IS NOT NULL").select("row", "entity", "term").join(telling.hint("merge"), ["entity", "term"])
    mine = mine.groupBy("row", "term").agg(F.bool_or("gone").alias("gone")).groupBy("row").agg(F.collect_list(F.struct("term", "gone")).alias("terms"))
    rows = found.where("entity IS NULL").select("key", "row", "spans", "text").join(mine.hint("merge"), "row", "left")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out_spans, texts = [], []
            for i in range(b.num_rows):
                spans = [(s["start"], s["kind"], s["end"]) for s in b.column(1)[i].as_py()]
                t, terms = b.column(2)[i].as_py(), {x["term"]: x["gone"] for x in b.column(3)[i].as_py() or ()}
                own = [(a, 4, e) for a, e, w in _outside(t, spans) if w in terms] if terms else []
                every = sorted(spans + own)
                out_spans.append(every)
                texts.append(_without(t, every, terms) if every else t)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out_spans, _SPAN), pa.array(texts, pa.string())], names=["key", "base", "spans", "text"])

    return rows.select("key", "spans", "text", "terms").mapInArrow(run, f"key {kind}, base {SPANS}, spans {SPANS}, text string").withColumnRenamed("key", key)


def _without(text: str, spans: list[tuple[int, int, int]], gone: dict[str, bool]) -> str:
    parts, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            parts += [text[at:start], "" if kind == 4 and gone[text[start:end].lower()] else f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base spans by kind, digest of the base spans, and all spans, for each document."""
    out = sanitised(docs, key, text)
    number = lambda i: F.size(F.filter("base", lambda s: s.kind == i)).cast("long").alias(f"n_{KINDS[i]}")
    counts = [number(i) for i in range(4)]
    return out.select(key, *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
