"""Column builders for text, ids, times, lists and maps. Every function takes and returns columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire import vocab

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def mapping(values: Mapping[str, object]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def blank_to_null(c: C) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def collapse(c: C) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def norm_text(c: C) -> Column:
    """Lower-case ASCII with marks dropped, ``_`` and ``-`` as spaces, white space collapsed."""
    folded = F.translate(col(c), vocab.FOLD_FROM, vocab.FOLD_TO)
    plain = F.regexp_replace(folded, r"[^\x00-\x7F]", "")
    return collapse(F.translate(F.lower(plain), "_-", "  "))


def norm_text_accents(c: C) -> Column:
    """Lower case without marks; punctuation and spacing stay."""
    return F.lower(F.translate(col(c), vocab.FOLD_FROM, vocab.FOLD_TO))


@F.pandas_udf(T.StringType())
def norm_text_exact(values):  # noqa: ANN001, ANN201
    """The same as ``norm_text`` by full compatibility decomposition, for text beyond Latin letters."""
    import unicodedata

    plain = values.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode(), na_action="ignore")
    return plain.str.lower().str.replace(r"[_-]", " ", regex=True).str.split().str.join(" ")


def short_hash(c: C, n: int = 16) -> Column:
    """First ``n`` hex digits of SHA-256: article ids from urls."""
    return F.substring(F.sha2(col(c).cast("string"), 256), 1, n)


def poll_id(institute: C, published: C) -> Column:
    return short_hash(F.concat_ws("_", col(institute), F.date_format(col(published), "yyyy-MM-dd")))


def cluster_id(ids: C) -> Column:
    """Name of a cluster from the array of its members' ids."""
    return F.concat(F.lit("cluster_"), short_hash(F.array_join(F.array_sort(col(ids)), ""), 8))


def parse_ts(c: C) -> Column:
    """ISO-8601 text as a timestamp; a naive one is UTC, a bad one null."""
    return F.try_to_timestamp(F.trim(col(c)))


def article_ts(published: C = "published_at", collected: C = "collected_at") -> Column:
    return F.coalesce(col(published), col(collected))


def strip_html(c: C) -> Column:
    return collapse(F.regexp_replace(col(c), r"<[^>]+>", " "))


@F.pandas_udf(T.StringType())
def decode_entities(values):  # noqa: ANN001, ANN201
    import html

    return values.map(html.unescape, na_action="ignore")


def clean_list(c: C, lower: bool = False) -> Column:
    """Trimmed, non-blank, first of equal values, in order."""
    def one(x: Column) -> Column:
        return F.lower(F.trim(x)) if lower else F.trim(x)

    return F.array_distinct(F.filter(F.transform(F.coalesce(col(c), F.array().cast("array<string>")), one), lambda x: x != ""))


def norm_topics(c: C, allowed: Sequence[str]) -> Column:
    return F.filter(clean_list(c, lower=True), lambda t: t.isin(*allowed))


def canonical_candidate(c: C, aliases: Mapping[str, str] = vocab.ALIASES, slugs: Sequence[str] = vocab.SLUGS) -> Column:
    """Slug of a name: itself if canonical, else by alias of the normalised text, else null."""
    plain = F.lower(F.trim(col(c)))
    return F.when(plain.isin(*slugs), plain).otherwise(F.try_element_at(mapping(dict(aliases)), norm_text(col(c))))


def canonical_candidates(c: C) -> Column:
    return F.array_distinct(F.array_compact(F.transform(F.coalesce(col(c), F.array().cast("array<string>")), lambda x: canonical_candidate(x))))


def norm_labels(c: C) -> Column:
    """Label map with canonical keys and known values; of keys that become equal the later wins."""
    pairs = F.transform(F.map_entries(col(c)), lambda e: F.struct(canonical_candidate(e.key).alias("key"), F.lower(F.trim(e.value)).alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda e: e.key.isNotNull() & e.value.isin(*vocab.LABELS)))


def norm_scores(c: C) -> Column:
    """Score map with canonical keys and numbers clamped to one either way, four places."""
    pairs = F.transform(F.map_entries(col(c)), lambda e: F.struct(canonical_candidate(e.key).alias("key"), places(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), e.value.try_cast("double"))), 4).alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda e: e.key.isNotNull() & e.value.isNotNull()))


def places(c: C, n: int = 4) -> Column:
    """Round half up with a margin that absorbs the order of summation; the same in any engine."""
    return (F.floor(col(c) * 10**n + 0.5 + 1e-6) / 10**n).cast("double")


def label_to_score(c: C) -> Column:
    return F.when(col(c) == "positivo", 1.0).when(col(c) == "negativo", -1.0).when(col(c) == "neutro", 0.0)


def score_to_label(c: C, edge: float = 0.2) -> Column:
    return F.when(col(c) >= edge, "positivo").when(col(c) <= -edge, "negativo").when(col(c).isNotNull(), "neutro")


def display_band(c: C, edge: float = 0.3) -> Column:
    return F.when(col(c) > edge, "positive").when(col(c) < -edge, "negative").when(col(c).isNotNull(), "neutral")


def norm_summaries(pt: C, en: C, title: C) -> Column:
    p, e, t = blank_to_null(pt), blank_to_null(en), blank_to_null(title)
    return F.struct(F.coalesce(p, e, t, F.lit("")).alias("pt"), F.coalesce(e, p, t, F.lit("")).alias("en"))


def fence_strip(c: C) -> Column:
    """Inside of the first fenced block, or the trimmed text."""
    inner = F.regexp_extract(col(c), r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(inner != "", inner).otherwise(F.trim(col(c)))


def redact_secrets(c: C) -> Column:
    return F.regexp_replace(col(c), r"(?i)(key|api_key|apikey|devKey)=[A-Za-z0-9_-]{20,}", "$1=[REDACTED]")


def snippet(content: C, summary: C, fallback: C, size: int = 220) -> Column:
    """First ``size`` characters on one line, with dots if cut; content, else summary, else fallback."""
    text = F.coalesce(F.nullif(collapse(content), F.lit("")), F.nullif(collapse(summary), F.lit("")), col(fallback))
    return F.when(F.length(text) > size, F.concat(F.rtrim(F.substring(text, 1, size)), F.lit("..."))).otherwise(text)


def split_words(c: C) -> Column:
    return F.array_remove(F.split(F.coalesce(col(c), F.lit("")), r"\s+"), "")


def reading_time(c: C) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.size(split_words(c)) / F.lit(200))).cast("int")


def fingerprint(c: C) -> Column:
    return F.regexp_replace(collapse(F.lower(col(c))), r"[^\p{L}\p{N}_\s]", "")


def truncate_words(c: C, most: int = 80) -> Column:
    w = split_words(c)
    cut = F.rtrim(F.array_join(F.slice(w, 1, most), " "), F.lit(",;"))
    dotted = F.when(cut.rlike(r"[.!?]$"), cut).otherwise(F.concat(cut, F.lit(".")))
    return F.when(F.size(w) <= most, F.trim(col(c))).otherwise(dotted)


def safe_float(c: C, default: float = 0.0) -> Column:
    return F.coalesce(col(c).try_cast("double"), F.lit(default))


def clamp01(c: C, default: float = 0.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), safe_float(c, default)))


def infer_candidates(text: C, names: Mapping[str, Sequence[str]]) -> Column:
    """Slugs with a name that the text contains, in the order of ``names``."""
    plain = norm_text_accents(text)
    return F.array_compact(F.array(*(F.when(_any(plain, n), s) for s, n in names.items())))


def _any(text: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def classify_topics(text: C, keywords: Mapping[str, Sequence[str]]) -> Column:
    plain = F.lower(col(text))
    return F.array_compact(F.array(*(F.when(_any(plain, k), t) for t, k in keywords.items())))


def topic_paragraphs(text: C, keywords: Sequence[str], most: int = 8, fallback: int = 10, size: int = 500) -> Column:
    """Paragraphs of over 50 characters with a keyword, else the first ones; each cut to ``size``."""
    parts = F.filter(F.transform(F.split(col(text), r"\n\s*\n"), lambda p: F.trim(p)), lambda p: F.length(p) > 50)
    hits = F.filter(parts, lambda p: _any(F.lower(p), keywords))
    chosen = F.when(F.size(hits) > 0, hits).otherwise(F.slice(parts, 1, fallback))
    return F.transform(F.slice(chosen, 1, most), lambda p: F.substring(p, 1, size))


def anonymise(c: C, names: Sequence[str], by: str = "o candidato") -> Column:
    """Names, longest first, replaced by a neutral phrase that is not repeated."""
    out = col(c)
    for name in sorted(names, key=lambda n: (-len(n), n)):
        out = F.regexp_replace(out, rf"(?i)\b{name}\b", by)
    return collapse(F.regexp_replace(out, rf"(?i)({by})(\s+{by})+", by))


def variant(topic: C, candidate: C, stance: C, offset: int, n: int) -> Column:
    """Deterministic choice among ``n`` variants."""
    seed = F.conv(short_hash(F.concat_ws(":", col(topic), col(candidate), col(stance), F.lit(str(offset))), 8), 16, 10)
    return (seed.cast("long") % n).cast("int")


def zero_nulls(*names: str) -> dict[str, Column]:
    return {n: F.coalesce(F.col(n), F.lit(0.0)) for n in names}


def article_defaults(topics: Sequence[str] = vocab.POLITICAL_TOPICS + ("eleicoes",)) -> dict[str, Column]:
    """Normalised fields of an article row, for ``withColumns``."""
    return {
        "title": F.coalesce(F.trim("title"), F.lit("")),
        "content": F.coalesce("content", F.lit("")),
        "status": F.when(F.col("status").isin(*vocab.STATUSES), F.col("status")).otherwise("raw"),
        "source_category": F.coalesce(F.lower(F.trim("source_category")), F.lit("mainstream")),
        "topics": norm_topics("topics", topics),
        "candidates_mentioned": canonical_candidates("candidates_mentioned"),
        "relevance_score": clamp01("relevance_score"),
    }
