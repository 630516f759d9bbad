"""Options of a quiz topic: generated texts on known positions, repaired, and filled in from templates.

Texts that a position could take are rows with their quality checks; the options of a topic are one ordered fold over
its generated texts and then its positions. A topic has at most as many positions as there are candidates, so the arrays
of the fold are small whatever the tables hold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire import vocab
from tidewire.functions.gates import known_position, option_failures, party_reference
from tidewire.functions.scoring import stance_weight
from tidewire.functions.text import C, col, collapse, fingerprint, split_words, truncate_words

#: Offsets of the variants tried for a generated text that fails, and for a position without one.
TRIES, FILLS = (0, 15), (16, 39)
GENERATED = "topic string, place int, mapped_position int, text_pt string, text_en string, stance string, weight int"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that it uses several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fragment(text: C, least: int = 4, most: int = 22) -> Column:
    """A phrase that can go into a position text, without names and news terms; null if it names a party or has not ``least`` to
    ``most`` words."""
    banned = r"(?iU)\b(?:" + "|".join((*vocab.NAME_TERMS, *vocab.EVENT_TERMS)) + r")\b"
    clean = F.btrim(F.regexp_replace(F.regexp_replace(collapse(text), banned, ""), r"\s{2,}", " "), F.lit(" ,.;:-"))
    n = F.size(split_words(clean))
    return F.when(~party_reference(text) & n.between(least, most), clean)


def summary_hint(summary: C) -> Column:
    """The first sentence of a summary as a fragment."""
    return fragment(F.regexp_extract(F.trim(col(summary)), r"^[^.!?;:]*", 0), 5, 20)


def action_hint(actions: C) -> Column:
    """The first action that is a usable fragment."""
    return F.get(F.filter(F.transform(col(actions), lambda a: fragment(a, 4, 16)), lambda x: x.isNotNull()), 0)


def position_texts(intro: C, topic: C, label_pt: C, label_en: C, stance: C, hint_pt: C, hint_en: C, action: C) -> tuple[Column, Column]:
    """Portuguese and English sentences for a stance; ``intro`` picks the opening, from 0."""
    named = lambda label: F.coalesce(F.nullif(F.lower(F.trim(col(label))), F.lit("")), F.replace(col(topic), F.lit("_"), F.lit(" ")))
    said = lambda table: F.coalesce(*(F.when(col(stance) == s, t) for s, t in table.items()), F.lit(table["neutral"]))
    opening = lambda values: F.element_at(F.array(*map(F.lit, values)), col(intro) + 1)
    body_pt = F.concat(F.lit(" o governo "), said(vocab.STANCE_PT), F.lit(" em "), named(label_pt), F.lit(f", {vocab.ENDING_PT}"))
    body_en = F.concat(F.lit(" "), said(vocab.STANCE_EN), F.lit(" on "), named(label_en), F.lit(f", {vocab.ENDING_EN}"))
    more = lambda lead, hint, cond: F.coalesce(F.when(cond, F.concat(F.lit(f" {lead} "), F.lower(col(hint)), F.lit("."))), F.lit(""))
    differs = ~col(hint_pt).eqNullSafe(col(action))
    pt = truncate_words(F.concat(opening(vocab.INTROS), body_pt, more(vocab.ALSO_PT, hint_pt, F.lit(True)), more(vocab.MOREOVER_PT, action, differs)))
    en = truncate_words(F.concat(opening(vocab.INTROS_EN), body_en, more(vocab.ALSO_EN, hint_en, F.lit(True))))
    short = lambda text, plain: F.when(F.size(split_words(text)) < 15, plain).otherwise(text)
    return short(pt, F.concat(F.lit(vocab.INTROS[1]), body_pt)), short(en, F.concat(F.lit(vocab.INTROS_EN[0]), body_en))


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


CHOICE = ("pt", "en", "fp_pt", "fp_en", "ok")


def _choice(pt: Column, en: Column) -> Column:
    return F.struct(pt.alias("pt"), en.alias("en"), fingerprint(pt).alias("fp_pt"), fingerprint(en).alias("fp_en"), (F.size(option_failures(pt, en)) == 0).alias("ok"))


def _openings(topic: str, candidate: str, stance: str, offsets: tuple[int, int]) -> Column:
    """Openings in the order in which the variants of a range of offsets come to them."""
    key = lambda i: F.conv(F.substring(F.sha2(F.concat_ws(":", topic, candidate, stance, i.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.array_distinct(F.transform(F.sequence(F.lit(offsets[0]), F.lit(offsets[1])), lambda i: (key(i) % len(vocab.INTROS)).cast("int")))


def choices(positions: DataFrame) -> DataFrame:
    """(topic, candidate, tries, fills): for each stance the template texts that a position may take, checked, in the order tried."""
    rows = positions.select("topic", "candidate", _column(positions, "topic_label_pt", "string").alias("label_pt"), _column(positions, "topic_label_en", "string").alias("label_en"), summary_hint(F.nullif(F.trim(_column(positions, "summary_pt", "string")), F.lit(""))).alias("hint_pt"), summary_hint(F.nullif(F.trim(_column(positions, "summary_en", "string")), F.lit(""))).alias("hint_en"), action_hint(_column(positions, "key_actions", "array<string>")).alias("action"))
    each = rows.withColumn("stance", F.explode(F.array(*map(F.lit, vocab.STANCES)))).withColumn("intro", F.explode(F.array(*map(F.lit, range(len(vocab.INTROS))))))
    pt, en = position_texts("intro", "topic", "label_pt", "label_en", "stance", "hint_pt", "hint_en", "action")
    each = each.select("topic", "candidate", "stance", "intro", pt.alias("pt"), en.alias("en")).select("topic", "candidate", "stance", "intro", _choice(F.col("pt"), F.col("en")).alias("choice"))
    every = each.groupBy("topic", "candidate", "stance").agg(F.map_from_entries(F.collect_list(F.struct("intro", "choice"))).alias("by_intro"))
    ordered = lambda offsets: F.transform(_openings("topic", "candidate", "stance", offsets), lambda i: F.element_at("by_intro", i))
    every = every.select("topic", "candidate", "stance", ordered(TRIES).alias("tries"), ordered(FILLS).alias("fills"))
    by = lambda name: F.map_from_entries(F.collect_list(F.struct("stance", name))).alias(name)
    return every.groupBy("topic", "candidate").agg(by("tries"), by("fills"))


OPTION = "array<struct<candidate: string, weight: int, pt: string, en: string, fp_pt: string, fp_en: string>>"


def _take(taken: Column, position: Column, weight: Column, texts: Column, n: int) -> Column:
    """The options, with one more if the position is free and has a text that is right and new."""
    new = lambda c: c.ok & ~F.exists(taken, lambda o: (o.fp_pt == c.fp_pt) | (o.fp_en == c.fp_en))
    option = lambda c: F.struct(position.candidate.alias("candidate"), weight.cast("int").alias("weight"), c.pt.alias("pt"), c.en.alias("en"), c.fp_pt.alias("fp_pt"), c.fp_en.alias("fp_en"))
    free = (F.size(taken) < n) & position.isNotNull() & ~F.exists(taken, lambda o: o.candidate == position.candidate)
    more = lambda c: F.when(c.isNotNull(), F.array_append(taken, option(c))).otherwise(taken)
    return F.when(free, _let(F.get(F.filter(texts, new), 0), more)).otherwise(taken).cast(OPTION)


def assemble(positions: DataFrame, generated: DataFrame | None = None, least: int = 3, n: int = 6, order: Sequence[str] = ("candidate",)) -> DataFrame:
    """Options of each topic with at least ``least``: (topic, option_id, candidate, weight, confidence, position_type, text_pt, text_en,
    source_pt, source_en, source_url, source_date, n_options).

    Generated texts come first, by ``place``: each takes the position it maps to (from 1, in ``order``), or else the next
    candidate that has no option; a stance or weight that is none is mended from the position; a text that fails a check or
    was used gives way to a template. Then candidates without an option take templates, until there are ``n``.
    """
    known = positions.where(known_position())
    source = F.get(_column(known, "sources", "array<struct<description_pt: string, description_en: string, url: string, date: string>>"), 0)
    said = lambda c: F.nullif(F.trim(c), F.lit(""))
    text = lambda name: F.coalesce(said(source[name]), F.lit(""))
    facts = F.struct(F.struct(*order).alias("key"), "candidate", "stance", "position_type", text("description_pt").alias("source_pt"), text("description_en").alias("source_en"), said(source["url"]).alias("source_url"), said(source["date"]).alias("source_date"), "tries", "fills")
    topics = known.join(choices(known).hint("merge"), ["topic", "candidate"]).groupBy("topic").agg(F.collect_list(facts).alias("p"))
    topics = topics.withColumn("p", F.array_sort("p", lambda a, b: F.when(a.key < b.key, -1).when(a.key > b.key, 1).otherwise(0)))
    if generated is None:
        topics = topics.withColumn("g", F.expr("CAST(array() AS array<struct<place: int, mapped: int, stance: string, weight: int, choice: struct<pt: string, en: string, fp_pt: string, fp_en: string, ok: boolean>>>)"))
    else:
        texts = generated.withColumns({"text_pt": said(F.col("text_pt")), "text_en": said(F.col("text_en"))})
        one = F.struct("place", F.col("mapped_position").alias("mapped"), "stance", "weight", _choice(F.col("text_pt"), F.col("text_en")).alias("choice"))
        lists = texts.where("text_pt IS NOT NULL OR text_en IS NOT NULL OR mapped_position IS NOT NULL").groupBy("topic").agg(F.array_sort(F.collect_list(one)).alias("g"))
        topics = topics.join(lists.hint("merge"), "topic", "left").withColumn("g", F.coalesce("g", F.slice(F.array(F.lit(None).cast(lists.schema["g"].dataType.elementType)), 1, 0)))

    def place(taken: Column, g: Column) -> Column:
        unused = F.get(F.filter("p", lambda p: ~F.exists(taken, lambda o: o.candidate == p.candidate)), 0)
        asked = F.when(g.mapped.between(1, F.size("p")), F.get("p", g.mapped - 1)).otherwise(unused)

        def with_position(p: Column) -> Column:
            stance = F.when(g.stance.isin(*vocab.STANCES), g.stance).otherwise(p.stance)
            weight = F.when(g.weight.isin(*vocab.STANCES.values()), g.weight).otherwise(stance_weight(stance))
            tries = F.concat(F.array(g.choice), F.element_at(p.tries, stance))
            return F.when(g.choice.pt.isNull() | g.choice.en.isNull(), taken).otherwise(_take(taken, p, weight, tries, n))

        return _let(asked, with_position).cast(OPTION)

    start = F.expr(f"CAST(array() AS {OPTION})")
    taken = F.aggregate("g", start, place)
    topics = topics.withColumn("o", taken)
    topics = topics.withColumn("o", F.aggregate("p", F.col("o"), lambda taken, p: _take(taken, p, stance_weight(p.stance), F.element_at(p.fills, p.stance), n)))
    topics = topics.where(F.size("o") >= least)
    each = topics.select("topic", F.size("o").alias("n_options"), "p", F.posexplode("o").alias("k", "o"))
    own = _let(F.col("o.candidate"), lambda c: F.get(F.filter("p", lambda p: p.candidate == c), 0))
    each = each.withColumn("own", own)
    return each.select(
        "topic", F.element_at(F.array(*map(F.lit, vocab.OPTION_IDS)), F.col("k") + 1).alias("option_id"), "o.candidate", "o.weight", F.when(F.col("own.position_type") == "confirmed", "high").otherwise("medium").alias("confidence"), "own.position_type",
        F.col("o.pt").alias("text_pt"), F.col("o.en").alias("text_en"), "own.source_pt", "own.source_en", "own.source_url", "own.source_date", "n_options")
