"""Quality rules as a bitmask ledger, in DataFrame functions only.

``measure`` computes every measurement of a text once, ``ledger`` turns each rule into one bit of ``failures``, and a
versioned policy is a bit mask over the ledger: ``apply_policy`` keeps rows with no forbidden bit, ``ablation`` tells
from the stored bits alone what each rule adds to a policy. A policy never needs the texts again.

Defined cases: a null or blank text has no words (it fails ``few_words``); rows are judged one by one, so repeated
rows, null ids and extra columns pass through as they are, but a column named like a measurement is replaced by it;
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Rule name -> condition over the measurements, in SQL; its place is its bit.
RULES = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines",
    "long_words": "word_chars > 12 * n_words",
    "short_words": "word_chars < 2 * n_words",
}
BASE = ("few_words", "repeated_windows")
#: Version -> rules that a kept document must not fail.
POLICIES = {
    "v1": BASE,
    "v2": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "long_words", "short_words"),
}
CURRENT = "v2"


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(version: str) -> int:
    return sum(bit(r) for r in POLICIES[version])


def _pairs(hashes: str, step: int) -> Column:
    """Hash of element i with element i + step, for all i that have such an element."""
    h = F.col(hashes)
    rest = F.greatest(F.size(h) - step, F.lit(0))
    return F.zip_with(F.slice(h, F.lit(1), rest), F.slice(h, F.lit(step + 1), rest), lambda x, y: F.xxhash64(x, y))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements of ``text`` to each row.

    Windows of eight words are hashed by doubling (pairs, fours, eights), so the cost per word does not depend on the
    window. Only a text whose window hashes are not all distinct sorts them to find what its repeats cover.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    # the row goes along as one column, so that no name of its own clashes; a measurement replaces a column of its name
    out = docs.select(F.struct("*").alias("row"), t.alias("_text"))
    t, own = F.col("_text"), [c for c in docs.columns if c not in MEASURES]
    out = out.withColumn("_words", F.array_remove(F.split(t, "[\\x20\\x09-\\x0D]+"), ""))
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
        "_h": F.transform("_words", lambda w: F.xxhash64(w)),
    }).drop("_words")
    out = out.withColumns({"n_lines": F.size("_lines").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")}).drop("_lines")
    for step in (1, 2, 4):
        out = out.withColumn("_h", _pairs("_h", step))
    out = out.withColumn("_n", F.size("_h")).withColumn("_h", F.when(F.size(F.array_distinct("_h")) < F.col("_n"), F.col("_h")))
    # (hash, place) in order; a place counts if its hash equals a neighbour's
    out = out.withColumn("_s", F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    n = F.size("_s")
    out = out.withColumn("_next", F.zip_with(F.slice("_s", F.lit(1), n - 1), F.slice("_s", F.lit(2), n - 1), lambda x, y: F.when(x.h == y.h, F.array(x.i, y.i)))).drop("_s", "_h")
    out = out.withColumn("_at", F.sort_array(F.array_distinct(F.flatten(F.filter("_next", lambda x: x.isNotNull()))))).drop("_next")
    m = F.size("_at")
    gaps = F.zip_with(F.slice("_at", F.lit(1), m - 1), F.slice("_at", F.lit(2), m - 1), lambda x, y: F.least(y - x, F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(WINDOW), lambda s, x: s + x)
    out = out.withColumn("n_repeat_words", F.when(m > 0, covered).otherwise(0).cast("long"))
    return out.select(*(F.col("row")[c].alias(c) for c in own), *MEASURES)


def ledger(measured: DataFrame) -> DataFrame:
    """Add ``failures``: bit k is set if rule k of ``RULES`` fails. Each rule is evaluated once."""
    bits = [F.when(F.expr(cond), F.lit(bit(rule))).otherwise(F.lit(0)) for rule, cond in RULES.items()]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("failures", total)


def apply_policy(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """Add ``base_failed`` and ``kept`` from the failure bits."""
    base = F.col("failures").bitwiseAND(F.lit(mask("v1"))) != 0
    return rows.withColumns({"base_failed": base, "kept": ~base & (F.col("failures").bitwiseAND(F.lit(mask(version))) == 0)})


def ablation(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """Per rule of a policy: rows that fail it, and rows that it alone rejects (kept again without it).

    One pass over the ledger; the aggregate has as many numbers as there are rules.
    """
    whole = mask(version)
    hit = F.col("failures").bitwiseAND(F.lit(whole))
    sums = [F.struct(F.lit(r).alias("rule"), F.count_if(hit.bitwiseAND(F.lit(bit(r))) != 0).alias("n_failed"), F.count_if(hit == F.lit(bit(r))).alias("n_only")) for r in POLICIES[version]]
    return rows.agg(F.array(*sums).alias("r")).select(F.lit(version).alias("version"), F.explode("r").alias("r")).select("version", "r.*")


def quality_rules(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """Measurements, failure bits and the verdict of one policy for every row of ``docs``."""
    return apply_policy(ledger(measure(docs)), version)


def kept_rows(docs: DataFrame, version: str = CURRENT, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with their own columns, whatever their names.

    The verdict holds a part that is not deterministic (and always true): else the optimizer would push the filter
    below the measurements and compute each of them many times over inside it.
    """
    verdict = F.col("kept") & (F.monotonically_increasing_id() >= 0)
    rows = quality_rules(docs.select(F.struct("*").alias("its"), F.col(text).alias("text")), version)
    return rows.withColumn("kept", verdict).where("kept").select(*(F.col("its")[c].alias(c) for c in docs.columns))
