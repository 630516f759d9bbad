"""Line deduplication by an exact set-similarity join, in DataFrame functions only.

A line is the set of its lower-cased words. It is removed if an earlier line (by document id, then line number; lines
of one document count too) has a Jaccard similarity of at least 0.8 with it. The steps:

1. Equal lines are combined before and after one shuffle by their text; of each text the earliest line goes on, as
   the sorted 32-bit hashes of its words (matching lines share at least as many hashes as words) and a parity bitmap, in
   which each token flips one bit. A place is one number, so that this is a hash aggregate without sorts of texts.
2. Every line meets, of those with the same two extreme tokens in one of two orders, one line of the first document and
   that with the most copies. That settles most near copies in linear work; a settled line is still met by others, but
   does not look for more matches itself.
3. Tokens are ordered by rarity, estimated by a count per hash bucket: a table of ``SLOTS`` numbers for any corpus.
4. Lines that match share a token among the first n - ceil(0.8 n) + 1 of each (prefix filter). A token of a bucket with
   ``HOT`` or more occurrences is refined: if it is the first that both share, the next one stands among the first
   n - ceil(0.8 n) + 2 of each, so pairs of tokens are the keys, or for long lines a token and a class of lengths.
5. Lines of one key that differ little in size (length filter), leave enough tokens behind the shared one (positional
   filter) and whose bitmaps differ in no more bits than the sets may in tokens are candidates. All three filters are
   conditions of the join, so that only candidates leave it, and only from the first of a run of shared tokens.
6. Candidates are verified on their whole sets of words, as 64-bit hashes, which are read from the texts again.

Defined cases: ids must be integers; lines without a word stay and match nothing; null texts have no lines; rows with
one id are one document after another in the order of their texts' SHA-256, identical rows are judged as one; rows with
a null id come last; an empty table gives an empty table; columns named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.places import LAST, in_order, with_copies
from tidewire.session import forget, stored

#: Jaccard threshold as a fraction, buckets of the rarity table, occurrences in a bucket that make its tokens frequent.
TOP, BOTTOM = 4, 5
SLOTS, HOT = 1 << 18, 512
#: Tokens of a line up to which frequent tokens are paired.
LONG = 80
#: Numbers of documents, above 31 bits of a line's.
SPAN = 1 << 32
#: Lines of which places (16 bytes each) are sent to all tasks; more of them are shuffled.
FEW = 1 << 19
WORD = "[^\\x20\\x09-\\x0D]"


def _plain(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with a text lower-cased and its white space but line breaks turned into spaces."""
    odd, plain = F.col(text).rlike("[\\x09\\x0B-\\x0D]"), F.col(text)
    for c in "\t\x0b\x0c\r":
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    return rows.withColumn(text, F.lower(text)).withColumn(text, F.when(odd, plain).otherwise(F.col(text)))


def _tokens(line: Column) -> Column:
    """Hashes of the distinct words of a plain line."""
    return F.array_except(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)), F.array(F.xxhash64(F.lit(""))))


def _numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, doc, num, t): ``with_copies`` with one number in the order of ids and copies.

    Ids that span fewer than 2^32 are numbers less the first of them; others, and ids with several texts, are counted.
    """
    rows = with_copies(docs, key, text)
    real = F.nullif("doc", F.lit(LAST))
    low, high, copy = rows.select(F.min(real), F.max(real), F.max("copy")).first()
    if not copy and (low is None or high - low < SPAN - 1):
        return rows.select("row", "doc", F.when(F.col("doc") == LAST, SPAN - 1).otherwise(F.col("doc") - (low or 0)).alias("num"), "t")
    places = in_order(rows.select("doc", "copy").distinct(), ("doc", "copy"), "numbers").withColumnRenamed("place", "num")
    return rows.join(places.hint("merge"), ["doc", "copy"]).select("row", "doc", "num", "t")


def _lines(rows: DataFrame) -> DataFrame:
    """(doc, at, s) of all lines; at is the document's number above the line's."""
    lines = rows.select("doc", "num", F.posexplode(F.split("t", "\n")).alias("i", "s"))
    return lines.select("doc", F.shiftleft("num", 31).bitwiseOR(F.col("i").cast("long")).alias("at"), "s")


def _parity(of: Callable[[Column], Column] | None = None) -> Column:
    """Bitmap in which every token flips one bit, or no bit if ``of`` it is 0 (a shift by a number takes its lowest 6 bits)."""
    return F.aggregate("w", F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", of(t) if of else F.lit(1).cast("long"), t)))


def _sets(rows: DataFrame) -> DataFrame:
    """(at, copies, w) of the earliest line of each text with a word; w are its tokens."""
    lines = _lines(_plain(rows, "t")).where(F.trim("s") != "")
    # the filter keeps the lambdas below out of the aggregate, which is then compiled
    first = lines.groupBy("s").agg(F.min("at").alias("at"), F.count("*").alias("copies")).where("copies > 0")
    half = F.sort_array(F.transform(_tokens(F.col("s")), lambda t: F.hash(t)))
    return stored(first.select("at", "copies", half.alias("w")), "sets", **{"parquet.enable.dictionary": "false"})


def _slot(t: Column) -> Column:
    return t.bitwiseAND(F.lit(SLOTS - 1))


def _rarity(sets: DataFrame) -> Column:
    """About 2 log2 of the tokens in each bucket: a constant array of ``SLOTS`` small numbers, which the JVM holds once each.

    This table, of one size for any corpus, is all that reaches the driver; the optimizer folds it into one literal.
    """
    counts = sets.select(F.explode("w").alias("t")).select(_slot(F.col("t")).alias("slot")).groupBy("slot").agg(F.count("*").alias("n"))
    found = counts.select("slot", (F.log2("n") * 2).cast("int").alias("r")).toArrow()
    ranks = [0] * SLOTS
    for slot, rank in zip(*(c.to_pylist() for c in found.columns), strict=True):
        ranks[slot] = rank
    return F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<bigint>")


def _heads(sets: DataFrame) -> DataFrame:
    """(at, copies, n, b1, b2, ends, keep, p): bitmap, hashes of pairs of extreme tokens, length of the prefix, and
    the prefix and one token more, as rank times 2^32 plus the token's hash."""
    rank = _rarity(sets)
    no = F.lit(0)  # for no null: sorting is faster where the type has none
    sets = sets.withColumn("other", F.sort_array(F.transform("w", lambda t: F.coalesce(F.call_function("shiftleft", t, F.lit(11)), no))))  # by another part of the hash
    ends = F.array(*(F.xxhash64(F.lit(k), F.slice(a, at, 2)) for k, (a, at) in enumerate(((F.col("w"), 1), (F.col("w"), -2), (F.col("other"), 1), (F.col("other"), -2)))))
    rarest = F.sort_array(F.transform("w", lambda t: F.coalesce(F.shiftleft(F.get(rank, _slot(t)), 32) + t, no.cast("long"))))
    n = F.size("w")
    keep = n - F.ceil(TOP * n / F.lit(BOTTOM)).cast("int") + 1
    half = _parity(lambda t: F.shiftright(t, 6).bitwiseAND(F.lit(1)).cast("long"))
    heads = sets.select("at", "copies", n.alias("n"), half.alias("b1"), _parity().alias("b2"), F.when(n > 1, ends).alias("ends"), keep.alias("keep"), F.slice(rarest, F.lit(1), keep + 1).alias("p"))
    return stored(heads.withColumn("b2", F.col("b1").bitwiseXOR(F.col("b2"))), "heads", **{"parquet.enable.dictionary": "false"})


def _lengths(n: Column, m: Column) -> Column:
    """Whether sets of n and m tokens can be similar."""
    return (BOTTOM * n >= TOP * m) & (BOTTOM * m >= TOP * n)


def _near(a: Column, b: Column, c: Column, d: Column, n: Column, m: Column) -> Column:
    """Whether the bitmaps (a, c) and (b, d) differ in no more bits than similar sets of n and m tokens can."""
    return (TOP + BOTTOM) * (F.bit_count(a.bitwiseXOR(b)) + F.bit_count(c.bitwiseXOR(d))) <= n + m


def _sent(ids: DataFrame) -> DataFrame:
    """A stored table of places as a join's side: sent to all tasks if it has at most ``FEW`` rows, else shuffled."""
    return F.broadcast(ids) if ids.count() <= FEW else ids.hint("merge")


def _verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(at) of the lines y of stored pairs (y, x) of places whose sets are similar enough; deletes the pairs.

    The words of both are read from the texts again, for lines of candidate pairs only.
    """
    places = stored(pairs.select(F.explode(F.array("y", "x")).alias("at")).distinct(), "places")
    found = stored(_plain(_lines(rows).join(_sent(places), "at"), "s").select("at", _tokens(F.col("s")).alias("tokens")), "found")
    side = lambda c: found.dropDuplicates(["at"]).select(F.col("at").alias(c), F.col("tokens").alias(f"t_{c}"))
    both = pairs.join(side("y").hint("merge"), "y").join(side("x").hint("merge"), "x")
    common = F.size(F.array_intersect("t_y", "t_x"))
    both = both.where((TOP + BOTTOM) * common >= TOP * (F.size("t_y") + F.size("t_x")))
    out = stored(both.select(F.col("y").alias("at")).distinct(), "similar")
    forget(pairs, places, found)
    return out


def _led(heads: DataFrame) -> DataFrame:
    """Pairs (y, x) of a line and an earlier one with the same two extreme tokens: of the first document, or the text with
    the most copies, which near copies tend to stem from."""
    rows = heads.select(F.explode("ends").alias("key"), "at", "copies", "n", "b1", "b2")
    of = lambda f, by: F.struct(*(f(c, by).alias(c) for c in ("at", "n", "b1", "b2")))
    leads = rows.groupBy("key").agg(F.count("*").alias("g"), F.array(of(F.min_by, "at"), of(F.max_by, "copies")).alias("leads")).where("g > 1")
    leads = stored(leads.select("key", F.explode(F.array_distinct("leads")).alias("x")), "leads")
    n, m = F.col("n"), F.col("x.n")
    near = _near(F.col("b1"), F.col("x.b1"), F.col("b2"), F.col("x.b2"), n, m)
    met = rows.join(leads.hint("merge"), "key").where((F.col("at") > F.col("x.at")) & _lengths(n, m) & near)
    out = stored(met.select(F.col("at").alias("y"), F.col("x.at").alias("x")).distinct(), "led")
    forget(leads)
    return out


def _rows(heads: DataFrame) -> DataFrame:
    """(key, at, b1, b2, ni, before) of the prefixes ``p`` of lines; ni packs n, the token's place, whether the key has
    the lower class, and open; before is the token before this one (of a pair, before the second, if that isn't the first), if any.

    A rare token is a key. A frequent one of a line of at most ``LONG`` tokens makes a key with each that follows it. As
    the pairs of a long line are too many, a frequent token of a line of at least 0.8 ``LONG`` also makes a key with each
    of two classes of lengths: lines of similar length are in one class or in neighbours, and so share a key. No function of arrays here takes a
    lambda, so all of it is compiled.
    """
    code = lambda at: F.get("p", at).bitwiseAND(F.lit(0xFFFFFFFF))
    hot = F.lit((2 * (HOT.bit_length() - 1) << 32) - (1 << 31))
    n, i, t, k, u = (F.col(c) for c in ("n", "i", "t", "k", "u"))
    c = F.floor(F.log(BOTTOM / TOP, "n")).cast("long")
    none = F.array().cast("array<bigint>")
    pairs = F.when(n <= LONG, F.slice("p", i + 2, F.col("keep") - i)).otherwise(none)
    wide = F.when(BOTTOM * n >= TOP * LONG, F.array(c, c - 1)).otherwise(none)
    one = (t < hot) | (n == 1)
    each = heads.select("at", "n", "b1", "b2", "open", "keep", "p", F.posexplode(F.slice("p", F.lit(1), F.col("keep"))).alias("i", "t"))
    each = each.select("*", F.posexplode(F.when(one, F.array(F.lit(0).cast("long"))).otherwise(F.concat(pairs, wide))).alias("k", "u"))
    paired = F.when(n <= LONG, F.size("p") - 1 - i).otherwise(0)  # the first of u are tokens, the others classes
    key = F.when(one, F.xxhash64("t")).when(k < paired, F.xxhash64("t", "u")).otherwise(F.xxhash64("t", u.cast("int")))
    lower = F.when(one | (k < paired), 0).otherwise(k - paired)
    before = F.when(one | (k == 0) | (k >= paired), code(i - 1)).otherwise(code(i + k))
    ni = F.shiftleft(n.cast("long"), 32).bitwiseOR(F.shiftleft(2 * i + lower, 1).cast("long")).bitwiseOR(F.col("open").cast("long"))
    return each.select(key.alias("key"), "at", "b1", "b2", ni.alias("ni"), before.alias("before"))


def _similar(heads: DataFrame, texts: DataFrame) -> DataFrame:
    """(at) of the lines of ``heads`` that have an earlier similar one."""
    led = _verified(_led(heads), texts)
    lines = heads.join(_sent(led.withColumn("done", F.lit(True))), "at", "left")
    rows = _rows(lines.select("at", "n", "b1", "b2", F.col("done").isNull().alias("open"), "keep", "p"))
    y, x = rows.alias("y"), rows.alias("x")
    n, m = (F.shiftright(f"{s}.ni", 32).cast("int") for s in "yx")
    i, j = (F.shiftright(F.col(f"{s}.ni").bitwiseAND(F.lit(0xFFFFFFFF)), 2).cast("int") for s in "yx")
    # one condition of both sides, not a filter of one: so both read one exchange
    wanted = F.when(F.col("y.at") > F.col("x.at"), F.col("y.ni") % 2 == 1)
    enough = (TOP + BOTTOM) * (1 + F.least(n - i - 1, m - j - 1)) >= TOP * (n + m)
    near = _near(F.col("y.b1"), F.col("x.b1"), F.col("y.b2"), F.col("x.b2"), n, m)
    # two lines that share the token before this one too meet there: equal tokens have equal ranks, and so equal keys;
    # two lines of one class meet there, not in the class below
    first = ~F.coalesce(F.col("y.before") == F.col("x.before"), F.lit(False)) & (F.col("y.ni").bitwiseAND(F.col("x.ni")).bitwiseAND(F.lit(2)) == 0)
    pairs = y.join(x.hint("merge"), (F.col("y.key") == F.col("x.key")) & wanted & first & _lengths(n, m) & enough & near)
    pairs = stored(pairs.select(F.col("y.at").alias("y"), F.col("x.at").alias("x")).distinct(), "pairs")
    return led.unionByName(_verified(pairs, texts)).distinct()


def _kept(rows: DataFrame) -> DataFrame:
    """(at) of every line with a word that stays."""
    sets = _sets(rows)
    heads = _heads(sets)
    forget(sets)
    return heads.select("at").join(_similar(heads, rows).hint("merge"), "at", "left_anti")


def _low(c: str) -> Column:
    return F.col(c).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, line)`` of every line to remove, lines numbered from 0."""
    rows = _numbered(docs, key, text)
    lines = _lines(rows).where(F.col("s").rlike(WORD)).select("doc", "at").distinct()
    gone = lines.join(_kept(rows).hint("merge"), "at", "left_anti")
    return gone.select(F.nullif("doc", F.lit(LAST)).alias(key), _low("at").alias("line"))


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` less its repeated lines, and ``n_lines`` and ``n_removed``; every row stays."""
    rows = _numbered(docs, key, text)
    stay = _kept(rows).groupBy(F.shiftright("at", 31).alias("num")).agg(F.collect_list(_low("at")).alias("stay"))  # no more than a document has lines
    out = rows.join(stay.hint("merge"), "num", "left").select("row", F.split("t", "\n").alias("lines"), F.coalesce("stay", F.array().cast("array<int>")).alias("stay"))
    left = F.filter("lines", lambda s, i: F.array_contains("stay", i) | ~s.rlike(WORD))
    gone = F.filter("lines", lambda s, i: ~F.array_contains("stay", i) & s.rlike(WORD))
    out = out.select("row", "lines", "stay", F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("gone"))
    out = out.select("row", F.when(F.col("gone") > 0, F.array_join(left, "\n")).alias("left"), (F.size("stay") + F.col("gone")).alias("n"), "gone")
    columns = [F.when(F.col("gone") == 0, F.col("row")[c]).otherwise(F.col("left")).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*columns, F.col("n").alias("n_lines"), F.col("gone").alias("n_removed"))
