"""Near-duplicate articles: TF-IDF cosine pairs, title near-duplicates, clusters.

No all-pairs product: pairs come from joins on rare terms (prefix filter), on hashes of titles, or on 21-grams, each
together with a 48-hour time bucket and its neighbour.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire import vocab
from tidewire.functions.text import norm_text
from tidewire.operators.graph import connected_components
from tidewire.session import cut, stored

HOURS = vocab.WINDOW_HOURS
#: Words of a normalised text, which is ASCII.
WORD = re.compile("[a-z0-9]{2,}")
#: Bits and levels of a weight in a sketch.
BITS = 10
LEVELS = (1 << BITS) - 1


def cluster_text() -> Column:
    """Title twice and the summary, or the start of the content."""
    body = F.coalesce(F.nullif(F.trim("summaries.pt"), F.lit("")), F.substring(F.coalesce("content", F.lit("")), 1, 500))
    return norm_text(F.concat_ws(" ", "title", "title", body))


def _grams(text: Column) -> Column:
    t = F.filter(F.regexp_extract_all(text, F.lit("([a-z0-9]+)"), 1), lambda w: F.length(w) >= 2)
    pairs = F.zip_with(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(t, pairs)


def _terms(classes: DataFrame) -> DataFrame:
    """(key, class, n, terms, tf) of (key, class, n, text): the 1- and 2-grams of each text, each once with its count."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, tf, ends = [], [], [0]
            for text in b.column(3).to_pylist():
                w = WORD.findall(text)
                found = Counter(w)
                found.update(f"{x} {y}" for x, y in zip(w, w[1:]))
                terms.extend(found)
                tf.extend(found.values())
                ends.append(len(terms))
            lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (pa.array(terms, pa.string()), pa.array(tf, pa.int32())))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *lists], names=["key", "class", "n", "terms", "tf"])

    return classes.select("key", "class", "n", "text").mapInArrow(run, "key string, class long, n long, terms array<string>, tf array<int>")


def _classes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (id, ts, class), and the classes (key, class, n, terms, tf) of equal texts: copies are compared once, and counted.

    A class is a number; ``key`` is the digest of its text, by which the classes are dealt. ``df`` is read once.
    """
    texts = df.select("id", F.coalesce("published_at", "collected_at").alias("ts"), cluster_text().alias("text")).withColumn("key", F.md5("text"))
    keyed = stored(texts, "keyed")
    classes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.first("text").alias("text")).withColumn("class", F.monotonically_increasing_id())
    classes = stored(_terms(classes), "tf")
    rows = stored(keyed.select("id", "ts", "key").join(classes.select("key", "class").hint("merge"), "key").select("id", "ts", "class"), "rows")
    return rows, classes


def tfidf(rows: DataFrame, classes: DataFrame, most: int = 10_000) -> DataFrame:
    """(class, terms, weights): normalised weights over the ``most`` frequent 1- and 2-grams of all rows; idf is smoothed.

    A term is its place by rising document frequency; a class has one row, with its terms in that order. The vocabulary, of
    ``most`` terms at most, passes the driver.
    """
    each = classes.select("n", F.explode(F.arrays_zip("terms", "tf")).alias("x")).select("n", "x.*")
    vocabulary = each.groupBy(F.col("terms").alias("term")).agg(F.sum(F.col("tf") * F.col("n")).alias("total"), F.sum("n").alias("df")).orderBy(F.desc("total"), "term").limit(most)
    n = rows.agg(F.count("*").alias("n_docs"))
    idf = vocabulary.crossJoin(F.broadcast(n)).select("term", "df", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf")).orderBy("df", "term").toArrow()
    known, factor = idf["term"].combine_chunks().cast(pa.string()), idf["idf"].to_numpy()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = pc.fill_null(pc.index_in(b.column(1).flatten().cast(pa.string()), value_set=known), -1).to_numpy()
            row = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy())
            at = np.flatnonzero(place >= 0)
            at = at[np.lexsort((place[at], row[at]))]
            place, row = place[at], row[at]
            x = b.column(2).flatten().to_numpy()[at] * factor[place]
            w = x / np.sqrt(np.bincount(row, x * x, b.num_rows))[row]
            sizes = np.bincount(row, minlength=b.num_rows)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = (pa.ListArray.from_arrays(ends, x) for x in (pa.array(place + 1, pa.int32()), pa.array(w, pa.float64())))
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=["class", "terms", "weights"]).filter(pa.array(sizes > 0))

    return classes.select("class", "terms", "tf").mapInArrow(run, "class long, terms array<int>, weights array<double>")


def _prefixes(vectors: DataFrame, least: float) -> DataFrame:
    """(class, term, w, after) of the terms of each vector up to where the rest of its norm is below ``least``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(1).value_lengths().to_numpy()
            w = b.column(2).flatten().to_numpy()
            square = w * w
            total = np.concatenate([[0.0], np.cumsum(square)])
            rest = 1 - (total[:-1] - np.repeat(total[np.cumsum(sizes) - sizes], sizes))
            keep = rest >= least * least - 1e-9
            after = np.sqrt(np.maximum(rest - square, 0.0))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), sizes)[keep]), pa.array(b.column(1).flatten().to_numpy()[keep]), pa.array(w[keep]), pa.array(after[keep])], names=["class", "term", "w", "after"])

    return vectors.select("class", "terms", "weights").mapInArrow(run, "class long, term int, w double, after double")


def _sketches(vectors: DataFrame) -> DataFrame:
    """(class, sketch): a vector in four bytes a term, its place and its weight rounded up to a multiple of 1 / ``LEVELS``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = b.column(1).flatten().to_numpy().astype(np.int64)
            if len(terms) and terms.max() >= 1 << 32 - BITS:
                raise ValueError(f"a vocabulary of over {1 << 32 - BITS} terms")
            # a weight may be over 1 by rounding errors, and may not run over into the place
            level = np.clip(np.ceil(b.column(2).flatten().to_numpy() * LEVELS), 0, LEVELS).astype(np.int64)
            packed = (terms << BITS | level).astype("<u4").tobytes()
            ends = np.concatenate([[0], np.cumsum(b.column(1).value_lengths().to_numpy())]) * 4
            sketch = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(packed)])
            yield pa.RecordBatch.from_arrays([b.column(0), sketch], names=["class", "sketch"])

    return vectors.select("class", "terms", "weights").mapInArrow(run, "class long, sketch binary")


def _products() -> Callable[..., np.ndarray]:
    """A function of a number of pairs and two sides (row, term, weight), terms rising in each row: the products of the pairs.

    It is made here, so that tasks get it by value.
    """

    def dots(n: int, x: tuple[np.ndarray, np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        u, v = x[0] << 32 | x[1], y[0] << 32 | y[1]
        place = np.minimum(np.searchsorted(v, u), max(len(v) - 1, 0))
        hit = v[place] == u if len(v) else np.zeros(len(u), bool)
        return np.bincount(x[0][hit], x[2][hit] * y[2][place[hit]], n)

    return dots


def _likely(pairs: DataFrame, least: float) -> DataFrame:
    """(c, d) of rows (c, sc, d, sd) whose sketches, of which no weight is too small, allow the threshold."""
    dots = _products()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            def side(at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                sizes = pc.binary_length(b.column(at)).to_numpy() // 4
                packed = np.frombuffer(b"".join(b.column(at).to_pylist()), "<u4").astype(np.int64)
                return np.repeat(np.arange(b.num_rows), sizes), packed >> BITS, (packed & (1 << BITS) - 1) / LEVELS

            above = dots(b.num_rows, side(1), side(3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2)], names=["c", "d"]).filter(pa.array(above >= least - 1e-9))

    return pairs.select("c", "sc", "d", "sd").mapInArrow(run, "c long, d long")


def _cosines(pairs: DataFrame) -> DataFrame:
    """(c, d, cosine) of rows (c, tc, wc, d, td, wd) of two vectors each."""
    dots = _products()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            def side(at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                t = b.column(at).flatten().to_numpy().astype(np.int64)
                return np.repeat(np.arange(b.num_rows), b.column(at).value_lengths().to_numpy()), t, b.column(at + 1).flatten().to_numpy()

            cosine = dots(b.num_rows, side(1), side(4))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(cosine)], names=["c", "d", "cosine"])

    return pairs.select("c", "tc", "wc", "d", "td", "wd").mapInArrow(run, "c long, d long, cosine double")


def _near_in_time(a: str, b: str) -> Column:
    return F.col(a).isNull() | F.col(b).isNull() | (F.abs(F.col(a).cast("long") - F.col(b).cast("long")) <= HOURS * 3600)


def similar_classes(rows: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """(c, d, cosine) of classes c < d of similarity ``least`` or more with rows that may be within 48 hours.

    Vectors are ordered by rising document frequency and indexed only until the rest of their norm is below the
    threshold, so two similar ones share an indexed term. Two vectors that meet at a term are compared only if what they have
    there and the norms of what comes after allow the threshold; if they share an earlier term, they meet there. So a term that
    many vectors have late in their order brings few of them together. Of most pairs that meet, sketches of the vectors show that
    they are not similar; only the others meet their whole vectors.
    """
    prefix = _prefixes(vectors, least)
    bucket = F.floor(F.col("ts").cast("long") / (HOURS * 3600))
    seen = stored(rows.select("class", bucket.alias("bucket")).distinct(), "seen")
    indexed = stored(prefix.join(seen.hint("merge"), "class"), "indexed")
    side = lambda df, name: df.select(F.col("class").alias(name), "term", F.col("w").alias(f"w{name}"), F.col("after").alias(f"after{name}"), "bucket")
    timed = indexed.where("bucket IS NOT NULL")
    # a row meets those of its own bucket and of the one after it
    x = side(timed, "c").withColumn("next", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("bucket", F.col("bucket") + F.col("next"))
    may = (F.col("wc") * F.col("wd") + F.col("afterc") * F.col("afterd")) >= least - 1e-9
    once = F.when(F.col("next") == 0, F.col("c") < F.col("d")).otherwise(F.col("c") != F.col("d"))
    met = x.join(side(timed, "d").hint("merge"), ["term", "bucket"]).where(once & may)
    timeless = side(indexed.where("bucket IS NULL"), "c").drop("bucket")
    free = timeless.join(side(indexed, "d").drop("bucket").distinct().hint("merge"), "term").where((F.col("c") != F.col("d")) & may)
    ordered = [F.least("c", "d").alias("c"), F.greatest("c", "d").alias("d")]
    pairs = stored(met.select(*ordered).unionByName(free.select(*ordered)).distinct(), "met")
    sketches = stored(_sketches(vectors), "sketches", **{"parquet.enable.dictionary": "false"})
    drawn = lambda name: sketches.select(F.col("class").alias(name), F.col("sketch").alias(f"s{name}"))
    pairs = stored(_likely(pairs.join(drawn("c").hint("merge"), "c").join(drawn("d").hint("merge"), "d"), least), "likely")
    packed = lambda name: vectors.select(F.col("class").alias(name), F.col("terms").alias(f"t{name}"), F.col("weights").alias(f"w{name}"))
    return _cosines(pairs.join(packed("c").hint("merge"), "c").join(packed("d").hint("merge"), "d")).where(F.col("cosine") >= least - 1e-12)


def cosine_pairs(df: DataFrame, least: float = vocab.SIMILAR, most: int = 10_000) -> DataFrame:
    """(a, b, cosine) of rows of similarity ``least`` or more within 48 hours; a row without a time matches any time.

    Classes of equal texts are compared, and their pairs expanded to rows at the end; ``narrative_clusters`` needs no such pairs.
    """
    rows, classes = _classes(df)
    vectors = stored(tfidf(rows, classes, most), "tfidf")
    same = vectors.select(F.col("class").alias("c"), F.col("class").alias("d"), F.aggregate("weights", F.lit(0.0), lambda s, w: s + w * w).alias("cosine"))
    similar = stored(similar_classes(rows, vectors, least).unionByName(same), "similar")
    bucket = F.floor(F.col("ts").cast("long") / (HOURS * 3600))
    a = rows.select(F.col("id").alias("a"), F.col("ts").alias("ta"), F.col("class").alias("c"), bucket.alias("bucket"))
    b = rows.select(F.col("id").alias("b"), F.col("ts").alias("tb"), F.col("class").alias("d"), bucket.alias("bucket"))
    left = a.join(similar.hint("merge"), "c")
    near = left.where("ta IS NOT NULL").withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, "bucket", F.col("bucket") + 1))).join(b.hint("merge"), ["d", "bucket"])
    free = left.where("ta IS NULL").drop("bucket").join(b.drop("bucket").hint("merge"), "d")
    free = free.unionByName(left.where("ta IS NOT NULL").drop("bucket").join(b.where("tb IS NULL").drop("bucket").hint("merge"), "d"))
    pairs = near.where(_near_in_time("ta", "tb")).select("a", "b", "c", "d", "cosine").unionByName(free.select("a", "b", "c", "d", "cosine"))
    # a pair within a class comes from both sides
    return pairs.where((F.col("c") != F.col("d")) | (F.col("a") < F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine")


def narrative_clusters(df: DataFrame, least: float = vocab.SIMILAR, most: int = 10_000) -> DataFrame:
    """(id, narrative_cluster_id): the clusters of ``cosine_pairs`` without their pairs.

    The rows of a class in one cell of 24 hours are one node, as they are all within 48 hours. Nodes of similar classes, or of
    one class, are linked if their closest rows are; for that the first and last time of each is enough.
    """
    rows, classes = _classes(df)
    cell = F.floor(F.col("ts").cast("long") / (HOURS * 1800))
    vectors = stored(tfidf(rows, classes, most), "tfidf")
    rows = rows.select("id", "class", "ts", F.concat_ws(":", F.col("class").cast("string"), F.coalesce(cell.cast("string"), F.lit("-"))).alias("node"), cell.alias("cell"))
    known = vectors.select("class")
    nodes = rows.groupBy("node", "class", "cell").agg(F.count("*").alias("n"), F.min("ts").cast("long").alias("low"), F.max("ts").cast("long").alias("high")).join(known.hint("merge"), "class", "left_semi")
    nodes = stored(nodes, "nodes")
    similar = similar_classes(rows, vectors, least).select("c", "d")
    u = nodes.select(F.col("class").alias("c"), F.col("node").alias("a"), F.col("cell").alias("ca"), F.col("low").alias("la"), F.col("high").alias("ha"))
    v = nodes.select(F.col("class").alias("d"), F.col("node").alias("b"), F.col("cell").alias("cb"), F.col("low").alias("lb"), F.col("high").alias("hb"))
    left = u.join(similar.hint("merge"), "c")
    gap = F.greatest(F.col("lb") - F.col("ha"), F.col("la") - F.col("hb"))
    beside = left.where("ca IS NOT NULL").withColumn("cb", F.explode(F.sequence(F.col("ca") - 2, F.col("ca") + 2))).join(v.hint("merge"), ["d", "cb"]).where(gap <= HOURS * 3600)
    free = left.where("ca IS NULL").join(v.hint("merge"), "d")
    free = free.select("a", "b").unionByName(left.where("ca IS NOT NULL").join(v.where("cb IS NULL").hint("merge"), "d").select("a", "b"))
    order = W.partitionBy("class").orderBy("cell")
    own = nodes.where("cell IS NOT NULL").withColumns({"b": F.lag("node").over(order), "before": F.lag("high").over(order)}).where(F.col("low") - F.col("before") <= HOURS * 3600).select(F.col("node").alias("a"), "b")
    timeless = nodes.where("cell IS NULL").select("class", F.col("node").alias("a")).join(nodes.where("cell IS NOT NULL").select("class", F.col("node").alias("b")).hint("merge"), "class").select("a", "b")
    links = beside.select("a", "b").unionByName(free).unionByName(own).unionByName(timeless)
    found = connected_components(links, "a", "b")
    alone = nodes.where("n > 1").select("node", F.col("node").alias("component")).join(found.select("node").hint("merge"), "node", "left_anti")
    members = stored(rows.select("id", "node").join(found.unionByName(alone).hint("merge"), "node").select(F.col("id").alias("node"), "component"), "members")
    return members.join(cluster_names(members).hint("merge"), "component").select(F.col("node").alias("id"), "narrative_cluster_id")


def clusters(pairs: DataFrame) -> DataFrame:
    """(id, narrative_cluster_id) of the connected components of pairs (a, b). The id hashes the sorted members."""
    found = stored(connected_components(pairs, "a", "b"), "members")
    return found.join(cluster_names(found).hint("merge"), "component").select(F.col("node").alias("id"), "narrative_cluster_id")


def cluster_names(members: DataFrame) -> DataFrame:
    """(component, narrative_cluster_id) from (node, component): the digest of the members in order.

    The members of a component pass one hash in order of their ids and are never held together.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            done = []
            for component, node in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if component != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = component, hashlib.sha256()
                state.update(node.encode())
            yield _names(done)
        if state is not None:
            yield _names([(now, state.hexdigest())])

    def _names(done: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.string()), pa.array([f"cluster_{d[:8]}" for _, d in done], pa.string())], names=["component", "narrative_cluster_id"])

    rows = members.select(F.col("component").cast("string"), F.col("node").cast("string")).repartition("component").sortWithinPartitions("component", "node")
    return rows.mapInArrow(run, "component string, narrative_cluster_id string")


def title_matches(titles: DataFrame, jaccard: float = vocab.JACCARD, long: int = 20) -> DataFrame:
    """(x, y) and (y, x) of different titles ``t`` of which one lies within the other, both over ``long`` characters, or whose words
    are similar.

    Containment looks for the first long + 1 characters of a title among all grams of that length of the others; similar
    words use a prefix filter.
    """
    size = long + 1
    grams = titles.where(F.length("t") > long).select(F.col("t").alias("big"), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("t") - long), lambda i: F.substring(F.col("t"), i, F.lit(size))))).alias("g"))
    inside = titles.where(F.length("t") > long).select(F.col("t").alias("small"), F.substring("t", 1, size).alias("g")).join(grams.hint("merge"), "g").where((F.col("small") != F.col("big")) & F.contains("big", "small")).select(F.col("small").alias("x"), F.col("big").alias("y"))
    sets = titles.select("t", F.array_distinct(F.split("t", " ")).alias("w"))
    tokens = sets.select("t", F.size("w").alias("n"), F.explode("w").alias("w"))
    freq = tokens.groupBy("w").agg(F.count("*").alias("f"))
    ranked = tokens.join(freq.hint("merge"), "w").withColumn("i", F.row_number().over(W.partitionBy("t").orderBy("f", "w")))
    prefix = ranked.where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * jaccard - 1e-9) + 1).select("t", "n", "w")
    near = prefix.select(F.col("t").alias("x"), F.col("n").alias("m"), "w").join(prefix.select(F.col("t").alias("y"), "n", "w").hint("merge"), "w").where((F.col("x") < F.col("y")) & (F.col("m") >= F.col("n") * jaccard) & (F.col("n") >= F.col("m") * jaccard)).select("x", "y").distinct()
    wx, wy = F.array_distinct(F.split("x", " ")), F.array_distinct(F.split("y", " "))
    near = near.where(F.size(F.array_intersect(wx, wy)) >= jaccard * F.size(F.array_union(wx, wy)) - 1e-9)
    both = inside.unionByName(near)
    return both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()


def title_pairs(df: DataFrame, jaccard: float = vocab.JACCARD, long: int = 20) -> DataFrame:
    """(a, b, pa, pb): earlier row a and later row b (by ordinal) whose titles are equal, one within the other with both
    over ``long`` characters, or of similar words, within 48 hours. Matches are found between distinct titles and expanded to
    rows at the end; ``first_wins`` needs no such pairs.
    """
    rows = stored(df.select("id", "ordinal", F.coalesce("published_at", "collected_at").alias("ts"), norm_text("title").alias("t")).where("t <> ''"), "titles")
    titles = rows.select("t").distinct()
    match = title_matches(titles, jaccard, long).unionByName(titles.select(F.col("t").alias("x"), F.col("t").alias("y")))
    bucket = F.floor(F.col("ts").cast("long") / (HOURS * 3600))
    a = rows.select(F.col("id").alias("a"), F.col("ordinal").alias("pa"), F.col("ts").alias("ta"), F.col("t").alias("x"), bucket.alias("ka"))
    b = rows.select(F.col("id").alias("b"), F.col("ordinal").alias("pb"), F.col("ts").alias("tb"), F.col("t").alias("y"), bucket.alias("kb"))
    met = b.join(match.hint("merge"), "y")
    timed = met.where("tb IS NOT NULL").withColumn("ka", F.explode(F.array(F.col("kb") - 1, "kb", F.col("kb") + 1))).join(a.where("ta IS NOT NULL").hint("merge"), ["x", "ka"])
    timed = timed.where(F.abs(F.col("ta").cast("long") - F.col("tb").cast("long")) <= HOURS * 3600)
    free_b = met.where("tb IS NULL").join(a.drop("ka").hint("merge"), "x")
    free_a = met.where("tb IS NOT NULL").join(a.where("ta IS NULL").drop("ka").hint("merge"), "x")
    cols = ["a", "b", "pa", "pb"]
    return timed.where("pa < pb").select(cols).unionByName(free_b.where("pa < pb").select(cols)).unionByName(free_a.where("pa < pb").select(cols))


def first_wins(pairs: DataFrame) -> DataFrame:
    """(node, kept_by): rows that an earlier kept row matches, in ingest order, with the earliest such row, from any pairs.

    For near-duplicate titles ``operators.first_wins`` needs no pairs.

    Rounds: a row whose earlier neighbours are all decided decides; each round is two joins on the row, and only the
    number of open rows reaches the driver.
    """
    edges = cut(pairs.select("pa", "pb").distinct())
    nodes = cut(edges.select(F.explode(F.array("pa", "pb")).alias("node")).distinct().select("node", F.lit(None).cast("boolean").alias("kept")))
    while True:
        state = edges.join(nodes.select(F.col("node").alias("pa"), F.col("kept").alias("ka")).hint("merge"), "pa").groupBy("pb").agg(F.bool_or("ka").alias("hit"), F.count_if(F.col("ka").isNull()).alias("open"))
        met = nodes.join(state.select(F.col("pb").alias("node"), "hit", "open").hint("merge"), "node", "left")
        new = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("hit"), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        nodes = cut(met.select("node", new.alias("kept")))
        if not nodes.where("kept IS NULL").limit(1).count():
            break
    kept = nodes.where("kept").select(F.col("node").alias("pa"))
    gone = nodes.where("NOT kept").select(F.col("node").alias("pb"))
    return edges.join(kept.hint("merge"), "pa").join(gone.hint("merge"), "pb").groupBy("pb").agg(F.min("pa").alias("kept_by")).withColumnRenamed("pb", "node")
