"""Near copies by word shingles: SimHash classes and MinHash bands find candidates, exact Jaccard similarity decides.

A text is the set of its ``SHINGLE``-word shingles, by 64-bit hashes. Equal sets count once. Each distinct set has a
fingerprint, and the fingerprints are classed by the deletion-variant signatures of ``simhash``: sets whose fingerprints are
linked over at most three bits share a key. As sets of similarity 0.8 differ in about 10 of 64 bits, each set has besides
``BANDS`` keys of ``ROWS`` MinHash values; two sets of similarity s share none with probability (1 - s^ROWS)^BANDS, which
at 0.8 is 3.2e-6. Groups of one key with the same members are read once, and inside a group pairs are verified on the
whole sets, as a spanning forest. Of a group of more than ``GROUP`` sets all are compared with one first, in as many tasks
as they fill; only those that it isn't similar to are then compared with the whole group, in blocks of about ``BLOCK``
sets on either side, so that no task holds more. Classes are the connected components of the verified pairs.

Defined cases: null, empty and blank texts are copies of each other; a text of fewer words than a shingle is one shingle;
words and letter case are those of ``simhash.fingerprint``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import simhash
from tidewire.operators.graph import connected_components
from tidewire.session import stored

SHINGLE, LEAST, SEED = 5, 0.8, 42
BANDS, ROWS = 24, 4
PART = 4096
#: Sets of one key that one task verifies; sets on either side of a block of a larger group.
GROUP, BLOCK = 4096, 2048
#: Numbers by which texts of one key are told apart.
TEXTS = 1 << 60


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    ends = (starts[min(shingle, len(words)) :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends, strict=True)), np.uint64, n))


def _factors() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    return r.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def bands(hashes: np.ndarray) -> list[int]:
    """Signed keys of a set, one a band."""
    import xxhash

    a, b = _FACTORS
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), PART):
        low = np.minimum(low, (hashes[at : at + PART, None] * a + b).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64).tolist()


_FACTORS = _factors()


def _sets(docs: DataFrame, key: str, text: str, shingle: int, whole: bool) -> DataFrame:
    """``(key, fp, sim, keys)`` of every row: fp stands for the set, sim is its fingerprint (0 if ``whole``); ``keys`` are its
    bands, or if ``whole`` its hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [shingles(x, shingle) for x in part.column(1).to_pylist()]
                fps = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in found], np.uint64).view(np.int64)
                keys = [x.view(np.int64) for x in found] if whole else [bands(x) if len(x) else [] for x in found]
                sims = np.array([0 if whole else simhash.fingerprint_of(x) for x in found], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps), pa.array(sims), pa.array(keys, pa.list_(pa.int64()))], names=["key", "fp", "sim", "keys"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, fp bigint, sim bigint, keys array<bigint>")


def forest(sets: list[np.ndarray], least: float, asks: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the pairs of similarity ``least`` or more of which one ``asks``, as places in ``sets``, breadth first."""
    out: list[tuple[int, int]] = []
    size = np.array([len(x) for x in sets])
    left = np.arange(len(sets))
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            mine, n = sets[x], size[x]
            near = (asks[x] | asks[left]) & (size[left] >= least * n - 1e-9) & (n >= least * size[left] - 1e-9)
            for k in np.flatnonzero(near):
                other = sets[left[k]]
                place = np.searchsorted(mine, other)
                shared = int((mine[np.minimum(place, n - 1)] == other).sum())
                near[k] = shared >= least * (n + len(other) - shared) - 1e-9
            hit = left[near]
            out += [(int(x), int(y)) for y in hit]
            frontier.extend(hit)
            left = left[~near]
    return out


def _verified(members: DataFrame, least: float) -> DataFrame:
    """Links (a, b) of rows (band, fp, asks, keys): a spanning forest of the similar pairs of each band of which one ``asks``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, fps, asks, sets = None, [], [], []

        def links() -> pa.RecordBatch:
            pairs = forest(sets, least, np.array(asks))
            return pa.RecordBatch.from_arrays([pa.array([fps[x] for x, _ in pairs], pa.int64()), pa.array([fps[y] for _, y in pairs], pa.int64())], names=["a", "b"])

        for batch in batches:
            columns, arrays = (batch.column(i).to_pylist() for i in range(3)), batch.column(3)
            for i, (k, fp, ask) in enumerate(zip(*columns, strict=True)):
                if k != band:
                    if len(fps) > 1:
                        yield links()
                    band, fps, asks, sets = k, [], [], []
                fps.append(fp)
                asks.append(ask)
                sets.append(arrays[i].values.to_numpy().view(np.uint64).copy())
        if len(fps) > 1:
            yield links()

    dealt = members.select("band", "fp", "asks", "keys").repartition("band").sortWithinPartitions("band", "fp")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _large(group: DataFrame, least: float) -> DataFrame:
    """Links (a, b) of a stored table (band, fp, n, keys) of groups too large for a task.

    The first set of a group is compared with all of it. Pairs of two sets near that one need no more: both are linked to
    it. Each other set is compared with the whole group, block by block.
    """
    low = group.groupBy("band").agg(F.min("fp").alias("fp"))
    lead = stored(group.join(low.hint("merge"), ["band", "fp"], "left_semi").select("band", F.col("fp").alias("lead"), F.col("keys").alias("its")), "lead")
    shared = F.size(F.array_intersect("keys", "its"))
    near = shared >= least * (F.size("keys") + F.size("its") - shared) - 1e-9
    star = stored(group.join(lead.hint("merge"), "band").select("band", "fp", "lead", near.alias("near")), "star")
    rest = star.where("NOT near").select("band", "fp", F.lit(True).alias("rest"))
    sizes = stored(rest.groupBy("band").agg(F.count("*").alias("r")), "sizes")
    parts = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    part = lambda n: F.pmod(F.hash("fp"), parts(n))
    every = lambda n: F.sequence(F.lit(0), parts(n) - 1)
    rows = group.join(sizes.hint("merge"), "band").join(rest.hint("merge"), ["band", "fp"], "left")
    sides = F.array(F.struct(F.lit(False).alias("asks"), F.array(part("n")).alias("i"), every("r").alias("j")), F.struct(F.lit(True).alias("asks"), every("n").alias("i"), F.array(part("r")).alias("j")))
    rows = rows.select("band", "fp", "keys", F.explode(F.when(F.col("rest"), sides).otherwise(F.slice(sides, 1, 1))).alias("s"))
    rows = rows.select("band", "fp", "keys", "s.asks", F.explode("s.i").alias("i"), "s.j").select("band", "fp", "keys", "asks", "i", F.explode("j").alias("j"))
    met = _verified(rows.withColumn("band", F.xxhash64("band", "i", "j")), least).where("a <> b")
    return star.where("near AND fp <> lead").select(F.col("lead").alias("a"), F.col("fp").alias("b")).unionByName(met)


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """``(key, fp, component_id)`` for every row: the smallest key reachable over pairs of similarity ``least`` or more."""
    found = stored(_sets(docs, key, text, shingle, False), "bands")
    distinct = found.groupBy("fp").agg(F.min("key").alias("low"), F.any_value("keys").alias("keys"))
    marks = stored(found.where(F.size("keys") > 0).select("fp", "sim").distinct(), "marks")
    alike = simhash.linked(marks.select(F.col("sim").alias("fp")).distinct()).select(F.col("node").alias("sim"), "component")
    alike = marks.join(alike.hint("merge"), "sim", "left").select("fp", F.xxhash64(F.lit("simhash"), F.coalesce("component", "sim")).alias("band"))
    index = stored(distinct.select("fp", F.explode("keys").alias("band")).unionByName(alike), "index")
    groups = index.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.hash("fp")).alias("y")).where("n > 1")
    chosen = groups.groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band", "n")
    members = stored(index.join(chosen.hint("merge"), "band"), "members")
    open_sets = members.select("fp").distinct()
    lows = found.join(open_sets.hint("merge"), "fp", "left_semi").groupBy("fp").agg(F.min("key").alias("key"))
    again = docs.join(lows.select(F.col("key").alias(key)).distinct().hint("merge"), key, "left_semi")
    sets = _sets(again, key, text, shingle, True).groupBy("fp").agg(F.any_value("keys").alias("keys"))
    whole = members.join(stored(sets, "sets").hint("merge"), "fp")
    links = _verified(whole.where(F.col("n") <= GROUP).withColumn("asks", F.lit(True)), least)
    if members.where(F.col("n") > GROUP).limit(1).count():
        links = links.unionByName(_large(stored(whole.where(F.col("n") > GROUP), "large"), least))
    classes = connected_components(links.distinct(), "a", "b").select(F.col("node").alias("fp"), "component")
    smallest = found.groupBy("fp").agg(F.min("key").alias("low"))
    labelled = smallest.join(classes.hint("merge"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    ids = labelled.join(labelled.groupBy("component").agg(F.min("low").alias("component_id")).hint("merge"), "component").select("fp", "component_id")
    return found.select("key", "fp").join(ids.hint("merge"), "fp").select(F.col("key").alias(key), "fp", "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """The row of the smallest key of each class, with its own columns; keys must be integers.

    Where keys repeat or are null, rows are told apart by their texts as well: of rows with one key, those of different
    texts are documents of their own, in the order of their texts' hashes, and a null key comes last. Rows of one key
    and one text are one document, of which one row stays.
    """
    repeats = docs.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).where("n > 1 OR k IS NULL").limit(1).count()
    place = F.col(key)
    if repeats:
        place = F.coalesce(place.cast("decimal(19,0)"), F.lit(Decimal(1 << 63))) * F.lit(Decimal(TEXTS)) + F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(TEXTS))
        place = place.cast("decimal(38,0)")
    rows = docs.select(F.struct("*").alias("row"), place.alias("place"), F.col(text).alias("text"))
    found = near_copies(rows.select("place", "text"), "place", "text", shingle, least)
    found = found.where("place = component_id").select("place").distinct()
    kept = rows.select("row", "place").join(found.hint("merge"), "place", "left_semi")
    kept = kept.dropDuplicates(["place"]) if repeats else kept
    return kept.select("row.*")
