"""Benchmark decontamination: size-partitioned MinHash search for test items contained in documents.

Distinct item texts are partitioned by their number n of distinct five-word shingles: partition p holds n from 2^p to
2^(p+1) - 1, and texts of fewer than five words have a partition for each number of words. An item that keeps at least
0.8 of its shingles in a document loses at most n - ceil(0.8 n) of them, so among its n - ceil(0.8 n) + 1 smallest
MinHash values at least one is in the document. The bottom sketch of a partition is as long as its largest n needs, so
each partition's own index loses no match, however long the document. Documents are scanned once per block of items:
the hashes of all word windows of a batch of whole texts are one numpy array, a partition whose smallest item needs
more shingles than a document has is passed over for it, index hits name candidate (document, item) pairs, and a
candidate is verified by counting the item's shingles, as strings, in the document.

Words are lower-cased runs of characters other than ASCII punctuation, controls and space. An item of fewer than five
words is one shingle of all its words. Defined cases: null or wordless items and texts match nothing; repeated rows
match each; a null id is reported as null; extra columns are ignored, and may be named like the result's; texts of any
length are searched whole; empty tables give an empty table.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import forget, stored

SHINGLE, LEAST = 5, (4, 5)  # containment of at least 4 / 5
#: Words of one broadcast block of item texts; a larger benchmark is searched block by block.
BLOCK = 1 << 19
CHUNK = 1 << 22
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPLIT = bytes(32 if i <= 32 or i == 127 or chr(i) in string.punctuation else i for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_SPLIT).split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2 ** 64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    size, step = 1, np.uint64(base)
    with np.errstate(over="ignore"):
        while size < n:
            top = min(size, n - size)
            out[size : size + top] = out[:top] * step
            size, step = size + top, step * step
    return out


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each space-separated word of a byte array."""
    letter = np.concatenate([[False], data != 32, [False]])
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    # sum of byte * base ** (offset in word): offsets are short, so powers are looked up
    size = ends - starts
    offset = np.arange(len(data)) - np.repeat(np.concatenate([[0], starts]), np.concatenate([[starts[0]], np.diff(np.concatenate([starts, [len(data)]]))]))
    power = _powers(int(size.max()) + 1, int(BASE))
    with np.errstate(over="ignore"):
        value = np.where(letter[1:-1], (data.astype(np.uint64) + np.uint64(1)) * power[np.minimum(offset, len(power) - 1)], np.uint64(0))
        return _mix(np.add.reduceat(value, starts) + size.astype(np.uint64)), starts


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = words[:n].copy()
        for k in range(1, width):
            h = h * BASE + words[k : k + n]
        return _mix(h + np.uint64(width))


def _grams(words: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def _need(n: int) -> int:
    """Length of the bottom sketch that cannot miss an item of n shingles."""
    return n - -(-LEAST[0] * n // LEAST[1]) + 1


class _Partition:
    """Index of the items of one width and one range of sizes: MinHash values and, beside each, its item's place."""

    def __init__(self, width: int, items: list[tuple[int, int, np.ndarray]]) -> None:
        self.width = width
        sizes = [n for _, n, _ in items]
        self.least = -(-LEAST[0] * min(sizes) // LEAST[1])  # shingles that a document needs for the smallest item
        length = _need(max(sizes))
        keys = np.concatenate([mins[:length] for _, _, mins in items])
        places = np.repeat(np.array([p for p, _, _ in items], np.int64), [min(len(mins), length) for _, _, mins in items])
        order = np.argsort(keys, kind="stable")
        self.keys, self.places = keys[order], places[order]


class _Index:
    """Size partitions and shingle sets of one block of distinct item texts, given with their digests."""

    def __init__(self, items: list[tuple[str, str]]) -> None:
        self.grams: dict[int, tuple[int, frozenset[bytes]]] = {}
        parts: dict[tuple[int, int], list[tuple[int, int, np.ndarray]]] = {}
        for place, (_, text) in enumerate(items):
            words = words_of(text)
            if not words:
                continue
            width = min(SHINGLE, len(words))
            grams = frozenset(_grams(words, width))
            self.grams[place] = width, grams
            hashes, _ = word_hashes(np.frombuffer(b" ".join(words), np.uint8))
            mins = np.unique(window_hashes(hashes, width))
            parts.setdefault((width, len(grams).bit_length()), []).append((place, len(grams), mins))
        self.parts = [_Partition(width, own) for (width, _), own in sorted(parts.items())]


def _search(index: _Index, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, shingles found, shingles of the item) of each match."""
    split = [words_of(t) for t in texts]
    data = b" ".join(b" ".join(w) for w in split)
    hashes, _ = word_hashes(np.frombuffer(data, np.uint8))
    words = np.fromiter(map(len, split), np.int64, len(split))
    owner = np.repeat(np.arange(len(texts)), words)
    candidates: set[tuple[int, int]] = set()
    width = 0
    for part in index.parts:
        if part.width != width:
            width = part.width
            h = window_hashes(hashes, width)
            inside = np.flatnonzero(owner[: len(h)] == owner[width - 1 :]) if len(h) else np.empty(0, np.int64)
            h, whose = h[inside], owner[inside]
            room = words[whose] - width + 1
        at = np.searchsorted(part.keys, h)
        hit = np.flatnonzero((part.keys[np.minimum(at, len(part.keys) - 1)] == h) & (room >= part.least))
        stop = np.searchsorted(part.keys, h[hit], "right")
        for doc, a, b in zip(whose[hit].tolist(), at[hit].tolist(), stop.tolist(), strict=True):
            candidates.update((doc, p) for p in part.places[a:b].tolist())
    made: dict[int, set[bytes]] = {}
    last = -1
    for doc, place in sorted(candidates):
        if doc != last:
            made, last = {}, doc
        width, grams = index.grams[place]
        if width not in made:
            made[width] = _grams(split[doc], width)
        found = len(grams & made[width])
        if found * LEAST[1] >= len(grams) * LEAST[0]:
            yield doc, place, found, len(grams)


def _index_of(shared) -> _Index:  # noqa: ANN001
    """Index of a broadcast block, built once in each Python worker that reads the block."""
    block = shared.value
    if _BUILT.get("id") != block["id"]:
        _BUILT.clear()
        _BUILT.update(id=block["id"], index=_Index(block["items"]))
    return _BUILT["index"]


_BUILT: dict[str, object] = {}


def _found(batch: pa.RecordBatch, column: int, index: _Index) -> Iterator[tuple[int, int, int, int]]:
    """Matches of a batch by row, the whole texts in slices of about ``CHUNK`` bytes."""
    texts, begin, size = batch.column(column), 0, 0
    for i in range(batch.num_rows + 1):
        if i == batch.num_rows or size > CHUNK:
            for doc, *rest in _search(index, texts.slice(begin, i - begin).to_pylist()):
                yield begin + doc, *rest
            begin, size = i, 0
        if i < batch.num_rows and texts[i].is_valid:
            size += len(texts[i].as_buffer())


def _blocks(benchmark: DataFrame, text: str) -> Iterator[Broadcast]:
    """Distinct item texts as broadcast blocks of at most about ``BLOCK`` words, but for one longer text alone.

    Numbers of words are summed over ranges of texts' hashes first, and one block at a time reaches the driver, as the
    next scan needs it. A text that many items share counts once.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(text).cast("string").alias("text")).where("text IS NOT NULL").distinct()
    items = stored(items.withColumns({"n": F.size(F.split("text", "\\s+")), "digest": F.sha2("text", 256)}), "benchmark")
    blocks = -(-int(items.agg(F.sum("n")).first()[0] or 0) // BLOCK) or 1
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).select("digest", "text").collect()
        yield spark.sparkContext.broadcast({"id": uuid.uuid4().hex, "items": [tuple(r) for r in rows]})
    forget(items)


def contained_items(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """``(key, item, n_found, n_shingles)`` for each document row and item row it contains to 0.8 or more.

    Each block of item texts is broadcast and costs one scan of the documents without a shuffle; what is found meets the
    items' ids by a join on the text's digest.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[key].dataType.simpleString()

    def scan(shared):  # noqa: ANN001, ANN202
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = list(_found(batch, 1, _index_of(shared)))
                if hits:
                    doc, place, found, n = zip(*hits, strict=True)
                    items = shared.value["items"]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array([items[p][0] for p in place]), pa.array(found, pa.int64()), pa.array(n, pa.int64())], names=["key", "digest", "n_found", "n_shingles"])

        return run

    found = None
    for shared in _blocks(benchmark, text):
        one = rows.mapInArrow(scan(shared), f"key {kind}, digest string, n_found bigint, n_shingles bigint")
        found = one if found is None else found.unionByName(one)
    items = benchmark.select(F.col(item).alias("item"), F.sha2(F.col(text).cast("string"), 256).alias("digest"))
    found = found.join(items.hint("merge"), "digest")
    return found.select(F.col("key").alias(key), F.col("item").alias(item), "n_found", "n_shingles")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that contain no benchmark item; every row is judged by itself, nothing is shuffled."""
    place = docs.columns.index(text)

    def clean(shared):  # noqa: ANN001, ANN202
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for doc, *_ in _found(batch, place, _index_of(shared)):
                    keep[doc] = False
                yield batch.filter(pa.array(keep))

        return run

    out = docs
    for shared in _blocks(benchmark, text):
        out = out.mapInArrow(clean(shared), docs.schema)
    return out
