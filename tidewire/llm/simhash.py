"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints that differ in at most three of 64 bits agree, but for at most one bit, in one of their two 32-bit
halves. Every distinct fingerprint is indexed under its 64 one-wildcard half variants (half, wildcard bit, the other 31
bits); an equality shuffle brings candidates together and each is verified. Groups are read as sorted streams: a group
of at most ``SMALL`` fingerprints is linked in place by a spanning forest of verified pairs; the members of a larger
one are indexed again under the one-wildcard variants of the 16-bit quarters of the free half. What is left to vary
there are 18 bits, so a group of the second level has at most 2^18 fingerprints whatever the input, and it is linked by
bitmap lookups of all masks of up to three bits. Classes are the connected components of these links.

Defined cases: a null, empty or blank text has fingerprint zero, which links like any other; rows are fingerprinted
one by one, so repeated rows give repeated results; a null id takes part but is never the class id unless the class
has no other; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.graph import connected_components
from tidewire.session import stored

SHINGLE, SEED, BITS = 3, 42, 3
SMALL = 4096
PART = 1 << 17
#: Bits of each byte value, highest first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of the word shingles of a text."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ends = (starts[min(shingle, len(words)) :] - 1).tolist()
    begins = starts[:n].tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, PART):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(begins[at : at + PART], ends[at : at + PART], strict=True)], np.uint64)
        octets = h.astype(">u8").view(np.uint8).reshape(-1, 8)
        if len(h) < 64:
            counts += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
        else:
            counts += np.concatenate([np.bincount(octets[:, k], minlength=256) @ BYTE_BITS for k in range(8)])
    return int(np.packbits(2 * counts > n).view(">u8")[0])


def fingerprint_of(hashes: np.ndarray) -> int:
    """Unsigned fingerprint of shingle hashes, each counted as often as it is given; 0 of none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PART):
        counts += np.unpackbits(hashes[at : at + PART].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(key, fp)`` for every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fps = np.fromiter((fingerprint(texts[i].as_py(), shingle) for i in range(batch.num_rows)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, fp bigint")


def _keys_first() -> Column:
    """64 keys: half (1 bit), wildcard (5 bits), the half without that bit (32 bits)."""
    out = []
    for s in (0, 1):
        value = F.shiftrightunsigned("fp", 32) if s == 0 else F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
        for b in range(32):
            out.append(value.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << b))).bitwiseOR(F.lit((s << 5 | b) << 32)))
    return F.array(*out)


def _keys_second() -> Column:
    """32 keys below a first key: quarter (1 bit) of the free half, wildcard (4 bits), the quarter without that bit."""
    free = F.when(F.shiftrightunsigned("key", 37) == 0, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    out = []
    for s in (0, 1):
        value = F.shiftrightunsigned(free, 16) if s == 0 else free.bitwiseAND(F.lit(0xFFFF))
        for b in range(16):
            out.append(value.bitwiseAND(F.lit(0xFFFF ^ (1 << b))).bitwiseOR(F.lit((s << 4 | b) << 16)))
    return F.array(*out)


def _forest(fps: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Spanning forest of the links in one group, breadth first; every row of the comparison is one numpy call."""
    a, b = [], []
    left = fps
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = np.bitwise_count(left ^ x) <= BITS
            if near.any():
                hit = left[near]
                a.append(np.full(len(hit), x))
                b.append(hit)
                frontier.extend(hit)
                left = left[~near]
    return a, b


MASKS = np.array(sorted(sum(1 << i for i in c) for n in (1, 2, 3) for c in combinations(range(18), n)), np.int64)


def _forest_wide(fps: np.ndarray, varying: list[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The same for a group that varies in at most 18 bits, by lookups in a bitmap."""
    code = np.zeros(len(fps), np.int64)
    for k, bit in enumerate(varying):
        code |= ((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << k
    place = np.full(1 << 18, -1, np.int64)
    place[code] = np.arange(len(fps))
    free = np.zeros(1 << 18, bool)
    free[code] = True
    a, b = [], []
    for start in code.tolist():
        if not free[start]:
            continue
        free[start] = False
        frontier = np.array([start], np.int64)
        while len(frontier):
            nexts = []
            for at in range(0, len(frontier), 512):
                part = frontier[at : at + 512]
                near = part[:, None] ^ MASKS[None, :]
                hit = free[near]
                to, first = np.unique(near[hit], return_index=True)
                source = np.broadcast_to(part[:, None], near.shape)[hit][first]
                free[to] = False
                a.append(fps[place[source]])
                b.append(fps[place[to]])
                nexts.append(to)
            frontier = np.concatenate(nexts)
    return a, b


def _link(level: int):  # noqa: ANN202
    """Task function over rows (key[, sub], fp) sorted by them: (a, b) links, and at level 1 (key, fp) of large groups."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = level
        rest = np.empty((0, width + 1), np.int64)
        open_key = None  # of a large group whose members are passed on as they come

        def out(a: list, b: list, kind: int) -> pa.RecordBatch:
            a, b = np.concatenate(a), np.concatenate(b)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["kind", "a", "b"])

        def groups(rows: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rest, open_key
            new = np.flatnonzero((rows[1:, :width] != rows[:-1, :width]).any(axis=1)) + 1
            starts, ends = np.r_[0, new], np.r_[new, len(rows)]
            if not last:
                cut = starts[-1]
                if level == 1 and len(rows) - cut > SMALL:
                    open_key = int(rows[cut, 0])
                    yield out([rows[cut:, 0]], [rows[cut:, 1]], 1)
                    rest = rows[:0]
                else:
                    rest = rows[cut:].copy()
                starts, ends = starts[:-1], ends[:-1]
            size = ends - starts
            a, b = [], []
            pairs = starts[size == 2]
            if len(pairs):
                x, y = rows[pairs, width].view(np.uint64), rows[pairs + 1, width].view(np.uint64)
                near = np.bitwise_count(x ^ y) <= BITS
                a.append(x[near])
                b.append(y[near])
            for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
                fps = np.ascontiguousarray(rows[s:e, width]).view(np.uint64)
                if e - s <= SMALL:
                    got = _forest(fps)
                elif level == 1:
                    yield out([rows[s:e, 0]], [rows[s:e, 1]], 1)
                    continue
                else:
                    key, sub = int(rows[s, 0]), int(rows[s, 1])
                    high = 32 if key >> 37 == 0 else 0  # where the first half lies
                    quarter = sub >> 20
                    other = (32 - high) + (16 if quarter == 1 else 0)  # the quarter that is free
                    own = (32 - high) + (0 if quarter == 1 else 16)
                    got = _forest_wide(fps, [high + (key >> 32 & 31), own + (sub >> 16 & 15), *range(other, other + 16)])
                a += got[0]
                b += got[1]
            if a:
                yield out(a, b, 0)

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            if open_key is not None:
                same = rows[:, 0] == open_key
                if same.any():
                    yield out([rows[same, 0]], [rows[same, 1]], 1)
                    rows = rows[~same]
                if len(rows):
                    open_key = None
            if len(rest):
                rows = np.concatenate([rest, rows])
                rest = rows[:0]
            if len(rows):
                yield from groups(rows, False)
        if len(rest):
            yield from groups(rest, True)

    return run


def linked(distinct: DataFrame) -> DataFrame:
    """``(node, component)`` of the distinct fingerprints ``fp`` that are within three bits of another one.

    Shuffled per fingerprint: 64 rows of two longs.
    """
    index = distinct.select("fp", F.explode(_keys_first()).alias("key")).select("key", "fp")
    found = stored(index.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_link(1), "kind tinyint, a bigint, b bigint"), "links")
    second = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    second = second.select("key", F.explode(_keys_second()).alias("sub"), "fp")
    more = second.repartition("key", "sub").sortWithinPartitions("key", "sub", "fp").mapInArrow(_link(2), "kind tinyint, a bigint, b bigint")
    links = found.where("kind = 0").unionByName(more).select("a", "b")
    return connected_components(links, "a", "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(key, fp, component_id)`` for every row: the smallest key reachable over links of at most three bits.

    Only distinct fingerprints are indexed, so exact copies, however many, cost one entry.
    """
    fps = stored(fingerprints(docs, key, text, shingle), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("key").alias("low"))
    classes = linked(distinct).select(F.col("node").alias("fp"), "component")
    labelled = distinct.join(classes.hint("merge"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    lows = labelled.groupBy("component").agg(F.min("low").alias("component_id"))
    ids = labelled.join(lows.hint("merge"), "component").select("fp", "component_id")
    return fps.join(ids.hint("merge"), "fp").select(F.col("key").alias(key), "fp", "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` whose key is the smallest of its class, one of rows repeated with one key.

    Rows with a null key cannot be told apart and all stay.
    """
    found = near_duplicates(docs.where(F.col(key).isNotNull()), key, text)
    found = found.where(F.col(key) == F.col("component_id")).select(key).distinct()
    kept = docs.join(found.hint("merge"), key, "left_semi").dropDuplicates([key])
    return kept.unionByName(docs.where(F.col(key).isNull()))
