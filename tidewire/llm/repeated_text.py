"""Repeated byte strings across documents by a depth-limited radix sort of suffixes.

Only the first ``DEPTH`` bytes of a suffix count, and suffixes are refined by most-significant-digit passes that drop
every group found in one document alone. Which suffixes take part is thinned without loss: of each ``DEPTH``-byte
window the ``DIGIT``-byte string with the least hash is its anchor, so equal windows share an anchor at one offset.
Pass 1 groups the anchors by their first digit (its hash). Pass 2 takes the anchors of the surviving groups with the
bytes around them, and sorts each group's windows by their whole ``DEPTH`` bytes: equal runs are exactly the repeated
windows, and a window is removed if its run holds a smaller document id. Removed windows of an anchor overlap, so they
make one interval.

Within a chunk of documents repeats are combined before they are sent: a digit that a chunk holds in two documents is
known to survive, and equal surroundings are sent once, for the smallest id, the others being covered. So a passage that
is everywhere costs each task a few entries per chunk.

Defined cases: a null text is empty; ids must be integers, a null id counts above all others; rows repeated with one id
never remove each other, are cut alike against smaller ids, and give a row each; texts are bytes, so a multi-byte
character may be cut; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.decontaminate import _mix, _powers
from tidewire.llm.places import LAST, with_copies

DEPTH, DIGIT = 50, 20
SIDE = DEPTH - DIGIT
WIDTH = DEPTH + SIDE  # bytes of an anchor's surroundings
BASE = 0x100000001B3
CHUNK, PASS = 1 << 23, 1 << 16
#: Packed rows. The first digit is 32 bits of a hash beside those that chose the bucket: a chance hit of two digits
#: only sends an anchor on to the second pass, which compares bytes.
HEAD = np.dtype([("digit", "<u4"), ("doc", "<i8"), ("copy", "<u4"), ("at", "<u4")])
PLACE = np.dtype([("doc", "<i8"), ("copy", "<u4"), ("at", "<u4")])
SPAN = np.dtype([("doc", "<i8"), ("copy", "<u4"), ("start", "<u4"), ("stop", "<u4")])
AROUND = np.dtype([("doc", "<i8"), ("copy", "<u4"), ("at", "<u4"), ("left", "u1"), ("right", "u1"), ("text", "u1", (WIDTH,))])
TEXT = np.dtype([("doc", "<i8"), ("copy", "<u4"), ("null", "u1"), ("size", "<u4")])


def _pack(rows: np.ndarray) -> bytes:
    """Columns of a record array one after the other, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(rows[n]).tobytes() for n in rows.dtype.names))


def _unpack(data: bytes, kind: np.dtype) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    out = np.empty(len(raw) // kind.itemsize, kind)
    at = 0
    for n in kind.names:
        size = kind[n].itemsize * len(out)
        out[n] = np.frombuffer(raw[at : at + size], kind[n].base).reshape(out[n].shape)
        at += size
    return out


def _rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Mixed polynomial hash of every ``width``-byte string of a byte array, by doubling."""
    h, have, out, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    power = np.uint64(BASE)
    with np.errstate(over="ignore"):
        while True:
            if width & have:
                if out is None:
                    out = h
                else:
                    n = len(data) - done - have + 1
                    out = out[:n] * power + h[done : done + n]
                done += have
            if have * 2 > width:
                return _mix(out[: len(data) - width + 1])
            h = h[:-have] * power + h[have:]
            power, have = power * power, have * 2


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:  # noqa: ANN001
    """``pick`` (minimum or maximum) over every ``width`` consecutive values."""
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def _anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, digit hashes) of the anchors of one text: places whose hash is least in some window."""
    if len(data) < DEPTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = _rolling(data, DIGIT)
    low = _slide(h, SIDE + 1, np.minimum)
    pad = np.zeros(SIDE, np.uint64)
    at = np.flatnonzero(h == _slide(np.concatenate([pad, low, pad]), SIDE + 1, np.maximum))
    return at, h[at]


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about ``CHUNK`` text bytes; the text is column 2."""
    for batch in batches:
        sizes = batch.column(2)
        begin = size = 0
        for i in range(batch.num_rows):
            size += len(sizes[i].as_buffer() or b"") if sizes[i].is_valid else 0
            if size > CHUNK or i == batch.num_rows - 1:
                yield batch.slice(begin, i + 1 - begin)
                begin, size = i + 1, 0


def _home(doc: np.ndarray, copy: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a document."""
    with np.errstate(over="ignore"):
        return (_mix(doc.astype(np.uint64) * np.uint64(BASE) + copy.astype(np.uint64)) >> np.uint64(33)).astype(np.int64) % buckets


def _dealt(rows: np.ndarray, bucket: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
    """(kind, bucket, packed rows) by bucket; rows keep their order."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(rows) else np.empty(0, np.int64)
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(rows)], strict=False):
        yield kind, int(bucket[a]), _pack(rows[a:b])


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kind, bucket, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(data, pa.binary())], names=["kind", "bucket", "data"])


PACKED = "kind int, bucket int, data binary"
#: Kinds of packed rows.
DIGITS, KNOWN, TEXTS, PLACES, AROUNDS, SPANS = range(6)


def _texts(buckets: int):  # noqa: ANN202
    """Whole texts by the bucket of their document: a head per row, then the bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for chunk in _chunks(batches):
            data = [x.as_py() or b"" for x in chunk.column(2)]
            heads = np.empty(len(data), TEXT)
            heads["doc"], heads["copy"], heads["null"] = chunk.column(0).to_numpy(), chunk.column(1).to_numpy(), chunk.column(3).to_numpy(zero_copy_only=False)
            heads["size"] = [len(x) for x in data]
            bucket = _home(heads["doc"], heads["copy"], buckets)
            out = []
            for b in np.unique(bucket).tolist():
                own = np.flatnonzero(bucket == b)
                out.append((TEXTS, b, pack.compress(len(own).to_bytes(8, "little") + heads[own].tobytes() + b"".join(data[i] for i in own.tolist()))))
            yield _batch(out)

    return run


def _read_texts(blob: bytes) -> Iterator[tuple[int, int, bool, bytes]]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    heads = np.frombuffer(raw, TEXT, n, 8)
    at = 8 + n * TEXT.itemsize
    for doc, copy, null, size in heads.tolist():
        yield doc, copy, bool(null), raw[at : at + size]
        at += size


def _gathered(batches: Iterable[pa.RecordBatch], kind: int, dtype: np.dtype) -> tuple[list[bytes], dict[tuple[int, int], np.ndarray]]:
    """(packed texts, rows of the other kind by document) of a task's buckets."""
    texts, parts = [], []
    for batch in batches:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if k == TEXTS:
                texts.append(data)
            elif k == kind:
                parts.append(_unpack(data, dtype))
    if not parts:
        return texts, {}
    rows = np.concatenate(parts)
    rows = rows[np.lexsort((rows["copy"], rows["doc"]))]
    edge = np.flatnonzero(np.r_[True, (rows["doc"][1:] != rows["doc"][:-1]) | (rows["copy"][1:] != rows["copy"][:-1])])
    return texts, {(int(rows["doc"][a]), int(rows["copy"][a])): rows[a:b] for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(rows)], strict=True)}


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of its group, first row of each group) for sorted keys."""
    new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.empty(0, bool)
    return np.cumsum(new) - 1, np.flatnonzero(new)


def _numbered(key: np.ndarray, data: np.ndarray, order: np.ndarray, group: np.ndarray) -> np.ndarray | None:
    """None if rows of a group, in order, hold equal bytes; else, two contents having met in one hash, numbers of the
    contents to use as the key instead."""
    same = np.flatnonzero(group[1:] == group[:-1])
    if (data[order[same]] == data[order[same + 1]]).all():
        return None
    whole = np.ascontiguousarray(data).view(np.dtype((np.void, data.shape[1]))).ravel()
    return np.unique(whole, return_inverse=True)[1].astype(key.dtype)


def _several(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For rows sorted by key: whether the row's key is in two documents or more."""
    if not len(keys):
        return np.empty(0, bool)
    group, first = _groups(keys)
    return (np.minimum.reduceat(docs, first) < np.maximum.reduceat(docs, first))[group]


def _first_digits(buckets: int):  # noqa: ANN202
    """Anchors of each chunk: those the chunk itself knows to survive (KNOWN), and the rest (DIGITS) by digit."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            parts, digits = [], []
            for i in range(chunk.num_rows):
                at, digit = _anchors(np.frombuffer(chunk.column(2)[i].as_py() or b"", np.uint8))
                if len(at):
                    rows = np.empty(len(at), HEAD)
                    rows["digit"], rows["doc"], rows["copy"], rows["at"] = digit & np.uint64(0xFFFFFFFF), chunk.column(0)[i].as_py(), chunk.column(1)[i].as_py(), at
                    parts.append(rows)
                    digits.append(digit)
            if not parts:
                continue
            rows, digit = np.concatenate(parts), np.concatenate(digits)
            order = np.argsort(digit, kind="stable")
            rows, digit = rows[order], digit[order]
            group, first = _groups(digit)
            known = _several(digit, rows["doc"])
            # of a known digit a low and a high document go on as witnesses
            witness = np.zeros(len(rows), bool)
            for pick in (np.minimum, np.maximum):
                at = np.flatnonzero(known & (pick.reduceat(rows["doc"], first)[group] == rows["doc"]))
                witness[at[np.r_[True, group[at][1:] != group[at][:-1]]] if len(at) else at] = True
            # in order of document and place, so that the columns compress
            order = np.lexsort((rows["at"], rows["doc"]))
            sent = order[(~known | witness)[order]]
            out = list(_dealt(rows[sent], (digit[sent] >> np.uint64(32)).astype(np.int64) % buckets, DIGITS))
            own = rows[order[(known & ~witness)[order]]]
            out += _dealt(own[["doc", "copy", "at"]].astype(PLACE), _home(own["doc"], own["copy"], buckets), KNOWN)
            if out:
                yield _batch(out)

    return run


def _survivors(buckets: int):  # noqa: ANN202
    """Pass 1: places of the digits found in several documents, by the bucket of their document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for kind, bucket, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == KNOWN:
                    yield _batch([(PLACES, bucket, data)])
                else:
                    parts.setdefault(bucket, []).append(_unpack(data, HEAD))
        for bucket in list(parts):
            rows = np.concatenate(parts.pop(bucket))
            rows = rows[np.argsort(rows["digit"], kind="stable")]
            rows = rows[_several(rows["digit"], rows["doc"])]
            if len(rows):
                rows = rows[np.lexsort((rows["at"], rows["doc"]))][["doc", "copy", "at"]].astype(PLACE)
                yield _batch(list(_dealt(rows, _home(rows["doc"], rows["copy"], buckets), PLACES)))

    return run


def _digit_of(text: np.ndarray) -> np.ndarray:
    """Digit hash of each row of surroundings."""
    flat = np.ascontiguousarray(text[:, SIDE : SIDE + DIGIT]).reshape(-1)
    return _rolling(flat, DIGIT)[::DIGIT] if len(flat) else np.empty(0, np.uint64)


def _surroundings(buckets: int):  # noqa: ANN202
    """Surviving anchors with the bytes around them by digit (AROUNDS), and what the task's own texts cover (SPANS)."""

    def of(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(parts)
        whole = np.zeros(len(rows), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(WIDTH // 8):
                whole = _mix(whole * np.uint64(BASE) + np.ascontiguousarray(rows["text"][:, 8 * k : 8 * k + 8]).view("<u8")[:, 0])
            whole = _mix(whole ^ (rows["left"].astype(np.uint64) << np.uint64(8) | rows["right"]))
        order = np.lexsort((rows["doc"], whole))
        group, first = _groups(whole[order])
        exact = _numbered(whole, np.column_stack([rows["text"], rows["left"], rows["right"]]), order, group)
        if exact is not None:
            order = np.lexsort((rows["doc"], exact))
            group, first = _groups(exact[order])
        covered = np.zeros(len(rows), bool)
        covered[order] = rows["doc"][order][first][group] < rows["doc"][order]
        sent, own = rows[~covered], rows[covered]
        out = list(_dealt(sent, (_digit_of(sent["text"]) >> np.uint64(32)).astype(np.int64) % buckets, AROUNDS))
        spans = np.empty(len(own), SPAN)
        spans["doc"], spans["copy"] = own["doc"], own["copy"]
        spans["start"], spans["stop"] = own["at"] - own["left"], own["at"] + DIGIT + own["right"]
        spans = spans[spans["stop"] - spans["start"] >= DEPTH]
        out += _dealt(spans, _home(spans["doc"], spans["copy"], buckets), SPANS)
        if out:
            yield _batch(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, places = _gathered(batches, PLACES, PLACE)
        parts, count = [], 0
        for blob in texts:
            for doc, copy, _, raw in _read_texts(blob):
                if (doc, copy) not in places:
                    continue
                data, at = np.frombuffer(raw, np.uint8), np.unique(places[doc, copy]["at"]).astype(np.int64)
                rows = np.zeros(len(at), AROUND)
                rows["doc"], rows["copy"], rows["at"] = doc, copy, at
                rows["left"], rows["right"] = np.minimum(at, SIDE), np.minimum(len(data) - at - DIGIT, SIDE)
                padded = np.concatenate([np.zeros(SIDE, np.uint8), data, np.zeros(SIDE, np.uint8)])
                rows["text"] = padded[at[:, None] + np.arange(WIDTH)]
                parts.append(rows)
                count += len(rows)
                if count > 4 * PASS:
                    yield from of(parts)
                    parts, count = [], 0
        if parts:
            yield from of(parts)

    return run


def _windows(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Pass 2 on whole groups of one digit each: the spans that a smaller document repeats.

    The windows of one offset at a time are sorted by group and content hash, and neighbours of one hash are compared
    byte by byte, so memory is a few numbers per anchor and two contents of one hash are never taken for one.
    """
    low = np.full(len(rows), SIDE + 1, np.int64)
    high = np.full(len(rows), -1, np.int64)
    power = _powers(DEPTH, BASE)[::-1]
    h = np.zeros(len(rows), np.uint64)
    text = rows["text"].astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SIDE + 1):  # the window that begins k bytes into the surroundings
            if k == 0:
                h = (text[:, :DEPTH] * power).sum(axis=1, dtype=np.uint64)
            else:
                h = (h - text[:, k - 1] * power[0]) * np.uint64(BASE) + text[:, k + DEPTH - 1]
            fits = np.flatnonzero((rows["left"] >= SIDE - k) & (rows["right"] >= k))
            if not len(fits):
                continue
            key, window = h.copy(), rows["text"][:, k : k + DEPTH]
            for _ in range(2):
                order = fits[np.lexsort((_mix(key[fits]), group[fits]))]
                new = np.r_[True, (key[order][1:] != key[order][:-1]) | (group[order][1:] != group[order][:-1])]
                exact = _numbered(key, window, order, np.cumsum(new))
                if exact is None:
                    break
                key = exact
            least = np.minimum.reduceat(rows["doc"][order], np.flatnonzero(new))[np.cumsum(new) - 1]
            hit = order[least < rows["doc"][order]]
            low[hit] = np.minimum(low[hit], k)
            high[hit] = k
    hit = np.flatnonzero(high >= 0)
    at = rows["at"][hit].astype(np.int64) - SIDE
    spans = np.empty(len(hit), SPAN)
    spans["doc"], spans["copy"], spans["start"], spans["stop"] = rows["doc"][hit], rows["copy"][hit], at + low[hit], at + high[hit] + DEPTH
    return spans


def _spans(buckets: int):  # noqa: ANN202
    """Pass 2, bucket by bucket, in slices of whole groups."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for kind, bucket, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == SPANS:
                    yield _batch([(SPANS, bucket, data)])
                else:
                    held.setdefault(bucket, []).append(data)
        for bucket in list(held):
            rows = np.concatenate([_unpack(d, AROUND) for d in held.pop(bucket)])
            digit = _digit_of(rows["text"])
            order = np.argsort(digit, kind="stable")
            _, first = _groups(digit[order])
            begin = 0
            for end in [*first[1:].tolist(), len(rows)]:
                if end - begin >= PASS or end == len(rows):
                    own = order[begin:end]
                    spans = _windows(rows[own], _groups(digit[own])[0])
                    if len(spans):
                        spans = spans[np.lexsort((spans["start"], spans["doc"]))]
                        yield _batch(list(_dealt(spans, _home(spans["doc"], spans["copy"], buckets), SPANS)))
                    begin = end

    return run


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, spans = _gathered(batches, SPANS, SPAN)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"])

    rows, size = [], 0
    for blob in texts:
        for doc, copy, null, data in _read_texts(blob):
            merged: list[list[int]] = []
            if (doc, copy) in spans:
                own = spans[doc, copy]
                for a, b in sorted(zip(own["start"].tolist(), own["stop"].tolist(), strict=True)):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
            kept, last = [], 0
            for a, b in merged:
                kept.append(data[last:a])
                last = b
            whole = b"".join([*kept, data[last:]])
            rows.append((None if null else doc, len(data), len(data) - len(whole), merged, whole, hashlib.sha256(whole).hexdigest()))
            size += len(data)
            if size > CHUNK:
                yield out(rows)
                rows, size = [], 0
    if rows:
        yield out(rows)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_bytes, n_removed, spans, kept, kept_sha256)`` for every row; spans are the removed byte runs.

    Everything travels as packed columns per chunk and bucket. Buckets follow the size of the texts, so what a task
    gathers does not grow with the input. Texts move twice, by document, to meet their places and their spans.
    """
    spark = docs.sparkSession
    data = F.coalesce(F.col("t").cast("binary"), F.lit(b""))
    rows = with_copies(docs.select(key, text), key, text).select("doc", "copy", data.alias("data"), F.col("row")[key].isNull().alias("null"))
    total = rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // (1 << 25)))
    texts = rows.mapInArrow(_texts(buckets), PACKED)
    digits = rows.select("doc", "copy", "data").mapInArrow(_first_digits(buckets), PACKED).repartition(buckets, "bucket")
    places = digits.mapInArrow(_survivors(buckets), PACKED)
    around = texts.unionByName(places).repartition(buckets, "bucket").mapInArrow(_surroundings(buckets), PACKED)
    spans = around.repartition(buckets, "bucket").mapInArrow(_spans(buckets), PACKED)
    out = texts.unionByName(spans).repartition(buckets, "bucket").mapInArrow(_cut, "key bigint, n_bytes bigint, n_removed bigint, spans array<array<bigint>>, kept binary, kept_sha256 string")
    return out.withColumnRenamed("key", key)
