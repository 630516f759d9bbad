"""WARC archives: a writer that turns repeats into revisit records, and a reader that salvages damaged archives.

``write_archives`` packs one gzip member per record into archives of about ``ARCHIVE`` bytes, each a row (archive,
data) that Spark's own writer commits, so a lost executor only repeats its tasks. ``read_archives`` accepts such rows
or files read with ``spark.read.format("binaryFile")``; after a failed check it searches for the next gzip member or
version line, goes on there, and reports the bytes between as a gap with the reason. Inside a member it goes on at the next
version line of the content, also of what was inflated before an error; gaps there bear the offsets of their member. If
only the checksum of a member fails, a record counts if its own digest holds and it is not the only one.

Defined cases: a null payload is empty; a null url writes no target header; rows with the same id and payload are all
responses if that id is the kept one; a null id counts below every other; an empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARCHIVE, STEP = 1 << 22, 1 << 16
LEAST = 1000
URN = "urn:tidewire:page:"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORDS = "archive string, start long, stop long, reason string, warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def decide(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> DataFrame:
    """``(key, url, payload, digest, size, refers_to)``: of equal payloads of ``least`` bytes or more the largest key
    is kept, the others refer to it. Digests are combined before their shuffle; the payloads move once, by key."""
    text = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), text.alias("payload")).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    ids = rows.where(F.col("size") >= least).select("key", "digest")
    kept = ids.groupBy("digest").agg(F.max("key").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    refs = ids.join(kept.hint("merge"), "digest").where("kept IS NOT NULL AND NOT key <=> kept").select(F.col("key").alias("k"), F.col("digest").alias("d"), F.col("kept").alias("refers_to")).distinct()
    return rows.join(refs.hint("merge"), F.col("key").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("d")), "left").drop("k", "d")


def record(fields: Iterable[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record; control characters in a value are percent-coded."""
    head = "".join(f"{k}: {re.sub('[\x00-\x1f]', lambda m: f'%{ord(m[0]):02X}', v)}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode("utf-8", "replace") + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _b32(hexed: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexed)).decode()


def write_archives(decided: DataFrame) -> DataFrame:
    """``(archive, data)``: complete archives of the rows of ``decide``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count, held, size = TaskContext.get().partitionId(), 0, [], 0
        info = member(record([("WARC-Type", "warcinfo"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Record-ID", "<urn:tidewire:info>"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))

        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{count:06d}.warc.gz"]), pa.array([b"".join([info, *held])], pa.binary())], names=["archive", "data"])

        for batch in batches:
            key, url, payload, digest, length, refers = (batch.column(i) for i in range(6))
            for i in range(batch.num_rows):
                ref, u = refers[i].as_py(), url[i].as_py()
                fields = [("WARC-Type", "response" if ref is None else "revisit"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Record-ID", f"<{URN}{'' if key[i].as_py() is None else key[i].as_py()}>"), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", _b32(digest[i].as_py())), ("X-Payload-Length", str(length[i].as_py()))]
                fields += [("WARC-Target-URI", u)] * (u is not None)
                if ref is not None:
                    fields += [("WARC-Refers-To", f"<{URN}{ref}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                block = HTTP if ref is not None else HTTP + payload[i].as_py()
                fields.append(("WARC-Block-Digest", _b32(hashlib.sha1(block).hexdigest())))
                held.append(member(record(fields, block)))
                size += len(held[-1])
                if size >= ARCHIVE:
                    yield pack()
                    count, held, size = count + 1, [], 0
        if held:
            yield pack()

    return decided.select("key", "url", "payload", "digest", "size", "refers_to").mapInArrow(run, "archive string, data binary")


#: A header is no longer than this; what goes on without its end is none.
HEADER = 1 << 16


def _member(data: bytes, at: int) -> bool:
    """Whether a gzip member may begin at ``at``: its header ends within ``HEADER`` bytes, or the data before it does."""
    if data[at : at + 2] != b"\x1f\x8b":
        return False
    head = data[at : at + 12]
    if len(head) < 12:
        return True
    flags, stop = head[3], at + 10
    if head[2] != 8 or flags & 0xE0:
        return False
    if flags & 4:
        stop += 2 + int.from_bytes(head[10:12], "little")
    for text in (8, 16):
        if flags & text:
            end = data.find(b"\0", stop, at + HEADER)
            if end < 0:
                return at + HEADER > len(data)
            stop = end + 1
    return stop <= at + HEADER


def _inflate(data: memoryview, start: int) -> tuple[bytes, int, str | None]:
    """(content, end, reason) of the gzip member at ``start``; with a reason, what could be inflated before the error."""
    z, out, at = zlib.decompressobj(31), [], start
    while not z.eof:
        chunk = data[at : at + STEP]
        if not len(chunk):
            return b"".join(out), at, "cut off"
        try:
            out.append(z.decompress(chunk))
        except zlib.error as e:
            # the failing call gives nothing back: repeat it byte by byte
            z = zlib.decompressobj(31)
            for k in range(start, at, STEP):
                z.decompress(data[k : min(k + STEP, at)])
            try:
                while True:
                    out.append(z.decompress(data[at : at + 1]))
                    at += 1
            except zlib.error:
                return b"".join(out), at, str(e)[:80]
        at += len(chunk)
    return b"".join(out), at - len(z.unused_data), None


class _Next:
    """The next place of a mark from a place on, the end if there is none; asked for rising places, it reads the data once."""

    def __init__(self, data: bytes, mark: bytes):
        self.data, self.mark, self.at = data, mark, -1

    def __call__(self, start: int) -> int:
        if self.at < start and self.at < len(self.data):
            found = self.data.find(self.mark, start)
            self.at = found if found >= 0 else len(self.data)
        return self.at


def _parse(data: bytes, start: int, blank: _Next) -> tuple[dict[str, str], bytes, int]:
    """(fields, block, end) of the record at ``start``; raises if a check fails."""
    if not re.match(rb"WARC/1\.\d\r\n", data[start : start + 10]):
        raise ValueError("no version line")
    stop = blank(start)
    if stop >= len(data) or stop - start > HEADER:
        raise ValueError("no end of the header")
    fields = {}
    for line in data[start:stop].split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        fields[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit():
        raise ValueError("no length")
    end = stop + 4 + int(fields["content-length"])
    block = data[stop + 4 : end]
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("wrong length")
    want = fields.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:].upper() != _b32(hashlib.sha1(block).hexdigest())[5:]:
        raise ValueError("wrong digest")
    return fields, block, end + 4


def _inside(content: bytes, reason: str | None) -> list[tuple[str | None, dict[str, str] | None, bytes | None]]:
    """``(reason, fields, block)`` of all records and gaps of a member's content, in order."""
    found, inner, bad = [], 0, False
    blank, version = _Next(content, b"\r\n\r\n"), _Next(content, b"WARC/1.")
    checked = bool(reason) and "incorrect" in reason and "check" in reason
    while inner < len(content):
        try:
            fields, block, stop = _parse(content, inner, blank)
            if checked and (inner == 0 and stop == len(content) or not fields.get("warc-block-digest", "").startswith("sha1:")):
                raise ValueError(reason)
            found.append((None, fields, block))
            inner, bad = stop, False
        except ValueError as e:
            if not bad:
                found.append((str(e)[:80], None, None))
                bad = True
            inner = version(inner + 1)
    return found


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, dict[str, str] | None, bytes | None]]:
    """``(start, stop, reason, fields, block)`` of all records and gaps of one archive, in order; a gap has a reason."""
    view, at, gap, why = memoryview(data), 0, -1, ""
    blank, version, zipped = _Next(data, b"\r\n\r\n"), _Next(data, b"WARC/1."), _Next(data, b"\x1f\x8b\x08")
    while at < len(data):
        found, broken = [], None
        try:
            if _member(data, at):
                content, stop, broken = _inflate(view, at)
                inside = _inside(content, broken)
                if broken and inside and inside[-1][0]:
                    inside.pop()  # the gap of the member stands for it
                if (content or broken) and not any(f for _, f, _ in inside):
                    raise ValueError(broken or inside[0][0])
                found = [(at, stop, *x) for x in inside]
            else:
                fields, block, stop = _parse(data, at, blank)
                found = [(at, stop, None, fields, block)]
        except ValueError as e:
            broken = str(e)[:80]
        if found and gap >= 0:
            yield gap, at, why, None, None
            gap = -1
        yield from found
        if broken:
            if gap < 0:
                gap, why = at, broken
            at = min(zipped(at + 1), version(at + 1))
            continue
        at = stop
    if gap >= 0:
        yield gap, len(data), why, None, None


def read_archives(archives: DataFrame, name: str = "archive", data: str = "data", with_payload: bool = False) -> DataFrame:
    """Records and gaps of each archive (schema ``RECORDS``): gaps have a ``reason`` and nothing of a record."""

    def value(text: str | None) -> str | None:
        return None if text is None else text.strip("<>").removeprefix(URN)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                archive = batch.column(0)[i].as_py()
                for start, stop, reason, f, block in salvage(batch.column(1)[i].as_py() or b""):
                    if f is None:
                        rows.append((archive, start, stop, reason, *[None] * 7))
                    elif f.get("warc-type") != "warcinfo":
                        payload = block.partition(b"\r\n\r\n")[2] if f.get("content-type", "").startswith("application/http") else block
                        digest = f.get("warc-payload-digest", "")
                        hexed = base64.b32decode(digest[5:]).hex() if re.fullmatch("sha1:[A-Z2-7]{32}", digest) else hashlib.sha1(payload).hexdigest()
                        if f.get("warc-type") == "response" and hexed != hashlib.sha1(payload).hexdigest():
                            rows.append((archive, start, stop, "wrong payload digest", *[None] * 7))
                            continue
                        length = f.get("x-payload-length", "")
                        rows.append((archive, start, stop, None, f.get("warc-type"), value(f.get("warc-record-id")), f.get("warc-target-uri"), value(f.get("warc-refers-to")), hexed, int(length) if length.isdigit() else len(payload), payload if with_payload else None))
                        size += len(payload) * with_payload
                    if size > ARCHIVE:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    return archives.select(name, data).mapInArrow(run, RECORDS)
