"""Reading landed files so that a bad file or record costs only itself, with a ledger of what went wrong by source."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.session import stored


def _opened(content: bytes) -> tuple[str | None, str | None]:
    """Text of a file, gzip or plain, or why there is none."""
    try:
        if content[:2] == b"\x1f\x8b":
            content = gzip.decompress(content)
        return content.decode("utf-8-sig"), None
    except (OSError, EOFError, zlib.error):
        return None, "not readable"
    except UnicodeDecodeError:
        return None, "not UTF-8"


def read_files(spark: SparkSession, path: str, source: str = "source=([^/]*)") -> DataFrame:
    """(path, source, text, error) of every file under a path; nothing a file holds fails the job.

    A file is one record, as an envelope is one document; files that can't be opened at all are told by their absence from
    the second listing; a file without content is no file. ``source`` is a pattern whose group names the source in the path.
    """
    options = {"recursiveFileLookup": "true", "ignoreCorruptFiles": "true", "ignoreMissingFiles": "true"}
    listed = spark.read.format("binaryFile").options(**options).load(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text, error = _opened(b.column(1)[i].as_py() or b"")
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([text], pa.string()), pa.array([error], pa.string())], names=["path", "text", "error"])

    read = listed.select("path", "content").mapInArrow(run, "path string, text string, error string")
    out = listed.select("path").join(read.hint("merge"), "path", "left")
    missing = F.col("text").isNull() & F.col("error").isNull()
    return out.select("path", F.regexp_extract("path", source, 1).alias("source"), "text", F.when(missing, "not readable").otherwise(F.col("error")).alias("error"))


def isolate(files: DataFrame, field: str, item: str, required: tuple[str, ...] = ("id",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, quarantine, ledger) of files that are a list of items or an object with the list under ``field``.

    A file that can't be read or has neither shape is one error of its source and goes to the quarantine whole; an item that
    isn't an object or lacks a required field goes there alone. The ledger has a row for each source, also for those that lost
    all: files, rows, errors (files) and records in quarantine.
    """
    # read_files is followed by two ways; the texts are written once
    files = stored(files, "files")
    trimmed = F.ltrim("text")
    parsed = F.try_parse_json("text")
    of = F.when(F.startswith(trimmed, F.lit("[")), F.col("text")).otherwise(F.get_json_object("text", f"$.{field}"))
    shaped = files.withColumns({"items": F.when(parsed.isNotNull(), of)})
    shaped = shaped.withColumn("why", F.when(F.col("error").isNotNull(), F.col("error")).when(parsed.isNull(), "not JSON").when(F.col("items").isNull() | ~F.startswith(F.ltrim("items"), F.lit("[")), "no list of items"))
    each = shaped.where("why IS NULL").select("path", "source", F.posexplode(F.from_json("items", "array<string>")).alias("place", "record"))
    each = each.withColumn("item", F.from_json("record", item))
    lacking = F.concat_ws(", ", *(F.when(F.coalesce(F.trim(F.col("item")[r].cast("string")), F.lit("")) == "", r) for r in required))
    each = each.withColumn("why", F.when(~F.startswith(F.ltrim(F.coalesce("record", F.lit(""))), F.lit("{")), "not an object").when(lacking != "", F.concat(F.lit("no "), lacking)))
    each = stored(each.select("path", "source", "place", "record", "item", "why"), "records")
    rows = each.where("why IS NULL").select("source", "path", "place", "item.*")
    bad = shaped.where("why IS NOT NULL").select("path", "source", F.lit(None).cast("int").alias("place"), F.col("text").alias("record"), "why")
    quarantine = bad.unionByName(each.where("why IS NOT NULL").select("path", "source", "place", "record", "why"))
    by_file = shaped.groupBy("source").agg(F.count("*").alias("n_files"), F.count("why").alias("n_errors"))
    by_record = each.groupBy("source").agg(F.count_if(F.col("why").isNull()).alias("n_rows"), F.count("why").alias("n_bad_records"))
    ledger = by_file.join(by_record.hint("merge"), "source", "left").select("source", "n_files", "n_errors", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_bad_records", F.lit(0)).alias("n_bad_records"))
    return rows, quarantine, ledger
